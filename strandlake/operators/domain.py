"""Further domain operators (inventory 2.3, 2.5, 2.6, 2.14, 2.15): small compositions that pipelines are made of."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import align
from strandlake.functions import interval as iv
from strandlake.functions import profile as pf
from strandlake.functions import sequence as sq
from strandlake.operators import aggregate, ordered, relational


# Scans and filters


def concat_tables(spark: SparkSession, paths: Sequence[str], schema: str, sep: str = "\t") -> DataFrame:
    """Several headerless tables, globs too, as one, with the file each row is from."""
    return spark.read.schema(schema).csv(list(paths), sep=sep).withColumn("file", F.input_file_name())


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """N rows, as many as are asked for and no more are read."""
    return rows.limit(n)


def filter_reads(alignments: DataFrame, ids: DataFrame | None = None, spliced: bool | None = None, min_aligned: int = 0) -> DataFrame:
    """primary alignments by id list, splicing and aligned length; None passes all."""
    out = alignments.filter(iv.is_primary(F.col("flag")))
    if spliced is not None:
        out = out.filter(iv.is_spliced(F.col("cigar")) == spliced)
    if min_aligned:
        out = out.filter(iv.total_length(F.col("blocks")) >= min_aligned)
    return out if ids is None else relational.whitelist(out, ids, "read_id")


def filter_exon_counts(counts: DataFrame, cutoff: int, keep_constitutive: bool = False) -> DataFrame:
    """exons (exon, include, exclude) whose total reaches cutoff and of which both outcomes occur."""
    total = counts.groupBy("exon").agg(F.sum("include").alias("i"), F.sum("exclude").alias("e")).filter(F.col("i") + F.col("e") >= cutoff)
    return relational.whitelist(counts, total if keep_constitutive else total.filter("least(i, e) > 0"), "exon")


def quality_whitelist(rows: DataFrame, quality: str, least: float, ids: DataFrame, key: str) -> DataFrame:
    """F16."""
    return relational.whitelist(rows.filter(F.col(quality) >= least), ids, key)


def hold_out(isoforms: DataFrame, seed: int, drop: float, least: float) -> DataFrame:
    """Expressed isoforms (gene_id, transcript_id, tpm) with a repeatable part held out, never all of a gene."""
    roll = ordered.uniform(seed, "transcript_id") < drop
    marked = isoforms.withColumn("held_out", roll & (F.col("tpm") >= least))
    kept = F.count_if(~F.col("held_out")).over(Window.partitionBy("gene_id"))
    first = F.row_number().over(Window.partitionBy("gene_id").orderBy(F.desc("tpm"), "transcript_id")) == 1
    return marked.withColumn("held_out", F.col("held_out") & ~((kept == 0) & first))


def restore_versions(short: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """full ids (key of full) for short ones (first column of short), the smallest of several; those that are not found are
    dropped."""
    table = full.groupBy(sq.without_version(key).alias("__short")).agg(F.min(key).alias("full_id"))
    return short.join(table, short[short.columns[0]] == F.col("__short")).drop("__short")


def split_column(rows: DataFrame, column: str, names: Sequence[str], sep: str = "::") -> DataFrame:
    """a column's parts as columns of their own, in its place."""
    parts = F.split(column, f"\\Q{sep}\\E")
    return rows.select(*[c for c in rows.columns if c != column], *[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def exon_polya_filter(tests: DataFrame, combinations: int, distance: int, a_fraction: float, annotated: bool = False) -> DataFrame:
    """tests with enough combinations, sites far enough apart and no A-rich site."""
    ok = (F.col("n_combinations") >= combinations) & (F.abs(F.col("polya1") - F.col("polya2")) >= distance) & (F.col("a_fraction") <= a_fraction)
    return tests.filter(ok & F.col("annotated1") & F.col("annotated2") if annotated else ok)


# Joins


def merge_cells(reads: DataFrame, barcodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Reads, their cells and the cells' types; a group id only for single cells."""
    both = reads.join(barcodes, "barcode_id").join(cells, "cell_id")
    return both.withColumn("group_id", F.when(F.col("spot_type") == "singlet", F.concat_ws("_", "cell_type1", "region")))


def merge_two_calls(a: DataFrame, b: DataFrame, umi: int = 9) -> DataFrame:
    """Calls of two tools by read: whichever has a barcode; of two, that whose UMI is nearer the right length, a on ties."""
    x = a.select("read_id", F.struct("barcode", "umi").alias("a"))
    y = b.select("read_id", F.struct("barcode", "umi").alias("b"))
    far = lambda c: F.abs(F.length(F.col(c)["umi"]) - umi)
    pick = F.when(F.col("a.barcode") == "*", F.col("b")).when(F.col("b.barcode") == "*", F.col("a")).when(far("b") < far("a"), F.col("b")).otherwise(F.col("a"))
    return x.join(y, "read_id").select("read_id", pick.alias("c")).select("read_id", "c.barcode", "c.umi")


def cluster_of_barcode(reads: DataFrame, clusters: DataFrame, lengths: Sequence[int] = (16, 14)) -> DataFrame:
    """Paired reads' cluster by the longest barcode prefix that is known."""
    out = reads
    for n in lengths:
        table = clusters.filter(F.length("barcode") == n).select(F.col("barcode").alias(f"__p{n}"), F.col("cluster").alias(f"__c{n}"))
        out = out.withColumn(f"__p{n}", F.substring("barcode_read", 1, n)).join(table, f"__p{n}", "left").drop(f"__p{n}")
    found = F.coalesce(*[F.col(f"__c{n}") for n in lengths])
    return out.withColumn("cluster", found).drop(*[f"__c{n}" for n in lengths]).filter("cluster is not null")


def normalise_exons(pairs: DataFrame, exons: DataFrame) -> DataFrame:
    """An exon (gene_id, chr, start, end) of the annotation: itself, else the gene's with the largest overlap, the
    first by start on ties, else null."""
    known = exons.select("gene_id", F.struct("start", "end").alias("k")).groupBy("gene_id").agg(F.collect_set("k").alias("__known"))
    own = F.struct("start", "end")
    best = F.when(F.array_contains("__known", own), own).otherwise(iv.best_feature(own, F.col("__known")))
    return pairs.join(known, "gene_id", "left").withColumn("normal", best).drop("__known")


def strict_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join that fails on a key that is missing, as a lookup that must succeed."""
    marked = rows.join(table.withColumn("__there", F.lit(True)), key, "left")
    check = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return marked.filter(check).drop("__there")


def gene_counts(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """Transcript counts summed by gene, with TPM."""
    per = strict_lookup(counts, genes, "transcript_id").groupBy("gene_id").agg(F.sum("count").alias("count"))
    return aggregate.tpm(per, "count")


def truncated_key_join(barcodes: DataFrame, guides: DataFrame, key: str, tokens: int = 3) -> DataFrame:
    """J26."""
    return strict_lookup(barcodes.withColumn("guide_key", F.substring_index(key, "_", tokens)), guides.withColumnRenamed("key", "guide_key"), "guide_key")


def grouped_counts(counts: DataFrame, groups: DataFrame, by: str, values: Sequence[str]) -> DataFrame:
    """Counts with their barcodes' groups, those with something to count."""
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.join(groups, by).filter(total > 0)


def paired_alignments(a: DataFrame, b: DataFrame, on: str = "read_id") -> DataFrame:
    """Primary alignments of two runs side by side, left by the second."""
    x = a.filter(iv.is_primary(F.col("flag"))).select(on, F.struct("chr", "start", "mapq", "cigar").alias("raw"))
    y = b.filter(iv.is_primary(F.col("flag"))).select(on, F.struct("chr", "start", "mapq", "cigar").alias("corrected"))
    return y.join(x, on, "left")


def tag_contigs(contigs: DataFrame, datasets: DataFrame) -> DataFrame:
    """The dataset appended to the ids that have one."""
    return contigs.join(datasets, "id", "left").withColumn("id", F.concat_ws("_", "id", "dataset")).drop("dataset")


def intersect_snps(tables: Sequence[DataFrame], min_cov: int, min_freq: float) -> DataFrame:
    """Variants (chr, pos, ref, alt, cov, reads) that all tables have, covered, with the pooled frequency; at least one
    table reaches min_freq."""
    keys = ["chr", "pos", "ref", "alt"]
    every = tables[0].withColumn("__t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.withColumn("__t", F.lit(i)))
    good = every.filter(F.col("cov") >= min_cov)
    out = good.groupBy(*keys).agg(F.count_distinct("__t").alias("__n"), (F.sum("reads") / F.sum("cov")).alias("freq"), F.max(F.col("reads") / F.col("cov")).alias("__most"))
    return out.filter((F.col("__n") == len(tables)) & (F.col("__most") >= min_freq)).drop("__n", "__most")


def paralog_report(genes: DataFrame, paralogs: DataFrame) -> DataFrame:
    """For each gene of a list its paralogs, and the protein-coding ones (each list's own)."""
    return genes.join(paralogs, "gene_id", "left").groupBy("gene_id").agg(F.count_distinct("paralog").alias("n_paralogs"), F.count_distinct(F.when(F.col("biotype") == "protein_coding", F.col("paralog"))).alias("n_coding"))


# Aggregations


def sample_counts(alignments: DataFrame, sample: str, samples: Sequence[str], cutoff: int = 0) -> DataFrame:
    """Counts by reference and sample, wide, with their sum."""
    wide = relational.pivot_counts(alignments.filter("chr is not null"), "chr", sample, samples)
    total = sum((F.col(f"`{s}`") for s in samples[1:]), F.col(f"`{samples[0]}`"))
    return wide.withColumn("total", total).filter(F.col("total") >= cutoff)


def gene_lengths(transcripts: DataFrame) -> DataFrame:
    """Longest and mean transcript, whether any is spliced, and the length's bin in kilobases (5 at most)."""
    per = transcripts.select("gene_id", "transcript_id", iv.total_length(F.col("exons")).alias("len"), F.size("exons").alias("n"))
    out = per.groupBy("gene_id").agg(F.max("len").alias("longest"), F.floor(F.avg("len")).alias("mean_length"), F.bool_or(F.col("n") > 1).alias("spliced"), F.count("*").alias("n_transcripts"), F.sum("n").alias("n_exons"))
    return out.withColumn("bin", F.least(F.floor(F.col("longest") / 1000), F.lit(5)))


def sample_summary(rows: DataFrame, samples: int) -> DataFrame:
    """Reads of a transcript in all, unique and full-match, and in how many samples there are 1, 3 and 10 unique;
    `broad` says whether more than half of the samples have it."""
    per = rows.groupBy("transcript_id", "sample").agg(F.count("*").alias("n"), F.count_if("is_unique").alias("u"), F.count_if(F.col("is_unique") & F.col("is_full")).alias("f"))
    cols = [F.count_if(F.col(c) >= k).alias(f"{c}_in_{k}") for c in ("u", "f") for k in (1, 3, 10)]
    out = per.groupBy("transcript_id").agg(F.sum("n").alias("reads"), F.sum("u").alias("unique"), F.sum("f").alias("full"), *cols)
    return out.withColumn("broad", F.col("u_in_1") * 2 > samples)


def two_class_counts(rows: DataFrame, key: str, is_first: Column, value: str) -> DataFrame:
    """A35."""
    return rows.groupBy(key).agg(F.sum(F.when(is_first, F.col(value)).otherwise(0)).alias("first"), F.sum(F.when(is_first, 0).otherwise(F.col(value))).alias("other"))


def event_flags(assignments: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """How many reads have an event of each kind; the first row of a read counts."""
    w = Window.partitionBy("read_id").orderBy("isoform_id", "events")
    one = assignments.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
    events = F.split(F.col("events"), "[,+]")
    has = lambda p: F.exists(events, lambda e: e.startswith(p))
    return one.agg(F.count("*").alias("reads"), *[F.count_if(has(p)).alias(p) for p in prefixes])


def exon_summary(exons: DataFrame) -> DataFrame:
    """Counters of exon classes with the mean coding share."""
    return exons.agg(F.count("*").alias("exons"), F.count_if("is_cds").alias("coding"), F.count_if(~F.col("is_cds")).alias("noncoding"), F.count_if(F.col("coding_share") >= 1).alias("fully_coding"), F.count_if((F.col("coding_share") > 0) & (F.col("coding_share") < 1)).alias("partly_coding"), F.avg("coding_share").alias("mean_share"))


def sequence_summary(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """GC per cent, length and longest run by row."""
    return rows.withColumns({"gc": sq.gc_percent(seq), "length": F.length(seq), "longest_run": sq.longest_run(seq)})


def precision_by_barcode(calls: DataFrame, least: int = 1) -> DataFrame:
    """Correct share of each barcode, in bins of 5 per cent, and whether it is at most 80."""
    per = calls.groupBy("barcode").agg(F.count("*").alias("called"), F.count_if(F.col("barcode") == F.col("truth")).alias("correct")).filter(F.col("called") >= least)
    share = 100.0 * F.col("correct") / F.col("called")
    return per.withColumns({"share": share, "bin": (F.floor(share / 5) * 5).cast("int"), "poor": share <= 80})


def abundance_deciles(snps: DataFrame, min_cov: int = 1) -> DataFrame:
    """Of the covered samples' share with the variant, the tenth it falls into (9 at most), counted."""
    per = snps.filter(F.col("cov") >= min_cov).groupBy("chr", "pos", "alt").agg(F.count("*").alias("n"), F.count_if(F.col("reads") > 0).alias("a"))
    return per.groupBy(F.least(F.floor(10 * F.col("a") / F.col("n")), F.lit(9)).alias("decile")).agg(F.count("*").alias("n"))


def group_abundance(freqs: Column, ranges: dict[str, tuple[int, int]], least: float = 0.3) -> dict[str, Column]:
    """For named ranges of samples, the share whose frequency reaches least."""
    def share(a: int, b: int) -> Column:
        part = F.slice(freqs, a + 1, b - a)
        return F.size(F.filter(part, lambda x: x >= least)) / F.size(part)
    return {n: share(a, b) for n, (a, b) in ranges.items()}


def truncation_histogram(rows: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """Left and right missing shares in 10 and 100 bins, added to every stratum whose bound the transcript's
    length does not exceed, as shares of their left bin."""
    strata = F.explode(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("length") <= b))
    bins = rows.withColumn("stratum", strata).groupBy("stratum", F.least(F.floor(F.col("left") * 10), F.lit(9)).alias("left_bin"), F.least(F.floor(F.col("right") * 100), F.lit(99)).alias("right_bin")).agg(F.count("*").alias("n"))
    return bins.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("stratum", "left_bin")))


def coverage_profile(rows: DataFrame, bins: int = 100) -> DataFrame:
    """How many reads cover each hundredth, from their left and right missing shares."""
    first, last = F.round(F.col("left") * bins).cast("int"), F.round((1 - F.col("right")) * bins).cast("int") - 1
    return rows.filter(last >= first).select(F.explode(F.sequence(first, last)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def quality_by_event(alignments: DataFrame) -> DataFrame:
    """Base qualities by CIGAR operation (matches, insertions, clips)."""
    ops = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+[MIS=X])"), F.lit(1)), lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    kinds = F.flatten(F.transform(ops, lambda o: F.array_repeat(o["op"], o["n"])))
    pairs = F.arrays_zip(kinds.alias("op"), F.filter(F.split("qual", ""), lambda c: c != "").alias("q"))
    rows = alignments.filter("qual is not null and cigar is not null").select(F.explode(pairs).alias("p")).filter("p.q is not null and p.op is not null")
    return rows.groupBy(F.col("p.op").alias("op"), (F.ascii("p.q") - 33).alias("quality")).agg(F.count("*").alias("n"))


def length_distribution(tables: dict[str, DataFrame], length: str, most: int) -> DataFrame:
    """Counts by length for several inputs on a spine from 1, 0 where nothing is."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.range(1, most).withColumnRenamed("id", "length")
    counts = relational.outer_counts({n: t.groupBy(F.col(length).cast("long").alias("length")).agg(F.count("*").alias("n")) for n, t in tables.items()}, "length", "n")
    return out.join(counts, "length", "left").na.fill(0)


def end_positions(alignments: DataFrame, low: int, high: int) -> DataFrame:
    """Starts as the soft clip extends them, counted in a window."""
    clip = F.coalesce(F.regexp_extract("cigar", r"^(\d+)S", 1).try_cast("int"), F.lit(0))
    return alignments.select((F.col("start") - clip).alias("pos")).filter((F.col("pos") >= low) & (F.col("pos") < high)).groupBy("pos").agg(F.count("*").alias("n"))


def substitution_counts(rows: DataFrame, genomic: DataFrame) -> DataFrame:
    """Reads and places of each substitution that the genome does not have."""
    kept = relational.blacklist(rows, genomic, ["chr", "pos", "sub"])
    return kept.groupBy("sub").agg(F.sum("reads").alias("reads"), F.count("*").alias("places"))


def gene_set_summary(genes: DataFrame, info: DataFrame) -> DataFrame:
    """Counts by type of a gene list, the unspliced among them and mean lengths."""
    return genes.join(info, "gene_id").groupBy("biotype").agg(F.count("*").alias("n"), F.count_if(F.col("mean_exons") == 1).alias("unspliced"), F.avg("length").alias("mean_length"))


def used_site_ratio(sites: DataFrame) -> DataFrame:
    """The least used site's reads over the largest other one's."""
    return sites.groupBy("gene_id").agg((F.min(F.when(F.col("used"), F.col("n"))) / F.nullif(F.max(F.when(~F.col("used"), F.col("n"))), F.lit(0))).alias("ratio"))


def site_exon_combinations(transcripts: DataFrame) -> DataFrame:
    """Distinct (poly-A site, has the exon) combinations, four at most."""
    return transcripts.groupBy("test").agg(F.count_distinct("polya", "has_exon").alias("n_combinations"))


def shuffled_saturation(rows: DataFrame, unique: str, values: list[str], seed: int, steps: int = 10) -> DataFrame:
    """The saturation curve in a repeatable random order."""
    return ordered.saturation(rows.withColumn("__order", ordered.uniform(seed, unique)), "__order", values, steps)


def subsampling_curve(reads: DataFrame, least: int = 10, iterations: int = 20, seed: int = 1) -> DataFrame:
    """Genes with enough reads when a tenth to nine tenths are drawn: median and quartiles over the iterations.

    A read has one number for each iteration and is drawn where that is below the share, so a read becomes `iterations` rows
    at most before they are counted by gene.
    """
    each = reads.select("read_id", "gene_id", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it"))
    roll = each.select("it", "gene_id", ordered.uniform(seed, "it", "read_id").alias("u"))
    per = roll.groupBy("it", "gene_id").agg(*[F.count_if(F.col("u") < t / 10).alias(f"n{t}") for t in range(1, 10)])
    genes = per.groupBy("it").agg(*[F.count_if(F.col(f"n{t}") >= least).alias(str(t)) for t in range(1, 10)])
    spine = reads.sparkSession.range(iterations).select(F.col("id").cast("int").alias("it"))
    long = spine.join(genes, "it", "left").na.fill(0).unpivot(["it"], [str(t) for t in range(1, 10)], "tenth", "genes")
    return long.groupBy(F.col("tenth").cast("long").alias("tenth")).agg(*[F.percentile("genes", q).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])


def sorted_rows(rows: DataFrame, *keys: str, descending: Sequence[str] = ()) -> DataFrame:
    """A total order by several keys, some descending."""
    return rows.orderBy(*[F.desc(k) if k in descending else F.asc(k) for k in keys])


def arg_max(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The value with the largest weight; the larger value on ties."""
    return rows.groupBy(key).agg(F.max(F.struct(weight, value)).alias("m")).select(key, F.col(f"m.{value}").alias(value), F.col(f"m.{weight}").alias(weight))


def common_unique(a: DataFrame, b: DataFrame, key: str, least: int = 10) -> DataFrame:
    """U8: keys with enough rows on each side and in common."""
    x, y = (t.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least) for t in (a, b))
    return relational.set_report(x, y, key)


# Sequences and alignment


def tag_flanks(rows: DataFrame, barcode: str, umi: str, flank: int = 20) -> DataFrame:
    """Where the raw barcode lies in the read or its complement, what is between it and the UMI, and both flanks."""
    use = F.when(F.expr(f"instr(seq, {barcode})") > 0, F.col("seq")).otherwise(sq.revcomp("seq"))
    out = rows.withColumn("oriented", use).withColumn("at", F.expr(f"instr(oriented, {barcode})"))
    out = out.withColumn("umi_at", F.expr(f"instr(oriented, {umi})")).filter("at > 0")
    left = F.substring("oriented", F.greatest(F.col("at") - flank, F.lit(1)), F.least(F.col("at") - 1, F.lit(flank)))
    end = F.col("at") + F.length(barcode)
    middle = F.when(F.col("umi_at") > end, F.substring("oriented", end, F.col("umi_at") - end)).otherwise("")
    return out.withColumns({"left": left, "middle": middle, "right": F.substring(F.col("oriented"), end, F.lit(flank))})


def good_adapter(adapter: str, known: Sequence[str], least: float = 0.7) -> bool:
    """Whether an adapter's best local score against the known ones reaches a share of its length."""
    return max((align.local_align(k, adapter)[0] for k in known), default=0) >= least * len(adapter)


def barcode_before_t9(reads: DataFrame, barcodes: DataFrame, size: int = 16, far: int = 36, near: int = 6) -> DataFrame:
    """Known barcodes in the windows before the first T9."""
    at = F.locate("T" * 9, F.col("seq")) - 1
    starts = F.sequence(F.greatest(at - far, F.lit(0)), F.greatest(at - near - size, F.lit(0)))
    windows = reads.filter(at >= size).select("read_id", F.explode(F.transform(starts, lambda i: F.substring("seq", i + 1, F.lit(size)))).alias("barcode"))
    return windows.join(barcodes.select("barcode").distinct(), "barcode", "left_semi").distinct()


def verify_guides(rows: DataFrame, overlap: int, substitutions: int, indels: int) -> DataFrame:
    """Reads whose alignment to their guide is long enough with few substitutions and few gaps (each by its own limit)."""
    @F.pandas_udf("overlap int, subs int, gaps int")
    def measure(text: pd.Series, guide: pd.Series) -> pd.DataFrame:
        out = []
        for t, g in zip(text, guide):
            score, a, b, c, d = align.local_align(t or "", g or "")
            gaps = abs((b - a) - (d - c))
            span = min(b - a, d - c)
            out.append((span, max(0, (span - score - gaps) // 2), gaps))
        return pd.DataFrame(out, columns=["overlap", "subs", "gaps"])
    m = rows.withColumn("m", measure("seq", "guide_seq"))
    return m.filter((F.col("m.overlap") >= overlap) & (F.col("m.subs") <= substitutions) & (F.col("m.gaps") <= indels)).drop("m")


def linker_halves(rows: DataFrame, left: DataFrame, right: DataFrame, linker: str, parts: tuple[int, int] = (8, 6)) -> DataFrame:
    """Around an exact linker: both parts, and whether each is on its list; status says which of linker and
    parts were found."""
    at = F.locate(linker, F.col("seq"))
    cut = rows.withColumns({"l": F.when(at > parts[0], F.substring(F.col("seq"), at - parts[0], F.lit(parts[0]))), "r": F.when(at > 0, F.substring(F.col("seq"), at + len(linker), F.lit(parts[1])))})
    out = cut.join(left.select(F.col("part").alias("l"), F.lit(True).alias("l_known")), "l", "left").join(right.select(F.col("part").alias("r"), F.lit(True).alias("r_known")), "r", "left")
    out = out.na.fill(False, ["l_known", "r_known"])
    status = F.when(F.col("l").isNull(), "no linker").when(F.col("l_known") & F.col("r_known"), "both").when(F.col("l_known"), "left").when(F.col("r_known"), "right").otherwise("none")
    return out.withColumn("status", status)


# Assemblies, contigs and profiles


def distant_misassemblies(alignments: DataFrame, least: int = 1000, most_shared: float = 0.2) -> DataFrame:
    """Contigs whose primary alignment and a supplementary one share little of the contig and lie on different references,
    or on one with starts at least `least` farther apart, or nearer, than in the contig."""
    place = lambda i: F.struct(F.col("q_start").alias("start"), F.col("q_end").alias("end"), F.col("chr").alias("chr"), F.col("start").alias("at")).alias(i)
    a, b = alignments.filter("is_primary").select("contig", place("p")), alignments.filter("not is_primary").select("contig", place("s"))
    apart = F.abs(F.abs(F.col("p.at") - F.col("s.at")) - F.abs(F.col("p.start") - F.col("s.start"))) >= least
    return a.join(b, "contig").filter((iv.overlap_fraction(F.col("p"), F.col("s")) <= most_shared) & ((F.col("p.chr") != F.col("s.chr")) | apart)).select("contig").distinct()


def covered_references(alignments: DataFrame, least: float = 0.95) -> DataFrame:
    """References and contigs that are covered almost wholly."""
    per = alignments.groupBy("chr", "contig").agg((F.sum("ref_aligned") / F.max("ref_length")).alias("ref_share"), (F.sum("contig_aligned") / F.max("contig_length")).alias("contig_share"))
    return per.agg(F.count_distinct(F.when(F.col("ref_share") >= least, F.col("chr"))).alias("references"), F.count_distinct(F.when((F.col("ref_share") >= least) & (F.col("contig_share") >= least), F.col("chr"))).alias("by_whole_contigs"))


def split_map(rows: DataFrame, column: str, sep: str = "_barcodeIDs_") -> DataFrame:
    """Contig ids that carry their barcodes, one row for each."""
    parts = F.split(column, sep)
    return rows.select(parts[0].alias("contig"), F.explode(F.split(F.get(parts, 1), ",")).alias("barcode"))


def exon_vector(blocks: Column, exons: Column) -> Column:
    """1 where a block overlaps the exon, -1 between the first and last such, 0 outside."""
    return pf.fill_gaps(F.transform(exons, lambda e: F.when(F.exists(blocks, lambda b: iv.overlaps(b, e)), 1).otherwise(0)))


def cluster_profiles(rows: DataFrame, key: str, profile: str, order: str) -> DataFrame:
    """Profiles of a key merged, each into the first before it that it does not contradict, gaps filled at the end;
    order-dependent, so equal profiles are collapsed first and the rest goes by `order`."""
    distinct = rows.groupBy(key, profile).agg(F.count("*").alias("support"), F.min(order).alias(order))
    fields = {f.name: f.dataType.simpleString() for f in distinct.schema}

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        heads: list[list] = []
        for p, n in group.sort_values(order)[[profile, "support"]].itertuples(index=False):
            p = list(p)
            for h in heads:
                if all(x == 0 or y == 0 or x == y for x, y in zip(h[0], p)):
                    h[0] = [x or y for x, y in zip(h[0], p)]
                    h[1] += n
                    break
            else:
                heads.append([p, n])
        out = []
        for p, n in heads:
            at = [i for i, x in enumerate(p) if x]
            out.append((group[key].iloc[0], [-1 if x == 0 and at and at[0] < i < at[-1] else x for i, x in enumerate(p)], n))
        return pd.DataFrame(out, columns=[key, profile, "support"])

    return distinct.groupBy(key).applyInPandas(merge, f"`{key}` {fields[key]}, `{profile}` {fields[profile]}, support long")


def assignment_report(rows: DataFrame) -> DataFrame:
    """Assigned against true isoforms (true_isoform, true_gene, isoforms, gene_id, assignment_type)."""
    one = F.size("isoforms") == 1
    right = F.array_contains("isoforms", F.col("true_isoform"))
    kind = F.when(F.col("gene_id").isNull(), "unassigned").when(F.col("assignment_type") == "contradictory", "contradictory").when(one & right, "correct").when(right, "ambiguous_correct").when(F.col("gene_id") == F.col("true_gene"), "same_gene").otherwise("mismapped")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def clipped_fractions(reads: DataFrame) -> DataFrame:
    """Exonic bases before and after the aligned span, as shares of the isoform, turned on '-'."""
    total = iv.total_length(F.col("exons"))
    cover = iv.span(F.col("blocks"))
    before = iv.total_length(iv.until(F.col("exons"), cover["start"] - 1)) / total
    after = iv.total_length(iv.starting_from(F.col("exons"), cover["end"] + 1)) / total
    minus = F.col("strand") == "-"
    return reads.withColumns({"left": F.when(minus, after).otherwise(before), "right": F.when(minus, before).otherwise(after)})


def covered_codons(contigs: DataFrame, codons: DataFrame) -> DataFrame:
    """Contigs (contig, gene_id, blocks) of exactly one gene by the start and stop codons that their blocks hold."""
    one = contigs.withColumn("__g", F.size(F.collect_set("gene_id").over(Window.partitionBy("contig")))).filter("__g = 1").drop("__g")
    hit = one.join(codons.select("gene_id", F.col("kind"), F.col("pos")), "gene_id").filter(F.exists("blocks", lambda b: (b["start"] <= F.col("pos")) & (b["end"] >= F.col("pos") + 2)))
    per = hit.groupBy("contig", "gene_id").agg(F.count_distinct(F.when(F.col("kind") == "start", F.col("pos"))).alias("starts"), F.count_distinct(F.when(F.col("kind") == "stop", F.col("pos"))).alias("stops"))
    s, t = F.coalesce("starts", F.lit(0)), F.coalesce("stops", F.lit(0))
    kind = F.when((s == 0) & (t == 0), "none").when(t == 0, "only_start").when(s == 0, "only_stop").when((s == 1) & (t == 1), "pair").otherwise("multiple")
    return one.select("contig", "gene_id").distinct().join(per, ["contig", "gene_id"], "left").withColumn("kind", kind)


def hierarchy_text(features: DataFrame) -> DataFrame:
    """A line for each gene with its transcripts' exons."""
    line = F.concat_ws("\t", "transcript_id", F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"], e["end"])), ","))
    return features.groupBy("gene_id", "chr", "strand").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("value"))


def supported_introns(assignments: DataFrame, least: int) -> DataFrame:
    """Introns named in events, with enough reads."""
    found = assignments.select("read_id", "gene_id", F.explode(F.regexp_extract_all("events", F.lit(r"(\d+-\d+)"), F.lit(1))).alias("intron"))
    return found.groupBy("gene_id", "intron").agg(F.count_distinct("read_id").alias("support")).filter(F.col("support") >= least)


def site_shifts(pairs: DataFrame, reach: int = 10) -> DataFrame:
    """Distances between observed and annotated sites within reach, each variant once, no shift counted once."""
    d = F.col("observed") - F.col("annotated")
    return pairs.select("kind", "chr", "observed", "annotated").distinct().filter(F.abs(d) <= reach).groupBy("kind", d.alias("shift")).agg(F.count("*").alias("n"))


def select_pairs(long: DataFrame, short: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Short reads of `limit` long ones, taken in the order of a hash."""
    some = long.orderBy(F.md5(F.col("read_id").cast("string")), "read_id").limit(limit)
    return pairs.join(F.broadcast(some.select(F.col("read_id").alias("long_id"))), "long_id", "left_semi").join(short.withColumnRenamed("read_id", "short_id"), "short_id")


def template_lengths(pairs: DataFrame, most: int = 1000) -> DataFrame:
    """Strand-aware template lengths below most: mean and population deviation."""
    n = F.when(F.col("strand") == "-", F.col("start1") - F.col("start2")).otherwise(F.col("end2") - F.col("start1")) - F.col("offset")
    return pairs.select(n.alias("n")).filter((F.col("n") >= 0) & (F.col("n") < most)).agg(F.count("*").alias("pairs"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"))


def expected_distinct(counts: DataFrame, count: str, draws: int) -> DataFrame:
    """Expected number of distinct colours among `draws` balls taken without putting back: 1 - C(N - k, d) / C(N, d) for
    a colour of k balls, from differences of log gammas."""
    @F.pandas_udf("double")
    def missing(k: pd.Series, n: pd.Series) -> pd.Series:
        from math import exp, lgamma

        def one(k: int, n: int) -> float:
            if n - k < draws:
                return 0.0
            return exp(lgamma(n - k + 1) - lgamma(n - k - draws + 1) - lgamma(n + 1) + lgamma(n - draws + 1))

        return pd.Series([one(int(a), int(b)) for a, b in zip(k, n)], dtype="float64")

    total = counts.agg(F.sum(count).alias("__n"))
    return counts.crossJoin(F.broadcast(total)).agg(F.sum(1 - missing(F.col(count), F.col("__n"))).alias("expected"))


# Matrices


def drop_sparse_rows(rows: DataFrame, key: str, value: str, most_missing: int) -> DataFrame:
    """Rows of a long matrix with too many missing cells."""
    bad = rows.groupBy(key).agg(F.count_if(F.col(value).isNull()).alias("__m")).filter(F.col("__m") > most_missing)
    return relational.blacklist(rows, bad, key)


def molecule_table(molecules: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Molecules of known cells with their genes' names and decoded UMIs."""
    return relational.whitelist(molecules, cells, "cell").join(genes, "gene_index").withColumn("umi", sq.two_bit_decode("umi_code", 10))


def bed12_exons(bed: DataFrame) -> DataFrame:
    """Exon chains of BED12 rows and the introns between them."""
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    exons = F.transform(F.arrays_zip(ints("block_starts").alias("s"), ints("block_sizes").alias("n")), lambda b: F.struct((F.col("start") + b["s"] + 1).alias("start"), (F.col("start") + b["s"] + b["n"]).alias("end")))
    return bed.withColumn("exons", exons).withColumn("introns", iv.junctions(F.col("exons")))


def log_rpkm(counts: DataFrame, sample: str, count: str, length: str) -> DataFrame:
    """log2 of reads per kilobase (of length - 200, at least 1) less log2 of their sum per million, by sample."""
    rate = F.col(count) / (F.greatest(F.lit(1), F.col(length) - 200) / 1000.0)
    totals = counts.groupBy(sample).agg(F.sum(rate).alias("__t"))
    return counts.join(totals, sample).withColumn("log_expression", F.log2(rate) - F.log2(F.col("__t") / 1e6)).drop("__t")


def size_factors(counts: DataFrame, feature: str, sample: str, count: str) -> DataFrame:
    """A sample's factor is the median, over features that every sample has, of its count over their geometric mean."""
    logs = counts.filter(F.col(count) > 0).withColumn("__l", F.log(F.col(count).cast("double")))
    n = counts.agg(F.count_distinct(sample).alias("__n"))
    means = logs.groupBy(feature).agg(F.avg("__l").alias("__m"), F.count_distinct(sample).alias("__k")).crossJoin(F.broadcast(n)).filter("__k = __n")
    return logs.join(means, feature).groupBy(sample).agg(F.exp(F.percentile(F.col("__l") - F.col("__m"), 0.5)).alias("size_factor"))


def normalised_counts(counts: DataFrame, feature: str, sample: str, count: str) -> DataFrame:
    """Counts by size factor, and log2 of one more."""
    value = F.col(count) / F.col("size_factor")
    return counts.join(size_factors(counts, feature, sample, count), sample).withColumn("normalised", value).withColumn("log2", F.log2(value + 1))


def centre_batches(rows: DataFrame, feature: str, batch: str, value: str) -> DataFrame:
    """Each feature's batch means moved to its mean over the batches."""
    per = rows.groupBy(feature, batch).agg(F.avg(value).alias("__b"))
    over = per.groupBy(feature).agg(F.avg("__b").alias("__a"))
    return rows.join(per, [feature, batch]).join(over, feature).withColumn(value, F.col(value) - F.col("__b") + F.col("__a")).drop("__a", "__b")


def pair_dispersion(rows: DataFrame, genes: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """For every pair of samples the deviation of the log ratios of a set of genes."""
    kept = relational.whitelist(rows, genes, feature).filter(F.col(value) > 0).select(feature, sample, F.log2(value).alias("v"))
    a, b = kept.withColumnsRenamed({sample: "sample_a", "v": "x"}), kept.withColumnsRenamed({sample: "sample_b", "v": "y"})
    return a.join(b, feature).filter("sample_a < sample_b").groupBy("sample_a", "sample_b").agg(F.stddev_samp(F.col("x") - F.col("y")).alias("dispersion"), F.count("*").alias("genes"))


def exon_similarity(pairs: DataFrame) -> DataFrame:
    """Local score of two exons' sequences (seq1, seq2) over the shorter length."""
    scored = pairs.withColumn("score", align.align_column("seq1", "seq2")["score"])
    return scored.withColumn("similarity", F.col("score") / F.nullif(F.least(F.length("seq1"), F.length("seq2")), F.lit(0)))


def assign_by_junctions(reads: DataFrame, isoforms: DataFrame) -> DataFrame:
    """By the junction profile alone, coding isoforms only: none is contradictory, one unique, more ambiguous. Profiles that
    repeat are compared once; the isoforms are listed only where they are asked for."""
    kinds = isoforms.filter("is_coding").groupBy("gene_id", F.col("profile").alias("t")).agg(F.count("transcript_id").alias("n"), F.collect_list("transcript_id").alias("of"))
    pairs = reads.select("gene_id", "profile").distinct().join(kinds, "gene_id")
    fits = F.coalesce(pf.diff_only_present(F.col("profile"), F.col("t")) == 0, F.lit(False))
    judged = pairs.groupBy(F.col("gene_id").alias("g"), F.col("profile").alias("p")).agg(F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("n"), F.flatten(F.collect_list(F.when(fits, F.col("of")))).alias("of"))
    each = reads.join(judged, (F.col("gene_id") == F.col("g")) & F.col("profile").eqNullSafe(F.col("p")))
    out = each.groupBy("read_id", "gene_id").agg(F.array_sort(F.flatten(F.collect_list("of"))).alias("isoforms"), F.sum("n").alias("n"))
    kind = F.when(F.col("n") == 0, "contradictory").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return out.select("read_id", "gene_id", "isoforms", kind.alias("assignment_type"))


def ideal_isoforms(isoforms: DataFrame, codons: DataFrame, least: int = 2, weight: int = 1000) -> DataFrame:
    """Each coding isoform as a barcode of its own with its codon pair and a weight, of genes with enough distinct start
    codons and enough distinct stop codons."""
    rows = isoforms.filter("is_coding").join(codons, ["gene_id", "transcript_id"])
    wide = rows.groupBy("gene_id").agg(F.count_distinct("start_codon").alias("k"), F.count_distinct("stop_codon").alias("m")).filter((F.col("k") >= least) & (F.col("m") >= least))
    return relational.whitelist(rows, wide, "gene_id").select("gene_id", F.col("transcript_id").alias("barcode"), "start_codon", "stop_codon", F.lit(weight).alias("weight"))


def resolve_ambiguous(rows: DataFrame, isoforms: DataFrame) -> DataFrame:
    """Of several isoforms the first that the read's profile matches wherever the isoform's is not -1; else all stay."""
    each = rows.select("read_id", "gene_id", "profile", "isoforms", F.explode("isoforms").alias("transcript_id")).join(isoforms.select("gene_id", "transcript_id", F.col("profile").alias("t")), ["gene_id", "transcript_id"])
    clash = F.exists(F.zip_with("profile", "t", lambda x, y: (y != -1) & (x != y)), lambda c: c)
    best = each.groupBy("read_id", "gene_id").agg(F.min(F.when(~clash, F.col("transcript_id"))).alias("one"), F.first("isoforms").alias("isoforms"))
    return best.select("read_id", "gene_id", F.when(F.col("one").isNotNull(), F.array("one")).otherwise(F.col("isoforms")).alias("isoforms"))


def read_summary(reads: DataFrame, genes: DataFrame, samples: Sequence[str]) -> DataFrame:
    """TPM by gene and sample, wide, with the gene's length bin and whether it is spliced."""
    counts = reads.groupBy("gene_id", "sample").agg(F.count("*").alias("n"))
    totals = counts.groupBy("sample").agg(F.sum("n").alias("__t"))
    tpm = counts.join(totals, "sample").withColumn("tpm", F.col("n") * 1e6 / F.col("__t"))
    return relational.pivot_counts(tpm, "gene_id", "sample", samples, F.col("tpm")).join(genes.select("gene_id", "bin", "spliced"), "gene_id", "left")


def counts_by_chromosome(counts: Sequence[DataFrame], introns: DataFrame, names: Sequence[str]) -> DataFrame:
    """Several samples' counts joined to introns by place, all added alike; no row at a chromosome's start is lost."""
    tables = {n: c.groupBy(F.struct("chr", "start", "end").alias("place")).agg(F.sum("include").alias("n")) for n, c in zip(names, counts)}
    wide = relational.outer_counts(tables, "place", "n")
    return introns.join(wide, F.struct("chr", "start", "end") == F.col("place"), "left").drop("place").na.fill(0, list(names))
