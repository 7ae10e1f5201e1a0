"""Composite operators (inventory 2.14, 2.15, section 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import interval as iv
from strandlake.functions import profile as pf
from strandlake.functions import sequence as sq
from strandlake.operators import ordered, relational


def molecules(assignments: DataFrame, calls: DataFrame, max_distance: int = 2) -> DataFrame:
    """Entry point 2 (J1, W2, W1): reads with a gene and a called barcode, one record for each molecule: that with most
    exons, then the longest span, then the smallest read id."""
    reads = assignments.join(calls.select("read_id", "barcode", "umi", "valid_umi"), "read_id").filter((F.col("barcode") != "*") & F.col("gene_id").isNotNull())
    keys = ["gene_id", "barcode"]
    clusters = ordered.umi_clusters(reads.withColumn("n", F.lit(1).cast("long")), keys, "umi", "valid_umi", "n", "read_id", max_distance).select(*keys, "umi", "cluster")
    named = reads.join(clusters, [*keys, "umi"]).withColumns({"n_exons": F.size("exons"), "span": iv.length(iv.span(F.col("exons")))})
    return ordered.best_record(named, [*keys, "cluster"], F.desc("n_exons"), F.desc("span"), F.col("read_id"))


def to_allinfo(molecules: DataFrame) -> DataFrame:
    """The exchange table: introns and exons as region strings, known or novel, TSS and poly-A where events say so."""
    minus = F.col("strand") == "-"
    first, last = F.col("exons")[0]["start"], F.element_at("exons", -1)["end"]

    def site(pos: Column, event: str, none: str) -> Column:
        place = F.concat_ws("_", "chr", pos.cast("string"), pos.cast("string"), "strand")
        return F.when(F.contains("events", F.lit(event)), place).otherwise(none)

    introns = iv.junctions(F.col("exons"))
    kind = F.when(F.col("assignment_type").startswith("unique"), "known").otherwise("novel")
    return molecules.select("read_id", "gene_id", F.lit("None").alias("cell_type"), "barcode", "umi", iv.format_regions(F.col("chr"), introns, F.col("strand")).alias("introns"), site(F.when(minus, last).otherwise(first), "tss_match", "NoTSS").alias("tss"), site(F.when(minus, first).otherwise(last), "correct_polya", "NoPolyA").alias("polya"), iv.format_regions(F.col("chr"), F.col("exons"), F.col("strand")).alias("exons"), kind.alias("read_type"), F.size(introns).alias("n_introns"))


def call_snps(pileups: DataFrame, reference: DataFrame, min_freq: float = 0.2, factor: float = 2.0, min_cov: int = 50, keep_germline: bool = False) -> DataFrame:
    """Entry point 3 (G1, G1b, G2): pileups (sample, chr, pos, A, C, G, T) against reference (chr, pos, ref).

    A variant is reported if every sample is covered and its largest frequency reaches min_freq; it is germline if the
    smallest does too, or if that is above 0 and the largest is less than factor times it.
    """
    long = pileups.withColumn("cov", F.col("A") + F.col("C") + F.col("G") + F.col("T"))
    bases = F.array(*[F.struct(F.lit(b).alias("alt"), F.col(b).alias("reads")) for b in "ACGT"])
    cells = long.select("sample", "chr", "pos", "cov", F.inline(bases)).join(reference, ["chr", "pos"]).filter("alt != ref")
    freq = F.when(F.col("cov") > 0, F.col("reads") / F.col("cov")).otherwise(0.0)
    per = cells.groupBy("chr", "pos", "ref", "alt").agg(F.min("cov").alias("least_cov"), F.min(freq).alias("least"), F.max(freq).alias("most"), F.array_sort(F.collect_list(F.struct("sample", "cov", "reads"))).alias("samples"))
    found = per.filter((F.col("least_cov") >= min_cov) & (F.col("most") >= min_freq))
    out = found.withColumn("type", F.when(is_germline(F.col("least"), F.col("most"), min_freq, factor), "germline").otherwise("somatic"))
    return out if keep_germline else out.filter("type = 'somatic'")


def is_germline(least: Column, most: Column, min_freq: float, factor: float) -> Column:
    """G2."""
    return (least >= min_freq) | ((most >= min_freq) & (least > 0) & (most / least < factor))


def filter_snps(snps: DataFrame, gap: int = 10) -> DataFrame:
    """no neighbour within gap, no A>G or T>C (editing), no alternative that continues an A- or T-rich context."""
    kept = ordered.isolated(snps, ["chr"], "pos", "alt", gap)
    kept = kept.filter(~((F.col("ref") == "A") & (F.col("alt") == "G")) & ~((F.col("ref") == "T") & (F.col("alt") == "C")))
    if "context" not in snps.columns:
        return kept
    rich = lambda b: (sq.count_chars("context", b) * 2 >= F.length("context")) & (F.col("alt") == b)
    return kept.filter(~rich("A") & ~rich("T"))


def snp_matrix(snps: DataFrame, mean_fill: bool = False) -> DataFrame:
    """Frequency by variant and sample; null, or the mean of the covered samples, where there is no coverage."""
    long = snps.select("chr", "pos", "ref", "alt", F.inline("samples"))
    freq = F.when(F.col("cov") > 0, F.col("reads") / F.col("cov"))
    if mean_fill:
        freq = F.coalesce(freq, F.avg(freq).over(Window.partitionBy("chr", "pos", "alt")))
    return long.withColumn("freq", freq)


def coverage_filter(rows: DataFrame, key: str, cov: str, strategy: int, least: float) -> DataFrame:
    """1 all, 2 any, 3 the mean of the samples reach least."""
    how = {1: F.min(cov), 2: F.max(cov), 3: F.avg(cov)}[strategy]
    return relational.whitelist(rows, rows.groupBy(key).agg(how.alias("__x")).filter(F.col("__x") >= least), key)


def edited_positions(rows: DataFrame, min_g_cov: float) -> DataFrame:
    """RNA differs from DNA; the strand of A>G is the row's, T>C is the other one's A>G."""
    kept = rows.filter((F.col("g_coverage") >= min_g_cov) & ((F.col("subs") != F.col("g_subs")) | (F.col("frequency") > F.col("g_frequency"))))
    return kept.withColumn("strand", F.when(F.col("subs") == "TC", "-").otherwise(F.col("strand")))


def guide_calls(reads: DataFrame, min_umis: int = 1, guides: DataFrame | None = None) -> DataFrame:
    """Barcodes with one dominant guide by distinct UMIs.

    With guides (guide, seq), reads also have verified and guide_seq: one that is not verified counts for the guide whose
    sequence its own equals (the first by name), together with that guide's verified reads, and otherwise not at all.
    """
    if guides is not None:
        named = guides.groupBy(F.col("seq").alias("guide_seq")).agg(F.min("guide").alias("__guide"))
        rescued = reads.filter(~F.coalesce("verified", F.lit(False))).join(named, "guide_seq").select("barcode", F.col("__guide").alias("guide"), "umi")
        reads = reads.filter("verified").select("barcode", "guide", "umi").unionByName(rescued)
    support = reads.groupBy("barcode", "guide").agg(F.count_distinct("umi").alias("umis")).filter(F.col("umis") >= min_umis)
    return ordered.dominance(support, "barcode", "guide", "umis")


def gene_features(transcripts: DataFrame) -> DataFrame:
    """Distinct introns and split exons of each gene, sorted."""
    introns = transcripts.select("gene_id", F.explode_outer(iv.junctions(F.col("exons"))).alias("i")).groupBy("gene_id").agg(F.array_sort(F.collect_set("i")).alias("introns"))
    parts = ordered.split_segments(transcripts.select("gene_id", F.inline("exons")), ["gene_id"], "start", "end").groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("parts"))
    return introns.join(parts, "gene_id")


def assign_isoforms(reads: DataFrame, transcripts: DataFrame, delta: int = 0) -> DataFrame:
    """Section 3.4 (P1, P2, P5, P12-P14): reads (read_id, gene_id, blocks) against the isoforms of their gene.

    A read's junction profile is filled between its ends; an isoform matches if no covered place contradicts it. One match
    is unique, several are ambiguous, none is contradictory; reads without a covered junction are matched by exon parts.
    """
    genes = gene_features(transcripts)
    own_introns = transcripts.withColumn("own", iv.junctions(F.col("exons"))).join(genes, "gene_id").select("gene_id", "transcript_id", pf.one_hot(F.col("own"), F.col("introns"), exact=True).alias("t_introns"), pf.one_hot(F.col("exons"), F.col("parts")).alias("t_parts"))
    # What is the same for all features of a read is a column before the join, and places of profiles are columns before they
    # are used: within a function of array elements they would be computed for each.
    own = reads.select("read_id", "gene_id", "blocks", iv.junctions(F.col("blocks")).alias("__j"), iv.span(F.col("blocks")).alias("__c"))
    covers = F.col("__c")
    by_intron = F.transform("introns", lambda f: F.when(F.exists("__j", lambda j: iv.equal_ranges(j, f, delta)), 1).when(iv.overlaps(covers, f) & iv.contains(covers, f), -1).otherwise(0))
    by_part = F.transform("parts", lambda f: F.when(F.exists("blocks", lambda b: iv.intersection_length(b, f) * 2 > iv.length(f)), 1).when(iv.contains(covers, f), -1).otherwise(0))
    r = own.join(genes, "gene_id").select("read_id", "gene_id", by_intron.alias("i"), by_part.alias("p"))
    r = r.withColumns({"i_ends": pf.ends(F.col("i")), "p_ends": pf.ends(F.col("p"))})
    filled = [pf.fill_between(F.col(c), F.col(f"{c}_ends.first"), F.col(f"{c}_ends.last")).alias(n) for c, n in (("i", "r_introns"), ("p", "r_parts"))]
    r = r.select("read_id", "gene_id", *filled)
    pairs = r.join(own_introns, "gene_id").withColumns({"d_introns": pf.diff_only_present(F.col("r_introns"), F.col("t_introns")), "d_parts": pf.diff_only_present(F.col("r_parts"), F.col("t_parts"))})
    spliced = F.exists("r_introns", lambda x: x != 0)
    fits = F.when(spliced, F.col("d_introns") == 0).otherwise(F.col("d_parts") == 0)
    both = fits & (F.col("d_parts") == 0)
    out = pairs.groupBy("read_id", "gene_id").agg(F.array_sort(F.collect_list(F.when(both, F.col("transcript_id")))).alias("full"), F.array_sort(F.collect_list(F.when(fits, F.col("transcript_id")))).alias("fit"))
    ids = F.when(F.size("full") == 1, F.col("full")).otherwise(F.col("fit"))
    kind = F.when(F.size("full") == 1, "unique").when(F.size("fit") == 1, "unique_intron").when(F.size("fit") > 1, "ambiguous").otherwise("contradictory")
    return out.select("read_id", "gene_id", ids.alias("isoforms"), kind.alias("assignment_type"))


def ambiguous_isoforms(profiles: DataFrame) -> DataFrame:
    """Isoforms whose profile is part of another's of the gene (never of their own). Profiles that repeat are compared once: a
    profile that is part of others needs only the least and the greatest of their isoforms, to know that one is another."""
    kinds = profiles.groupBy("gene_id", "profile").agg(F.min("transcript_id").alias("low"), F.max("transcript_id").alias("high"))
    pairs = kinds.select("gene_id", F.col("profile").alias("x")).join(kinds.withColumnRenamed("profile", "y"), "gene_id")
    found = pairs.filter(pf.is_subprofile(F.col("x"), F.col("y"))).groupBy("gene_id", "x").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    rows = profiles.select("gene_id", "transcript_id", F.col("profile").alias("x")).join(found, ["gene_id", "x"])
    return rows.filter((F.col("low") != F.col("transcript_id")) | (F.col("high") != F.col("transcript_id"))).select("gene_id", "transcript_id").distinct()


def consensus_profiles(rows: DataFrame, key: str, profile: str, ratio: int = 5, min_reads: int = 1) -> DataFrame:
    """Place by place: 1 or -1 where only that sign occurs or it outweighs the other ratio times, 0 where none
    does; a key with a place that neither wins is dropped."""
    votes = rows.select(key, F.posexplode(profile).alias("i", "v")).groupBy(key, "i").agg(F.count_if(F.col("v") > 0).alias("plus"), F.count_if(F.col("v") < 0).alias("minus"))
    plus, minus = F.col("plus"), F.col("minus")
    vote = F.when((plus == 0) & (minus == 0), 0).when((minus == 0) | (plus >= ratio * minus), 1).when((plus == 0) | (minus >= ratio * plus), -1)
    per = votes.withColumn("v", vote).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(profile), F.bool_or(F.col("v").isNull()).alias("__bad"), F.min(F.when(plus + minus > 0, plus + minus)).alias("support"))
    reads = rows.groupBy(key).agg(F.count("*").alias("coverage"))
    return per.filter("not __bad").drop("__bad").join(reads, key).filter(F.col("coverage") >= min_reads)


def codon_pairs(features: DataFrame) -> DataFrame:
    """Start and stop codon positions of each transcript, from its codons or else from the coding ends."""
    cds = features.filter("feature = 'CDS'").groupBy("gene_id", "transcript_id", "strand").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    own = features.filter("feature in ('start_codon', 'stop_codon')").groupBy("transcript_id").pivot("feature", ["start_codon", "stop_codon"]).agg(F.min("start"))
    minus = F.col("strand") == "-"
    both = cds.join(own, "transcript_id", "left")
    return both.select("gene_id", "transcript_id", F.coalesce("start_codon", F.when(minus, F.col("high") - 2).otherwise(F.col("low"))).alias("start_codon"), F.coalesce("stop_codon", F.when(minus, F.col("low")).otherwise(F.col("high") - 2)).alias("stop_codon"))


def codon_tables(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Counts by codon pair, of genes with at least two starts and two stops."""
    counts = pairs.groupBy("gene_id", "start_codon", "stop_codon").agg(F.count("*").alias("n"))
    wide = counts.groupBy("gene_id").agg(F.count_distinct("start_codon").alias("s"), F.count_distinct("stop_codon").alias("t")).filter((F.col("s") >= least) & (F.col("t") >= least))
    return relational.whitelist(counts, wide, "gene_id")


def exon_classes(features: DataFrame) -> DataFrame:
    """For each exon of a gene whether it is coding or holds a codon, and the largest coding share."""
    exons = features.filter("feature = 'exon'").select("gene_id", "transcript_id", "chr", "start", "end", "strand")
    coding = features.filter("feature = 'CDS'").select("transcript_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    hit = exons.join(coding, "transcript_id", "left").withColumn("shared", F.greatest(F.lit(0), F.least("end", "c_end") - F.greatest("start", "c_start") + 1))
    return hit.groupBy("gene_id", "chr", "start", "end", "strand").agg(F.bool_or(F.coalesce(F.col("shared") > 0, F.lit(False))).alias("is_cds"), F.coalesce(F.max(F.col("shared") / (F.col("end") - F.col("start") + 1)), F.lit(0.0)).alias("coding_share"), F.count_distinct("transcript_id").alias("n_transcripts"))


def alternative_sites(transcripts: DataFrame) -> DataFrame:
    """Introns of a gene that share one end but not the other; the strand says donor or acceptor. Both
    strands are treated alike."""
    introns = transcripts.select("gene_id", "strand", F.inline(iv.junctions(F.col("exons")))).distinct()
    shared_start = introns.groupBy("gene_id", "strand", "start").agg(F.array_sort(F.collect_set("end")).alias("sites")).filter("size(sites) > 1").select("gene_id", "strand", F.col("start").alias("anchor"), "sites", F.when(F.col("strand") == "-", "donor").otherwise("acceptor").alias("kind"))
    shared_end = introns.groupBy("gene_id", "strand", "end").agg(F.array_sort(F.collect_set("start")).alias("sites")).filter("size(sites) > 1").select("gene_id", "strand", F.col("end").alias("anchor"), "sites", F.when(F.col("strand") == "-", "acceptor").otherwise("donor").alias("kind"))
    return shared_start.unionByName(shared_end)


def misassembled(alignments: DataFrame, most_shared: float = 0.2) -> DataFrame:
    """Contigs whose primary and a supplementary alignment lie on different references with little query overlap."""
    a = alignments.filter("is_primary").select("contig", F.col("chr").alias("c1"), F.struct(F.col("q_start").alias("start"), F.col("q_end").alias("end")).alias("p"))
    b = alignments.filter("not is_primary").select("contig", F.col("chr").alias("c2"), F.struct(F.col("q_start").alias("start"), F.col("q_end").alias("end")).alias("s"))
    return a.join(b, "contig").filter((F.col("c1") != F.col("c2")) & (iv.overlap_fraction(F.col("p"), F.col("s")) <= most_shared)).select("contig").distinct()


def utr_classes(counts: DataFrame) -> DataFrame:
    """Genes with exactly two poly-A sites of which each group prefers another; counts (gene_id, polya, grp, n)."""
    two = counts.groupBy("gene_id").agg(F.count_distinct("polya").alias("k")).filter("k = 2")
    best = relational.whitelist(counts, two, "gene_id").groupBy("gene_id", "grp").agg(F.max_by("polya", F.struct("n", "polya")).alias("polya"))
    return best.groupBy("gene_id").agg(F.count_distinct("polya").alias("k"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "polya")))).alias("preferred")).filter("k = 2").drop("k")


def tool_consensus(rows: DataFrame, key: str, tool: str, tools: list[str]) -> DataFrame:
    """For each tool how many features all have, all but one, only it, and all but it."""
    sets = rows.groupBy(key).agg(F.collect_set(tool).alias("t"))
    n = len(tools)
    return sets.select(F.explode(F.array(*[F.lit(t) for t in tools])).alias("tool"), "t").groupBy("tool").agg(F.count_if((F.size("t") == n) & F.array_contains("t", F.col("tool"))).alias("all_tools"), F.count_if((F.size("t") == n - 1) & F.array_contains("t", F.col("tool"))).alias("all_but_one"), F.count_if((F.size("t") == 1) & F.array_contains("t", F.col("tool"))).alias("only_it"), F.count_if((F.size("t") == n - 1) & ~F.array_contains("t", F.col("tool"))).alias("missed"))


def classify_codes(tracking: DataFrame) -> DataFrame:
    """Known for the exact match code, novel for the splice variants, else undefined."""
    return tracking.withColumn("kind", F.when(F.col("class_code") == "=", "known").when(F.col("class_code").isin("j", "k", "n", "m", "o"), "novel").otherwise("undefined"))


def simulate_reads(templates: DataFrame, total: int, chemistry: str, barcodes: int, umi: int, seed: int) -> DataFrame:
    """ceil(tpm * total / 1e6) reads of each template (transcript_id, seq, tpm) with repeatable random barcode (of
    `barcodes` different ones) and UMI; the id tells the truth."""
    n = F.ceil(F.col("tpm") * total / 1e6)
    rows = templates.select("transcript_id", "seq", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("i"))
    size = 16 if chemistry == "10x" else 14

    def bases(salt: int, length: int, *key: str) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed + salt)), *[F.col(k).cast("string") for k in key]))
        return F.substring(F.translate(digest, "0123456789abcdef", "ACGT" * 4), 1, length)

    rows = rows.withColumn("b", F.floor(ordered.uniform(seed, "transcript_id", "i") * barcodes))
    rows = rows.withColumns({"barcode": bases(1, size, "b"), "umi": bases(2, umi, "transcript_id", "i")})
    return rows.select(F.concat_ws("_", F.lit("READ"), "i", "transcript_id", "barcode", "umi", F.lit("+")).alias("read_id"), sq.template(F.col("seq"), F.col("barcode"), F.col("umi"), chemistry).alias("seq"), "transcript_id", "barcode", "umi")
