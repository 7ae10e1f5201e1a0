"""Readers of sequencing formats into typed DataFrames (inventory 2.1). Text is read by Spark's own readers; records of
several lines are put together by line number, which comes from the splits' order in their file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import interval as iv

#: Columns of the tables that tools exchange.
CALLS = "read_id string, barcode string, umi string, bc_score int, valid_umi boolean, strand string"
LEGACY_CALLS = "read_id string, polyt int, primer int, linker_start int, linker_end int, strand string, barcode string, umi string, bc_score int, umi_good boolean"
ASSIGNMENTS = "read_id string, chr string, strand string, isoform_id string, gene_id string, assignment_type string, events string, exons string, attributes string"
ALLINFO = "read_id string, gene_id string, cell_type string, barcode string, umi string, introns string, tss string, polya string, exons string, read_type string, n_introns int, transcript_id string"


def detect_format(path: str) -> str:
    """Fasta, fastq, sam or bam by the name without .gz; ValueError else (CRAM has no reader)."""
    name = path.lower().removesuffix(".gz").removesuffix(".gzip")
    for kind, ends in {"fasta": (".fasta", ".fa", ".fna"), "fastq": (".fastq", ".fq"), "sam": (".sam",), "bam": (".bam",)}.items():
        if name.endswith(ends):
            return kind
    raise ValueError(f"unknown format: {path}")


def _records(spark: SparkSession, path: str, first: str) -> DataFrame:
    """Records that start with a character, each as its text; multi-line records are cut by the separator."""
    return spark.read.option("lineSep", f"\n{first}").text(path).select(F.regexp_replace("value", f"^{first}", "").alias("record")).filter(F.length(F.trim("record")) > 0)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Id (to the first white space), description, seq; sequences may span lines."""
    lines = F.split(F.col("record"), r"\r?\n")
    head = lines[0]
    return _records(spark, path, ">").select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("seq"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0) and value of text files of any size. Lines are counted by split, splits are put in order by their
    place in the file, and a line's number is its split's offset plus its place there: no task reads a whole file unless it
    is compressed."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    offsets = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def read_fastq(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """read_id, seq, qual of four-line records, put together by line number, as a quality line may begin with '@'.
    mode DROPMALFORMED leaves out records without '@' or '+', FAILFAST raises; a truncated last record is left out."""
    lines = numbered_lines(spark, path)
    part = [F.max(F.when(F.col("line") % 4 == i, F.regexp_replace("value", "\r$", ""))).alias(n) for i, n in enumerate(("head", "seq", "plus", "qual"))]
    records = lines.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(*part)
    bad = F.raise_error(F.concat(F.lit("malformed record "), F.col("record").cast("string"), F.lit(" of "), "file")).cast("boolean") if mode == "FAILFAST" else F.lit(False)
    good = F.when(F.col("qual").isNull(), False).when(F.col("head").startswith("@") & F.col("plus").startswith("+"), True).otherwise(bad)
    return records.filter(good).select(F.regexp_extract("head", r"^@(\S*)", 1).alias("read_id"), "seq", "qual")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text, start 0-based, tags as a map of name -> value."""
    f = F.split(F.col("value"), "\t")
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v"))))
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.size(f) >= 11))
    out = rows.select(f[0].alias("read_id"), f[1].cast("int").alias("flag"), F.nullif(f[2], F.lit("*")).alias("chr"), (f[3].cast("long") - 1).alias("start"), f[4].cast("int").alias("mapq"), F.nullif(f[5], F.lit("*")).alias("cigar"), F.nullif(f[9], F.lit("*")).alias("seq"), F.nullif(f[10], F.lit("*")).alias("qual"), tags.alias("tags"))
    return out.withColumn("blocks", iv.cigar_blocks(F.col("start"), F.col("cigar")))


def region(alignments: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Alignments that touch a closed 1-based region."""
    last = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["end"])), F.col("start") + 1)
    return alignments.filter((F.col("chr") == chrom) & (F.col("start") < end) & (last >= start))


def pileup(alignments: DataFrame) -> DataFrame:
    """Counts of A, C, G, T by chr and 1-based position; deletions, skips and N do not count."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    cut = F.transform(ops, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
    zero = F.struct((F.col("start") + 1).cast("long").alias("pos"), F.lit(1).alias("at"), F.array().cast("array<struct<pos:bigint,at:int,n:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        on_ref, on_read = x["op"].isin("M", "=", "X", "D", "N"), x["op"].isin("M", "=", "X", "I", "S")
        both = F.when(on_ref & on_read, F.concat(s["out"], F.array(F.struct(s["pos"].alias("pos"), s["at"].alias("at"), x["n"].alias("n"))))).otherwise(s["out"])
        return F.struct((s["pos"] + F.when(on_ref, x["n"]).otherwise(0)).cast("long").alias("pos"), (s["at"] + F.when(on_read, x["n"]).otherwise(0)).cast("int").alias("at"), both.alias("out"))

    matched = alignments.filter(F.col("cigar").isNotNull() & F.col("seq").isNotNull()).select("chr", "seq", F.explode(F.aggregate(cut, zero, step, lambda s: s["out"])).alias("m"))
    bases = matched.select("chr", F.explode(F.transform(F.sequence(F.lit(0), F.col("m.n") - 1), lambda i: F.struct((F.col("m.pos") + i).alias("pos"), F.upper(F.substring(F.col("seq"), F.col("m.at") + i, F.lit(1))).alias("base")))).alias("b"))
    return bases.groupBy("chr", F.col("b.pos").alias("pos")).agg(*[F.count_if(F.col("b.base") == x).alias(x) for x in "ACGT"])


def _tsv(spark: SparkSession, path: str | list[str], schema: str, comment: str = "#") -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", comment=comment, quote="", emptyValue="")


def read_calls(spark: SparkSession, path: str, legacy: bool = False) -> DataFrame:
    """Barcode calls; ids without a leading '@', rows without a barcode left out."""
    rows = _tsv(spark, path, LEGACY_CALLS if legacy else CALLS)
    return rows.withColumn("read_id", F.regexp_replace("read_id", "^@", "")).filter(F.col("barcode") != "*")


def read_assignments(spark: SparkSession, path: str, unique_polya: bool = False) -> DataFrame:
    """Exons as intervals; unique_polya keeps unique assignments with a poly-A."""
    rows = _tsv(spark, path, ASSIGNMENTS).withColumn("exons", iv.parse_blocks(F.coalesce("exons", F.lit(""))))
    return rows.filter(F.col("assignment_type").startswith("unique") & F.col("attributes").contains("PolyA=True")) if unique_polya else rows


def read_allinfo(spark: SparkSession, path: str) -> DataFrame:
    """11 to 13 columns; of repeated reads the last line counts."""
    rows = _tsv(spark, path, ALLINFO).withColumn("__line", F.monotonically_increasing_id())
    w = Window.partitionBy("read_id").orderBy(F.desc("__line"))
    last = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__line")
    return last.withColumns({c: iv.parse_regions(F.coalesce(c, F.lit(""))) for c in ("introns", "exons")})


def gtf_attribute(name: str, column: str = "attributes") -> Column:
    """The quoted value of an attribute; null if it is not there."""
    return F.nullif(F.regexp_extract(column, f'(?:^|;)\\s*{name} "([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Features with gene_id, transcript_id and gene_name; a parquet table of them, by feature, is what a
    feature database is here, and its hierarchy an equi-join on the ids."""
    rows = _tsv(spark, path, "chr string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string")
    return rows.withColumns({n: gtf_attribute(n) for n in ("gene_id", "transcript_id", "gene_name")})


def transcript_genes(features: DataFrame) -> DataFrame:
    """S20, S21, S44."""
    return features.filter((F.col("feature") == "transcript") & F.col("gene_id").isNotNull() & F.col("transcript_id").isNotNull()).select("transcript_id", "gene_id")


def transcripts(features: DataFrame) -> DataFrame:
    """Exons of each transcript, sorted."""
    exons = features.filter("feature = 'exon'")
    return exons.groupBy("gene_id", "transcript_id", "chr", "strand").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("exons"))


def repair_gtf(features: DataFrame) -> DataFrame:
    """Lines without ids are dropped; a transcript id that repeats gets a suffix .n, one that equals its gene's gets .t."""
    kept = features.filter(F.col("gene_id").isNotNull() & ((F.col("feature") == "gene") | F.col("transcript_id").isNotNull()))
    same = F.when(F.col("transcript_id") == F.col("gene_id"), F.concat("transcript_id", F.lit(".t"))).otherwise(F.col("transcript_id"))
    w = Window.partitionBy("feature", "transcript_id").orderBy("chr", "start", "end", "attributes")
    n = F.when(F.col("feature") == "transcript", F.row_number().over(w)).otherwise(1)
    return kept.withColumn("transcript_id", same).withColumn("__n", n).withColumn("transcript_id", F.when(F.col("__n") > 1, F.concat_ws(".", "transcript_id", "__n")).otherwise(F.col("transcript_id"))).drop("__n")


def read_vcf(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """Single-base variants, one row for each sample, with ref and alt reads from AD; chr prefix taken off."""
    f = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.regexp_replace(f[0], "^chr", "").alias("chr"), f[1].cast("long").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), F.split(f[8], ":").alias("format"), F.posexplode(F.slice(f, 10, len(samples))).alias("i", "cell"))
    ad = F.split(F.get(F.split("cell", ":"), (F.array_position("format", "AD") - 1).cast("int")), ",")
    reads = [F.coalesce(F.get(ad, j).try_cast("long"), F.lit(0)) for j in (0, 1)]
    names = F.array(*[F.lit(s) for s in samples])
    return rows.filter((F.length("ref") == 1) & (F.length("alt") == 1)).select("chr", "pos", "id", "ref", "alt", F.get(names, F.col("i")).alias("sample"), reads[0].alias("ref_reads"), reads[1].alias("alt_reads"))


def read_varscan(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """Sample cells from column 10, fields 2 and 3 are reads, '-' is 0."""
    f = F.split(F.col("value"), "\t")
    rows = spark.read.text(path).filter(~F.col("value").rlike("^(Chrom|#)")).select(f[0].alias("chr"), f[1].cast("long").alias("pos"), f[2].alias("ref"), f[3].alias("alt"), F.posexplode(F.slice(f, 11, len(samples))).alias("i", "cell"))
    cell = F.split("cell", ":")
    names = F.array(*[F.lit(s) for s in samples])
    return rows.select("chr", "pos", "ref", "alt", F.get(names, F.col("i")).alias("sample"), *[F.coalesce(F.get(cell, j).try_cast("long"), F.lit(0)).alias(n) for j, n in ((2, "ref_reads"), (3, "alt_reads"))])


def read_snp_matrix(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """Wide rows with three columns for each sample, made long."""
    rows = spark.read.csv(path, sep="\t", header=True)
    c = rows.columns
    cells = F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{c[5 + 3 * i]}`").cast("long").alias("cov"), F.col(f"`{c[6 + 3 * i]}`").cast("long").alias("reads"), F.col(f"`{c[7 + 3 * i]}`").cast("double").alias("freq")) for i, s in enumerate(samples)])
    return rows.select(*[F.col(f"`{x}`") for x in c[:5]], F.inline(cells))


def read_mex(spark: SparkSession, folder: str) -> DataFrame:
    """feature_id, feature_name, barcode, count of a 10x matrix folder, kept long."""
    lines = numbered_lines(spark, f"{folder}/matrix.mtx*").filter(~F.col("value").startswith("%"))
    f = F.split(F.col("value"), " ")
    size = lines.agg(F.min("line")).first()[0]  # the first line that is no comment holds the three sizes
    cells = lines.filter(F.col("line") > F.lit(size)).select(f[0].cast("long").alias("i"), f[1].cast("long").alias("j"), f[2].cast("double").alias("count"))
    return cells.join(_numbered(spark, f"{folder}/features.tsv*").select(F.col("n").alias("i"), F.split("value", "\t")[0].alias("feature_id"), F.split("value", "\t")[1].alias("feature_name")), "i").join(_numbered(spark, f"{folder}/barcodes.tsv*").select(F.col("n").alias("j"), F.col("value").alias("barcode")), "j").select("feature_id", "feature_name", "barcode", "count")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a small file with their numbers from 1."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("n", "value")).select((F.col("n") + 1).cast("long").alias("n"), "value")


def read_reditools(spark: SparkSession, path: str) -> DataFrame:
    """Unparsable numbers are 0."""
    f = F.split(F.col("value"), "\t")
    num = {"coverage": 4, "frequency": 8, "g_coverage": 9, "g_frequency": 13}
    rows = spark.read.text(path).filter(~F.col("value").startswith("Region"))
    return rows.select(f[0].alias("chr"), f[1].cast("long").alias("pos"), f[3].alias("strand"), F.get(f, 7).alias("subs"), F.get(f, 12).alias("g_subs"), *[F.coalesce(F.get(f, i).try_cast("double"), F.lit(0.0)).alias(n) for n, i in num.items()])


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """Class code, reference transcript and query transcript."""
    f = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(f[3].alias("class_code"), F.get(F.split(f[2], r"\|"), 1).alias("ref_id"), F.get(F.split(F.get(f, 4), r"\|"), 1).alias("query_id"))


def read_log(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row, a column for each named pattern's first group, null where no line matches."""
    lines = spark.read.text(path)
    return lines.agg(*[F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit(""))).alias(n) for n, p in patterns.items()])


def parse_homologies(rows: DataFrame, column: str) -> DataFrame:
    """Paralog records of a JSON answer; missing strings are empty, missing numbers 0."""
    part = "struct<id:string,species:string,perc_id:double>"
    schema = f"struct<data:array<struct<id:string,homologies:array<struct<type:string,source:{part},target:{part}>>>>>"
    h = F.from_json(column, schema)
    out = rows.select(F.explode_outer(h["data"][0]["homologies"]).alias("h"))
    return out.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in (("h.type", "type"), ("h.source.id", "source_id"), ("h.target.id", "target_id"), ("h.target.species", "species"))], F.coalesce("h.target.perc_id", F.lit(0.0)).alias("perc_id"))


def read_samplesheet(spark: SparkSession, path: str) -> DataFrame:
    """Two columns are single reads, three are pairs; other rows raise."""
    f = F.split(F.col("value"), "\t")
    n = F.size(f)
    layout = F.when(n == 2, "single").when(n == 3, "paired").otherwise(F.raise_error(F.concat(F.lit("bad sample line: "), "value")))
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(f[0].alias("sample"), f[1].alias("reads1"), F.get(f, 2).alias("reads2"), layout.alias("layout"))


def codon_structures(spark: SparkSession, path: str) -> DataFrame:
    """Four lines for each gene: header, starts, stops, pairs."""
    lines = _numbered(spark, path)
    group = lines.groupBy(F.floor((F.col("n") - 1) / 4).alias("g")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("l"))
    ints = lambda i: F.transform(F.filter(F.split(F.col("l")[i]["value"], "\t"), lambda x: x != ""), lambda x: x.cast("long"))
    head = F.split(F.col("l")[0]["value"], "\t")
    return group.select(head[0].alias("chr"), head[1].alias("gene"), head[2].alias("strand"), ints(1).alias("starts"), ints(2).alias("stops"), ints(3).alias("pairs"))


def read_lengths(reads: DataFrame, seq: str = "seq") -> DataFrame:
    """S45."""
    return reads.select(F.length(seq).alias("length")).orderBy("length")


def sequence_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Id and length of every record of a FASTA file."""
    return read_fasta(spark, path).select("id", F.length("seq").alias("length"))


def line_count(spark: SparkSession, path: str) -> int:
    """S31."""
    return spark.read.text(path).count()


def blaze_ids(reads: DataFrame, header: str = "description") -> DataFrame:
    """Barcode, umi part, original id and the barcode the simulator put into it."""
    pattern = r"^([ACGT]{16})_([^#]*)#(.*)$"
    original = F.regexp_extract(header, pattern, 3)
    return reads.select(F.regexp_extract(header, pattern, 1).alias("barcode"), F.regexp_extract(header, pattern, 2).alias("umi"), original.alias("read_id"), F.coalesce(F.get(F.split(original, "_"), 3), F.lit("*")).alias("truth"))
