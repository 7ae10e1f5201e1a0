"""Sinks (inventory 2.2): Spark's writers, partitioned by key where one file for each key is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ordered import uniform


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated, a file for each partition."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=header, quote="")


def write_by_key(rows: DataFrame, path: str, *keys: str, min_rows: int = 0, fmt: str = "parquet") -> None:
    """A folder for each key (levels), only keys with enough rows."""
    if min_rows:
        common = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_rows)
        rows = rows.join(common.select(*keys), list(keys), "left_semi")
    rows.write.mode("overwrite").partitionBy(*keys).format(fmt).save(path)


def fastq_lines(reads: DataFrame) -> DataFrame:
    """K9: one text value for each record."""
    return reads.filter("seq is not null").select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value"))


def fasta_lines(reads: DataFrame, key: str = "read_id") -> DataFrame:
    """K10, E11."""
    return reads.filter("seq is not null").select(F.concat(F.lit(">"), key, F.lit("\n"), "seq").alias("value"))


def bed12_lines(transcripts: DataFrame) -> DataFrame:
    """0-based starts, block sizes and starts; thick is the coding range where it is known."""
    first, last = F.col("exons")[0]["start"] - 1, F.element_at("exons", -1)["end"]
    sizes = F.array_join(F.transform("exons", lambda e: (e["end"] - e["start"] + 1).cast("string")), ",")
    starts = F.array_join(F.transform("exons", lambda e: (e["start"] - 1 - first).cast("string")), ",")
    thick = [F.coalesce(F.col(c), d) if c in transcripts.columns else d for c, d in (("cds_start", first), ("cds_end", last))]
    fields: list[Column] = [F.col("chr"), first, last, F.col("transcript_id"), F.lit(1000), F.col("strand"), *thick, F.lit("0,0,0"), F.size("exons"), sizes, starts]
    return transcripts.select(F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value"))


def bed6(features: DataFrame) -> DataFrame:
    """Genes only; the name falls back to the id, then '.', the score '.' is 0."""
    return features.filter("feature = 'gene'").select("chr", (F.col("start") - 1).alias("start"), "end", F.coalesce("gene_name", "gene_id", F.lit(".")).alias("name"), F.when(F.col("score") == ".", "0").otherwise(F.col("score")).alias("score"), "strand")


def gtf_lines(features: DataFrame) -> DataFrame:
    """In annotation order: gene, then its transcripts, then their parts."""
    level = F.when(F.col("feature") == "gene", 0).when(F.col("feature") == "transcript", 1).otherwise(2)
    ordered = features.orderBy("chr", "gene_id", F.col("transcript_id").asc_nulls_first(), level, "start", "end")
    return ordered.select(F.concat_ws("\t", "chr", "source", "feature", F.col("start").cast("string"), F.col("end").cast("string"), "score", "strand", "frame", "attributes").alias("value"))


def tag_reads(alignments: DataFrame, calls: DataFrame, suffix: str = "-1") -> DataFrame:
    """Barcode and UMI tags of called reads, and whether the alignment is spliced."""
    tagged = alignments.join(calls.select("read_id", "barcode", "umi"), "read_id")
    new = F.create_map(F.lit("CR"), "barcode", F.lit("CY"), F.repeat(F.lit("I"), F.length("barcode")), F.lit("CB"), F.concat("barcode", F.lit(suffix)), F.lit("UR"), "umi", F.lit("UB"), "umi", F.lit("UY"), F.repeat(F.lit("I"), F.length("umi")), F.lit("SP"), F.when(F.contains("cigar", F.lit("N")), "1").otherwise("0"))
    old = F.map_filter("tags", lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return tagged.withColumn("tags", F.map_concat(old, new)).drop("barcode", "umi")


def rename_reference(name: Column) -> Column:
    """MT is chrM; names without a dot get chr in front."""
    return F.when(name.isin("MT", "chrMT"), "chrM").when(F.contains(name, F.lit(".")) | name.startswith("chr"), name).otherwise(F.concat(F.lit("chr"), name))


def strand_tag(ts: Column, flag: Column) -> Column:
    """The transcript strand as seen on the reference: turned on reverse alignments, '?' if unknown."""
    turned = F.when(ts == "+", "-").when(ts == "-", "+")
    return F.coalesce(F.when(flag.bitwiseAND(16) != 0, turned).when(ts.isin("+", "-"), ts), F.lit("?"))


def read_groups(rows: DataFrame, groups: int, seed: int, key: str) -> DataFrame:
    """A repeatable group in [0, groups) for each row."""
    return rows.withColumn("rg", F.floor(uniform(seed, key) * groups).cast("int"))


def wide_samples(rows: DataFrame, keys: list[str], sample: str, samples: list[str]) -> DataFrame:
    """TOTAL, READS and FREQ of each sample, 0 where it is not covered."""
    wide = rows.groupBy(*keys).pivot(sample, samples).agg(F.sum("cov").alias("TOTAL"), F.sum("reads").alias("READS"))
    out = []
    for s in samples:
        total, reads = F.coalesce(F.col(f"`{s}_TOTAL`"), F.lit(0)), F.coalesce(F.col(f"`{s}_READS`"), F.lit(0))
        out += [total.alias(f"{s}_TOTAL"), reads.alias(f"{s}_READS"), F.when(total == 0, 0.0).otherwise(F.round(reads / total, 2)).alias(f"{s}_FREQ")]
    return wide.select(*keys, *out)


def json_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object for each group of 256 keys' hash, so no task holds the whole map."""
    part = F.pmod(F.xxhash64(key), F.lit(256))
    return rows.groupBy(part.alias("part")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("value"))
