"""Generators (inventory 2.13): repeatable by hash, so the same rows whatever the partitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.ordered import uniform


def normal(seed: int, *keys: str) -> Column:
    """A repeatable standard normal number (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))


def random_sequences(spark: SparkSession, n: int, length: int, seed: int, tail: int = 0) -> DataFrame:
    """N sequences of A, C, G, T, the last `tail` places without T."""
    def base(i: Column) -> Column:
        letters = F.when(i > length - tail, F.lit("ACG")).otherwise(F.lit("ACGT"))
        return F.substring(letters, (F.floor(uniform(seed, "id", i) * F.length(letters)) + 1).cast("int"), F.lit(1))
    return spark.range(n).withColumn("seq", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), base), ""))


def edit_distance_sample(spark: SparkSession, n: int, length: int, seed: int) -> DataFrame:
    """Edit distances of n random pairs, counted."""
    a = random_sequences(spark, n, length, seed).withColumnRenamed("seq", "a")
    b = random_sequences(spark, n, length, seed + 1).withColumnRenamed("seq", "b")
    return a.join(b, "id").groupBy(F.levenshtein("a", "b").alias("distance")).agg(F.count("*").alias("n"))


def ideal_counts(features: DataFrame, count: int = 1) -> DataFrame:
    """The same count and TPM for every feature."""
    n = features.agg(F.count("*").alias("__n"))
    return features.crossJoin(F.broadcast(n)).withColumns({"count": F.lit(count), "tpm": 1e6 / F.col("__n")}).drop("__n")


def gamma_counts(features: DataFrame, key: str, seed: int, shape: float = 0.7, scale: float = 200.0) -> DataFrame:
    """Integer gamma draws, repeatable by key."""
    @F.pandas_udf("long")
    def draw(u: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([int(np.random.default_rng(int(x) & 0xFFFFFFFFFFFF).gamma(shape, scale)) for x in u], dtype="int64")

    return features.withColumn("count", draw(F.xxhash64(F.lit(seed), key)))


def perturb_ends(transcripts: DataFrame, seed: int, share: float, low: int = 50, high: int = 300, at_polya: bool = True) -> DataFrame:
    """Copies of some transcripts whose terminal exon ends elsewhere; a shift that leaves no exon goes the other
    way. Poly-A ends by strand, or transcription starts."""
    chosen = transcripts.filter(uniform(seed, "transcript_id") < share)
    size = F.floor(low + uniform(seed + 1, "transcript_id") * (high - low + 1)).cast("long") * F.when(uniform(seed + 2, "transcript_id") < 0.5, -1).otherwise(1)
    at_end = (F.col("strand") != "-") == F.lit(at_polya)
    first, last = F.col("exons")[0], F.element_at("exons", -1)
    shift = F.when(at_end, F.when(last["end"] + size > last["start"], size).otherwise(-size)).otherwise(F.when(first["start"] + size < first["end"], size).otherwise(-size))
    n = F.size("exons")
    moved = F.transform("exons", lambda e, i: F.struct((e["start"] + F.when(~at_end & (i == 0), F.col("__shift")).otherwise(0)).alias("start"), (e["end"] + F.when(at_end & (i == n - 1), F.col("__shift")).otherwise(0)).alias("end")))
    shifted = chosen.withColumn("__shift", shift).withColumn("exons", moved).drop("__shift")
    return shifted.withColumn("transcript_id", F.concat("transcript_id", F.lit("_alt")))


def fragments(alignments: DataFrame, sequences: DataFrame) -> DataFrame:
    """The aligned part of each transcript, numbered within it."""
    from pyspark.sql import Window

    w = Window.partitionBy("chr").orderBy("start", "read_id")
    cut = alignments.join(sequences.select(F.col("id").alias("chr"), "seq"), "chr").withColumn("n", F.row_number().over(w))
    return cut.select(F.concat_ws("_", "chr", "n").alias("id"), F.substring(F.col("seq"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"))


def read_counts(rows: DataFrame, abundance: str, total: int) -> DataFrame:
    """Whole reads by abundance."""
    s = rows.agg(F.sum(abundance).alias("__s"))
    return rows.crossJoin(F.broadcast(s)).withColumn("reads", F.floor(total * F.col(abundance) / F.col("__s")).cast("long")).drop("__s")


def cage_peaks(transcripts: DataFrame, seed: int, skip: float, width: int = 20, reach: int = 50) -> DataFrame:
    """Intervals around transcription starts, some left out."""
    start = F.when(F.col("strand") == "-", F.element_at("exons", -1)["end"]).otherwise(F.col("exons")[0]["start"])
    middle = start + F.floor((uniform(seed, "transcript_id") - 0.5) * 2 * reach).cast("long")
    kept = transcripts.filter(uniform(seed + 1, "transcript_id") >= skip)
    return kept.select("transcript_id", "chr", (middle - width // 2).alias("start"), (middle + width // 2).alias("end"), "strand")


def truncate_reads(reads: DataFrame, seed: int, mean: float, sd: float) -> DataFrame:
    """A piece of normal length from the read's end, by strand agreement."""
    n = F.least(F.greatest(F.floor(mean + sd * normal(seed, "read_id")).cast("int"), F.lit(1)), F.length("seq"))
    piece = F.when(F.col("same_strand"), F.substring(F.col("seq"), F.length("seq") - n + 1, n)).otherwise(F.substring(F.col("seq"), F.lit(1), n))
    return reads.withColumn("seq", piece)


def guide_reference(guides: DataFrame, head: str, tail: str) -> DataFrame:
    """A contig for each guide with its gene, transcript and exon features."""
    seqs = guides.withColumn("contig_seq", F.concat(F.lit(head), "seq", F.lit(tail)))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("gene", "transcript", "exon")]))
    return seqs.select(F.col("id").alias("chr"), kinds.alias("feature"), F.lit(1).cast("long").alias("start"), F.length("contig_seq").cast("long").alias("end"), F.lit("+").alias("strand"), F.col("id").alias("gene_id"), "contig_seq")


def fake_umis(reads: DataFrame, copies: int, seed: int, length: int = 12) -> DataFrame:
    """Each read once with its own UMI and `copies` times with random ones."""
    rows = reads.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    umi = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(F.lit("ACGT"), (F.floor(uniform(seed, "read_id", "copy", i) * 4) + 1).cast("int"), F.lit(1))), "")
    return rows.withColumn("umi", F.when(F.col("copy") == 0, F.col("umi")).otherwise(umi))
