"""From raw documents to packed training sequences, in five stages; each is written and read again before the next.

Every stage decides on rows, not on ids: a row goes or stays for its own text, so rows of one id with other texts are judged
apart.  Defined cases, of all stages: null and empty texts pass (they are clean, link with nothing and hold no secrets, and are
packed as one end id each); very long texts are taken whole; of rows that repeat one another all stay or go together, except in
the stage of near copies, where one of a group stays; null ids are ids like others; an empty table gives an empty result; extra
columns pass through all but the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, jaccard, packing, secrets, toxicity
from strandlake.llm._runtime import dropped, stored
from strandlake.llm.queries import CATEGORIES, labels, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not reject; it is trained on the labels of documents that are here."""
    return toxicity.drop_flagged(docs, toxicity.train_chain(docs, labels(spark, sf_dir), CATEGORIES), "toxic")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies; all without words."""
    return jaccard.one_per_component(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a training sequence."""
    pieces = packing.stored_pieces(docs, vocabulary())
    return packing.pack_pieces(pieces.select("__sl_row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_each_group), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack)]

#: A trained chain, shingle components, trained networks and a tokenizer's ids are not to be had in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
