"""Shared-folder helpers: tables that must outlive a lost executor are written where every node can read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.sources.scratch import file_system, shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._strandlake_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a stored() table that nothing reads any more."""
    fs, p = file_system(df.sparkSession, df._strandlake_path)
    fs.delete(p, True)


#: Hash buckets of a prefilter; its broadcast never exceeds this many bigint rows (8 MB).
PREFILTER_BUCKETS = 1 << 20
#: Parts that a key's rows are dealt to where one key may hold a large share of them.
SALTS = 32


def split_by_ids(docs: DataFrame, ids: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ids, rows whose key certainly is not), without shuffling docs.

    ids is folded to at most PREFILTER_BUCKETS hash buckets, so the broadcast is bounded whatever its size; the first
    part still needs an exact join, the second needs none.  Null keys are in the second part.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(PREFILTER_BUCKETS))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    seen = ids.filter(whole).select(bucket.alias("__sl_bucket")).distinct()
    marked = docs.withColumn("__sl_bucket", F.when(whole, bucket))
    maybe = marked.join(F.broadcast(seen), "__sl_bucket", "left_semi").drop("__sl_bucket")
    surely_not = marked.join(F.broadcast(seen), "__sl_bucket", "left_anti").drop("__sl_bucket")
    return maybe, surely_not


def salted_left(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """rows left-joined with a table that has one row for each key: a hot key's rows are dealt to SALTS tasks. Never by
    broadcast, as the table may be of any size."""
    dealt = rows.withColumn("__sl_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = table.withColumn("__sl_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies.hint("merge"), [*keys, "__sl_salt"], "left").drop("__sl_salt")


def lookup_rows(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """rows left-joined with a table that has one row for each key; only rows that pass the bounded prefilter are shuffled."""
    maybe, rest = split_by_ids(rows, table, *keys)
    new = [f for f in table.schema if f.name not in keys]
    blank = rest.select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    return salted_left(maybe, table, *keys).select(*rows.columns, *[f.name for f in new]).unionByName(blank)


def semi_rows(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs whose key is in ids; only rows that pass the bounded prefilter are shuffled."""
    maybe, _ = split_by_ids(docs, ids, key)
    return maybe.join(ids.select(key).distinct(), key, "left_semi").select(*docs.columns)


def rows_of_ids(docs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """docs joined with a table on a key (nulls match nothing); only rows that pass the bounded prefilter are shuffled."""
    return split_by_ids(docs, table, key)[0].join(table, key)


def row_key(*columns: str) -> list[Column]:
    """128 bits that name a row by these columns; nulls count."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (1, 2)]
