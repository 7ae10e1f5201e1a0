"""The registered queries of this subpackage and their SQL. Each gets its rows through its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import chat, decontaminate, jaccard, langid, packing, quality, secrets, sharding, toxicity, warc

CATEGORIES = ("low_quality", "toxic")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.transform("overlaps", lambda o: o.item_id)
    return found.select("doc_id", "contaminated", items.alias("item_ids"), F.coalesce(F.array_max(F.transform("overlaps", lambda o: o.matched)), F.lit(0)).alias("most_matched"), F.coalesce(F.aggregate("overlaps", F.lit(0), lambda a, o: a + o.substituted), F.lit(0)).alias("substituted"))


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_chain(docs, toxicity.train_chain(docs, labels(spark, sf_dir), CATEGORIES))
    return scored.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op4_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.train_profiles(docs.filter(~langid.held_out()))
    return langid.predict_languages(docs, profiles).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    out = chat.format_conversations(turns).withColumn("read", chat.parse_formatted(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("messages").cast("long").alias("n_messages"))


OP6_SQL = r"""
with said as (select '</s>[INST] ok [/INST]' as t),
turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', t from said union all select -1, 1, 'assistant', t from said),
marked as (
  select *, regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1~\2\3', 'g') as escaped,
    replace(regexp_replace(role, '([<\[])(~*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1~\2\3', 'g'), chr(10), '<|nl|>') as head,
    row_number() over w as place, lag(role) over w as before
  from turns window w as (partition by conv_id order by turn nulls first, role, text)),
counted as (select *, before is null or before <> role as opens from marked)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by place), '')) as loss_sha256,
  sum(length(escaped) + case when opens then length(head) + 9 + 8 else 8 end)::bigint as formatted_chars,
  sum(case when opens then 1 else 0 end)::bigint as n_messages
from counted group by conv_id
"""


def op7_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), "url", "html")
    archive = warc.write_archive(pages)
    keys = pages.select(warc.capture_key(F.col("url"), F.col("page_id")).alias("key"))
    return warc.lookup(keys, archive, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base 32 of a SHA-1: each five hexadecimal digits are four letters.
OP7_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as hex from pages),
d as (select *, min(page_id) over (partition by hex) as first_page, (
  select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::int >> (15 - 5 * (i % 4))) & 31) + 1, 1), '' order by i) from range(0, 32) t(i)) as digest from p)
select page_id::bigint as page_id, octet_length(payload)::bigint as payload_bytes, digest as payload_digest,
  case when page_id = first_page or page_id is null and first_page is null then 'response' else 'revisit' end as record_type,
  case when page_id <> first_page or page_id is null then first_page end::bigint as refers_to
from d
"""


def _spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f.kind, f.start, f.end)), ",")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.stored_pieces(_table(spark, sf_dir, "documents"), vocabulary())
    digested = pieces.select("__sl_row", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(digested)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f.kind != "learned")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_spans(base), 256).alias("base_sha256"), _spans(F.col("findings")).alias("spans"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_spaced_seed_decontamination, op2_toxicity_chain, op3_distribution_divergence, op4_hypergeometric_sharding, op5_rank_order_langid, op6_relational_chat, op7_capture_index, op8_best_fit_packing, op9_secret_scan, op10_ngram_jaccard, pipeline)}
ORACLE_SQL = {"op6_relational_chat": OP6_SQL, "op7_capture_index": OP7_SQL}
