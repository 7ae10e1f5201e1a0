"""Queries over sequence expressions; names and texts stand for reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import align
from strandlake.functions import interval as iv
from strandlake.functions import sequence as sq
from strandlake.operators import relational
from strandlake.plans.catalog import query, table

#: A text as bases: letters are folded to the alphabet by fixed pairs.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACA"
BASES = f"translate(lower(p_name), '{_FROM}', '{_TO}')"


def bases(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.translate(F.lower("p_name"), _FROM, _TO).alias("seq"))


@query(f"select p_partkey, reverse(translate({BASES}, 'ACGT', 'TGCA')) as rc from part")
def str_revcomp(spark, sf):
    """X1."""
    return bases(spark, sf).select("p_partkey", sq.revcomp("seq").alias("rc"))


@query(f"""with k as (select unnest(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4))) as kmer from (select {BASES} as s from part) where length(s) >= 4) select kmer, count(*) as n from k group by 1""")
def kmer_counts(spark, sf):
    """X10, T3."""
    return bases(spark, sf).select(F.explode(sq.kmers("seq", 4)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query(f"select p_partkey, round(100.0 * (length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s), 6) as gc from (select p_partkey, {BASES} as s from part)")
def gc_percent(spark, sf):
    """X7."""
    return bases(spark, sf).select("p_partkey", F.round(sq.gc_percent("seq"), 6).alias("gc"))


@query(f"select p_partkey, coalesce(list_max(list_transform(regexp_extract_all(s, 'A+|C+|G+|T+|N+'), lambda x: length(x))), 0)::int as longest from (select p_partkey, {BASES} as s from part)")
def homopolymer(spark, sf):
    """W14."""
    return bases(spark, sf).select("p_partkey", sq.longest_run("seq").alias("longest"))


@query("select a.p_partkey as a, b.p_partkey as b, case when length(a.p_brand) <> length(b.p_brand) then -1 else hamming(a.p_brand, b.p_brand) end::int as d from part a join part b on a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey")
def hamming(spark, sf):
    """X8."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return relational.compared_pairs(p, ["p_type", "p_size"], "p_partkey", "p_brand", sq.hamming, "d")


@query("select a.p_partkey as a, b.p_partkey as b, levenshtein(a.p_name, b.p_name)::int as d from part a join part b on a.p_type = b.p_type and a.p_size = b.p_size and a.p_partkey < b.p_partkey")
def edit_distance(spark, sf):
    """X9."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return relational.compared_pairs(p, ["p_type", "p_size"], "p_partkey", "p_name", sq.edit_distance, "d")


@query(f"select p_partkey, ((length(s) - length(replace(s, 'CG', ''))) / 2)::int as n from (select p_partkey, {BASES} as s from part)")
def motif_density(spark, sf):
    """F18."""
    return bases(spark, sf).select("p_partkey", sq.motif_count("seq", "CG").alias("n"))


@query("select c_custkey, split_part(c_name, '#', 2) as token, split_part(c_name, '#', 1) as prefix from customer")
def id_tokens(spark, sf):
    """X14, X15."""
    return table(spark, sf, "customer").select("c_custkey", F.coalesce(sq.id_token("c_name", 1, "#"), F.lit("")).alias("token"), F.substring_index("c_name", "#", 1).alias("prefix"))


@query(f"""with s as (select p_partkey, {BASES} as s from part), r as (select p_partkey, case when instr(s, 'GAC') > 0 then substr(s, 1, instr(s, 'GAC') - 1) else s end as s from s) select p_partkey, case when instr(s, 'TA') > 0 then substr(s, instr(s, 'TA') + 2) else s end as trimmed from r""")
def adapter_trim(spark, sf):
    """X20."""
    return bases(spark, sf).select("p_partkey", sq.trim_adapters("seq", "TA", "GAC").alias("trimmed"))


@query("""with k as (select distinct p_partkey, unnest(list_transform(range(1, length(p_name) - 4), lambda i: substr(p_name, i, 6))) as kmer from part where length(p_name) >= 6) select a.p_partkey as a, b.p_partkey as b, count(*) as shared from k a join k b on a.kmer = b.kmer and a.p_partkey < b.p_partkey group by 1, 2 having count(*) >= 4""")
def shared_kmer_pairs(spark, sf):
    """Pairs of names that share k-mers."""
    return relational.shared_kmer_pairs_within(table(spark, sf, "part"), "p_partkey", "p_name", 6, 4)


@query("""select event_id, json_extract_string(props, '$.k') as k from events""")
def json_extract(spark, sf):
    """S37, S38."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""select event_id, (user_id % 4096)::bigint as code, string_agg(substr('ACGT', ((user_id % 4096) >> (10 - 2 * i))::int % 4 + 1, 1), '' order by i) as umi from events cross join range(0, 6) t(i) group by 1, 2""")
def two_bit_umi(spark, sf):
    """D17."""
    code = F.col("user_id") % 4096
    return table(spark, sf, "events").select("event_id", code.alias("code"), sq.two_bit_decode(code, 6).alias("umi"))


@query("""select p_partkey, ';%;' || p_brand || '_' || p_size || '_' || (p_size + 9) || '_+' as region, (p_size + 10 - p_size)::bigint as total from part""")
def region_codec(spark, sf):
    """Written, read back and measured."""
    one = F.array(F.struct(F.col("p_size").cast("long").alias("start"), (F.col("p_size") + 9).cast("long").alias("end")))
    text = iv.format_regions(F.col("p_brand"), one, F.lit("+"))
    return table(spark, sf, "part").select("p_partkey", text.alias("region"), iv.total_length(iv.parse_regions(text)).alias("total"))


@query(f"""select p_partkey, round(list_sum(list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1)) - 33)) / length(s)::double, 6) as q from (select p_partkey, {BASES} as s from part)""")
def mean_phred(spark, sf):
    """P46."""
    return bases(spark, sf).select("p_partkey", F.round(sq.mean_phred("seq"), 6).alias("q"))


@query()
def sw_best_match(spark, sf):
    """M1, M3: local alignment scores; held against brute force."""
    rows = bases(spark, sf).select("p_partkey", F.col("seq").alias("text"), sq.revcomp(F.substring("seq", 3, 8)).alias("pattern"))
    return rows.select("p_partkey", align.align_column().alias("hit")).select("p_partkey", "hit.score", "hit.start", "hit.end")


@query()
def detector_10x(spark, sf):
    """Barcodes called in reads made from a template; held against the truth."""
    from strandlake.operators import pipelines

    parts = bases(spark, sf).select(F.col("p_partkey").cast("string").alias("transcript_id"), "seq", F.lit(10_000.0).alias("tpm"))
    reads = pipelines.simulate_reads(parts, 200, "10x", 50, 12, 3).repartition("read_id")
    calls = align.call_barcodes(reads, reads.select("barcode"), align.TENX)
    return calls.join(reads.select("read_id", F.col("barcode").alias("truth")), "read_id").select("read_id", "barcode", "truth", "umi", "bc_score", "strand")
