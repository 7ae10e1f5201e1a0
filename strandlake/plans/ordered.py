"""Queries over ordered operators, sampling and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import ordered, pipelines
from strandlake.plans.catalog import query, table
from strandlake.streaming import streams


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderdate, o_orderkey) as n from orders) where n = 1""")
def dedup_best(spark, sf):
    """The best record of a group."""
    best = ordered.best_record(table(spark, sf, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey"))
    return best.select("o_custkey", "o_orderkey", "o_totalprice")


@query("""with e as (select user_id, event_id, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + (value * 100)::bigint as e from events), m as (select *, max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) as r from e),
i as (select *, sum(case when s > r then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding) as island from m) select user_id, island::bigint as island, min(s) as s, max(e) as e, count(*) as n from i group by 1, 2""")
def islands(spark, sf):
    """W3, W6, ST4: runs of overlapping intervals."""
    s = F.unix_timestamp("ts")
    rows = table(spark, sf, "events").select("user_id", "event_id", s.alias("s"), (s + F.round(F.col("value") * 100).cast("long")).alias("e"))
    return ordered.merge_intervals(rows, ["user_id"], "s", "e", "event_id")


@query("""with g as (select *, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, sid""")
def sessions_batch(spark, sf):
    """ST4: sessions with pauses of 30 minutes."""
    rows = table(spark, sf, "events").withColumns({"s": F.unix_micros(F.col("ts").cast("timestamp")), "e": F.unix_micros(F.col("ts").cast("timestamp")) + 30 * 60 * 1_000_000})
    return ordered.islands(rows, ["user_id"], "s", "e", "event_id").groupBy("user_id", "island").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("island")


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def tumbling_window(spark, sf):
    """ST3."""
    return streams.tumbling_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("""with w as (select user_id, event_id, floor(epoch(ts))::bigint as p, lag(floor(epoch(ts))::bigint) over v as a, lead(floor(epoch(ts))::bigint) over v as b from events window v as (partition by user_id order by floor(epoch(ts))::bigint, event_id)) select user_id, event_id from w where coalesce(p - a > 3600, true) and coalesce(b - p > 3600, true)""")
def isolation_filter(spark, sf):
    """W7, F19."""
    rows = table(spark, sf, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("p"))
    return ordered.isolated(rows, ["user_id"], "p", "event_id", 3600).select("user_id", "event_id")


@query("""with r as (select event_id, user_id, event_type, row_number() over (order by event_id) as rn, count(*) over () as n from events), f as (select min(rn) as rn from r group by user_id, event_type), s as (select unnest(range(1, 11)) as step, (select max(n) from r) as n)
select step::int as step, (n * step // 10)::bigint as n_rows, (select count(*) from f where f.rn <= n * step // 10) as n_distinct from s""")
def saturation_deciles(spark, sf):
    """W10, ST7: distinct pairs among the first tenths."""
    return ordered.saturation(table(spark, sf, "events"), "event_id", ["user_id", "event_type"])


@query("""select event_id, last_value(case when value > 60 then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as last_high from events""")
def forward_fill(spark, sf):
    """F24, P36."""
    rows = table(spark, sf, "events").withColumn("high", F.when(F.col("value") > 60, F.col("event_id")))
    return ordered.forward_fill(rows, ["user_id"], ["ts", "event_id"], "high", "last_high").select("event_id", "last_high")


@query("""with c as (select *, case when event_type is distinct from lag(event_type) over w then 1 else 0 end as f from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(f) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from c) select user_id, run::bigint as run, event_type, count(*) as n from r group by 1, 2, 3""")
def run_lengths(spark, sf):
    """A66, W14."""
    return ordered.run_lengths(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("""with c as (select user_id * 100 + extract(hour from ts) as user_id, event_type, count(*) as n from events group by 1, 2), t as (select *, max(n) over (partition by user_id) as top from c), k as (select * from t where n >= case when top = 1 then 1 else greatest(2, top / 2.0) end) select user_id, event_type, n from k where user_id in (select user_id from k group by 1 having count(*) = 1)""")
def dominance_filter(spark, sf):
    """W13, G5."""
    counts = table(spark, sf, "events").groupBy((F.col("user_id") * 100 + F.hour("ts")).alias("user_id"), "event_type").agg(F.count("*").alias("n"))
    return ordered.dominance(counts, "user_id", "event_type", "n")


@query("""select o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by md5('7|' || o_orderkey::varchar), o_orderkey) as n from orders) where n <= 5""")
def stratified_sample_hash(spark, sf):
    """R2: five rows of each group by a hash."""
    return ordered.stratified_sample(table(spark, sf, "orders"), ["o_orderpriority"], 5, 7, "o_orderkey").select("o_orderpriority", "o_orderkey")


@query("""select l_suppkey, sum(n)::bigint as total, sum(least(n, 2))::bigint as capped from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2) group by 1 having sum(n) >= 10 and sum(least(n, 2)) >= 6""")
def high_count_groups(spark, sf):
    """R3."""
    return ordered.select_high_count_groups(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", 2, 10, 6)


@query()
def thin_positions(spark, sf):
    """Greedy thinning of positions; order-dependent, held against a fixture."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 3).alias("pos"))
    return ordered.thin_positions(rows, "l_suppkey", "pos", 100)


@query()
def greedy_cluster(spark, sf):
    """Greedy clusters of short names; order-dependent, held against a fixture."""
    rows = table(spark, sf, "customer").select("c_nationkey", F.substring(F.reverse("c_name"), 1, 5).alias("umi"), F.lit(True).alias("trusted"), F.lit(1).cast("long").alias("n"), "c_custkey")
    return ordered.umi_clusters(rows, ["c_nationkey"], "umi", "trusted", "n", "c_custkey", 1)


@query()
def ranked_collapse(spark, sf):
    """W8."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("gene"), F.lpad((F.col("user_id") % 97).cast("string"), 4, "0").alias("umi"))
    return ordered.ranked_umi_collapse(rows, ["gene"], "umi", 2)


@query()
def coord_dedup(spark, sf):
    """W4."""
    s = F.unix_timestamp("ts")
    rows = table(spark, sf, "events").select("user_id", "event_id", s.alias("s"), (s + F.col("value").cast("long")).alias("e"))
    return ordered.coordinate_dedup(rows, ["user_id"], "s", "e", "event_id", 3600, 3600)


@query("""with c as (select l_partkey as pos, l_suppkey as sample, count(*) as cov, count(*) filter (l_returnflag = 'R') as reads from lineitem group by 1, 2), f as (select pos, min(cov) as lc, min(reads / cov::double) as lo, max(reads / cov::double) as hi from c group by 1)
select pos, case when lo >= 0.2 or (lo > 0 and hi / lo < 2) then 'germline' else 'somatic' end as type from f where lc >= 1 and hi >= 0.2""")
def snp_types(spark, sf):
    """Somatic or germline by the extremes over samples."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("cov"), F.count_if(F.col("l_returnflag") == "R").alias("reads"))
    f = c.groupBy("pos").agg(F.min("cov").alias("lc"), F.min(F.col("reads") / F.col("cov")).alias("lo"), F.max(F.col("reads") / F.col("cov")).alias("hi")).filter("lc >= 1 and hi >= 0.2")
    return f.select("pos", F.when(pipelines.is_germline(F.col("lo"), F.col("hi"), 0.2, 2.0), "germline").otherwise("somatic").alias("type"))


@query("""with b as (select user_id * 100 + extract(hour from ts) as user_id, event_type, count(distinct event_id % 100) as umis from events group by 1, 2), t as (select *, max(umis) over (partition by user_id) as top from b), k as (select * from t where umis >= case when top = 1 then 1 else greatest(2, top / 2.0) end) select user_id as barcode, event_type as guide, umis from k where user_id in (select user_id from k group by 1 having count(*) = 1)""")
def guide_calls(spark, sf):
    """G5."""
    reads = table(spark, sf, "events").select((F.col("user_id") * 100 + F.hour("ts")).alias("barcode"), F.col("event_type").alias("guide"), (F.col("event_id") % 100).alias("umi"))
    return pipelines.guide_calls(reads)


@query("""with t as (select distinct l_partkey as f, l_returnflag as tool from lineitem), s as (select f, count(*) as k, bool_or(tool = 'A') as a, bool_or(tool = 'N') as n, bool_or(tool = 'R') as r from t group by 1), x as (select 'A' as tool, k, a as h from s union all select 'N', k, n from s union all select 'R', k, r from s)
select tool, count(*) filter (k = 3 and h) as all_tools, count(*) filter (k = 2 and h) as all_but_one, count(*) filter (k = 1 and h) as only_it, count(*) filter (k = 2 and not h) as missed from x group by 1""")
def tool_consensus(spark, sf):
    """A53, G14."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("f"), F.col("l_returnflag").alias("tool"))
    return pipelines.tool_consensus(rows, "f", "tool", ["A", "N", "R"])
