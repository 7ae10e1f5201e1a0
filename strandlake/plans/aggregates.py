"""Queries over aggregations and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import aggregate, relational, stats
from strandlake.plans.catalog import query, table


@query("""select user_id, count(*) as n from events group by 1 having count(*) >= 50 and count(*) <= 70""")
def count_having(spark, sf):
    """A1-A3."""
    return aggregate.count_having(table(spark, sf, "events"), "user_id", 50, 70)


@query("""select l_partkey, round(sum(l_quantity) * 1e6 / (select sum(l_quantity) from lineitem), 4) as tpm from lineitem group by 1""")
def tpm_normalise(spark, sf):
    """A7."""
    counts = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("n"))
    return aggregate.tpm(counts, "n").select("l_partkey", F.round("tpm", 4).alias("tpm"))


@query("""with c as (select l_partkey, sum(l_quantity) / (any_value(p_size) * 100 / 1000.0) as r from lineitem join part on l_partkey = p_partkey group by 1) select l_partkey, round(r * 1e6 / (select sum(r) from c), 3) as tpm from c""")
def rpk_tpm(spark, sf):
    """A8."""
    counts = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("n")).join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 100).alias("len")), "l_partkey")
    return aggregate.tpm(counts, "n", length="len").select("l_partkey", F.round("tpm", 3).alias("tpm"))


@query("""select event_type, count(value) as n, round(quantile_cont(value, 0.1), 6) as q10, round(quantile_cont(value, 0.5), 6) as q50, round(quantile_cont(value, 0.9), 6) as q90, min(value) as min, max(value) as max from events group by 1""")
def percentile_stats(spark, sf):
    """A17, A18."""
    d = aggregate.describe(table(spark, sf, "events"), ["event_type"], "value", (0.1, 0.5, 0.9))
    return d.select("event_type", "n", *[F.round(q, 6).alias(q) for q in ("q10", "q50", "q90")], "min", "max")


@query("""select b::int as bin, count(*) as n from (select case when l_quantity = 50 then 4 else floor(l_quantity / 10)::int end as b from lineitem where l_quantity between 0 and 50) group by 1""")
def hist_numpy(spark, sf):
    """Half-open bins, the last closed."""
    return aggregate.histogram(table(spark, sf, "lineitem"), "l_quantity", [0, 10, 20, 30, 40, 50]).select("bin", "n")


@query("""with b(bin, lo, hi) as (values (0, 0, 5), (1, 5, 7), (2, 7, 30), (3, 30, 30.5), (4, 30.5, 1000)) select bin, count(l_quantity) as n from b left join lineitem on l_quantity >= lo and l_quantity < hi group by bin""")
def hist_irregular(spark, sf):
    """Irregular half-open bins, empty ones kept."""
    return aggregate.histogram(table(spark, sf, "lineitem"), "l_quantity", [0, 5, 7, 30, 30.5, 1000], closed_last=False, keep_empty=True).select("bin", "n")


@query("""select case when o_totalprice >= 100000 then 100000 when o_totalprice >= 50000 then 50000 when o_totalprice >= 10000 then 10000 when o_totalprice >= 5000 then 5000 else 0 end::double as bound, count(*) as n from orders where o_totalprice >= 0 group by 1""")
def threshold_floor_bin(spark, sf):
    """A22."""
    return table(spark, sf, "orders").filter("o_totalprice >= 0").groupBy(aggregate.floor_bin(F.col("o_totalprice"), [0, 5000, 10000, 50000, 100000]).alias("bound")).agg(F.count("*").alias("n"))


@query("""select count(*) filter (value > 0) as above_0, count(*) filter (value > 10) as above_10, count(*) filter (value > 50) as above_50, count(*) filter (value > 100) as above_100 from events""")
def counts_above(spark, sf):
    """A25."""
    return aggregate.counts_above(table(spark, sf, "events"), "value", [0, 10, 50, 100])


@query("""with c as (select l_quantity::int as score, count(*) as n, count(*) filter (l_returnflag = 'R') as c from lineitem group by 1)
select score, sum(n) over (order by score desc)::bigint as called, sum(c) over (order by score desc)::bigint as correct, round(100.0 * sum(c) over (order by score desc) / sum(n) over (order by score desc), 6) as precision from c""")
def cumulative_thresholds(spark, sf):
    """A50."""
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("score"), (F.col("l_returnflag") == "R").alias("correct"))
    return aggregate.accuracy_by_threshold(rows, "score", "correct").withColumn("precision", F.round("precision", 6))


@query("""select l_returnflag, l_linestatus, c_mktsegment, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by cube (l_returnflag, l_linestatus, c_mktsegment)""")
def cube_crosstab(spark, sf):
    """A cross table with its margins."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return aggregate.crosstab(rows, "l_returnflag", "l_linestatus", "c_mktsegment").drop("level")


@query("""select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""")
def pivot_matrix(spark, sf):
    """A34, J9, P33."""
    return relational.pivot_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""with w as (select l_suppkey, sum(l_quantity) filter (l_returnflag = 'A') as a, sum(l_quantity) filter (l_returnflag = 'N') as n, sum(l_quantity) filter (l_returnflag = 'R') as r from lineitem group by 1)
select l_suppkey, 'A' as flag, a as value from w where a > 0 union all select l_suppkey, 'N', n from w where n > 0 union all select l_suppkey, 'R', r from w where r > 0""")
def unpivot_matrix(spark, sf):
    """Wide to long, positive cells only."""
    wide = relational.pivot_counts(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"], F.col("l_quantity"))
    return relational.unpivot(wide, ["l_suppkey"], ["A", "N", "R"], "flag", "value", positive_only=True)


@query("""with t as (select distinct event_type from events), u as (select user_id, string_agg(case when has then '1' else '0' end, '' order by event_type) as pattern from (select u.user_id, t.event_type, bool_or(e.event_type = t.event_type) as has from (select distinct user_id from events) u cross join t join events e on e.user_id = u.user_id group by 1, 2) group by 1) select pattern, count(*) as n from u group by 1""")
def presence_pattern(spark, sf):
    """A54."""
    events = table(spark, sf, "events")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a handful of names
    return aggregate.presence_pattern(events, "user_id", "event_type", kinds)


@query("""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as x, rank() over (order by l_discount) + (count(*) over (partition by l_discount) - 1) / 2.0 as y from lineitem) select round(corr(x, y), 6) as spearman from r""")
def spearman_corr(spark, sf):
    """A29."""
    return aggregate.spearman(table(spark, sf, "lineitem").select("l_quantity", "l_discount"), "l_quantity", "l_discount").select(F.round("spearman", 6).alias("spearman"))


@query("""select event_type, round(corr(value, user_id), 6) as r from events group by 1""")
def pearson_corr(spark, sf):
    """A30."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.corr("value", "user_id"), 6).alias("r"))


@query("""select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 1 and toxic = 1) as fp, count(*) filter (quality = 0 and toxic = 0) as fn, round(100.0 * count(*) filter (quality = 1 and toxic = 0) / count(*) filter (quality = 1), 6) as precision, round(100.0 * count(*) filter (quality = 1 and toxic = 0) / count(*) filter (toxic = 0), 6) as recall from labels""")
def accuracy_stats(spark, sf):
    """A27, A49, P27."""
    a = aggregate.accuracy(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 0)
    return a.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("""with s as (select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2) select l_partkey, sum(n)::bigint as reads, count(*) filter (n >= 1) as s1, count(*) filter (n >= 2) as s2, count(*) filter (n >= 3) as s3 from s group by 1""")
def two_level_summary(spark, sf):
    """A32."""
    s = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return s.groupBy("l_partkey").agg(F.sum("n").alias("reads"), *[F.count_if(F.col("n") >= k).alias(f"s{k}") for k in (1, 2, 3)])


@query("""with c as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select *, round(n / sum(n) over (partition by user_id), 6) as share, row_number() over (partition by user_id order by n desc, event_type) as place from c) select user_id, event_type, n, share, place from r where place <= 3""")
def mode_topk_per_group(spark, sf):
    """A46, A47, T5."""
    return aggregate.top_values(table(spark, sf, "events"), "user_id", "event_type", 3).withColumn("share", F.round("share", 6))


@query("""select times, count(*) as n from (select user_id, count(*) as times from events group by 1) group by 1""")
def freq_of_freq(spark, sf):
    """A48."""
    return aggregate.count_of_counts(table(spark, sf, "events"), "user_id")


@query("""select l_partkey, bool_or(l_returnflag = 'R') as returned, max(l_discount) as l_discount, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as suppliers from lineitem group by 1""")
def bool_or_merge(spark, sf):
    """A42."""
    rows = table(spark, sf, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    m = aggregate.merge_flags(rows, "l_partkey", ["returned"], ["l_discount"], ["l_suppkey"])
    return m.select("l_partkey", "returned", "l_discount", F.array_join(F.transform("l_suppkey", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("""with t as (select c_mktsegment as g, count(*) filter (o_orderstatus = 'F') as a, count(*) filter (o_orderstatus <> 'F') as b, (select count(*) filter (o_orderstatus = 'F') from orders) as fa, (select count(*) filter (o_orderstatus <> 'F') from orders) as fb from orders join customer on o_custkey = c_custkey group by 1),
x as (select g, a::double as a, b::double as b, (fa - a)::double as c, (fb - b)::double as d, (fa + fb)::double as n from t)
select g, round(n * pow(greatest(0, abs(a * d - b * c) - least(n / 2, abs(a * d - b * c))), 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) as chi2 from x""")
def chi2_2x2(spark, sf):
    """D3: each segment against the rest, with Yates' correction."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    done = F.col("o_orderstatus") == "F"
    t = rows.groupBy(F.col("c_mktsegment").alias("g")).agg(F.count_if(done).alias("a"), F.count_if(~done).alias("b"))
    total = rows.agg(F.count_if(done).alias("fa"), F.count_if(~done).alias("fb"))
    x = t.crossJoin(F.broadcast(total))
    return x.select("g", F.round(stats.chi2_2x2(F.col("a"), F.col("b"), F.col("fa") - F.col("a"), F.col("fb") - F.col("b")), 6).alias("chi2"))


@query("""with c as (select c_mktsegment as k, l_returnflag as r, l_linestatus as s, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2, 3), r as (select k, r, sum(n) as rn from c group by 1, 2), s as (select k, s, sum(n) as sn from c group by 1, 2), t as (select k, sum(n) as tn from c group by 1)
select r.k, round(sum(pow(coalesce(n, 0) - rn::double * sn / tn, 2) / (rn::double * sn / tn)), 4) as chi2, ((count(distinct r.r) - 1) * (count(distinct s.s) - 1))::int as df from r join s on r.k = s.k join t on r.k = t.k left join c on c.k = r.k and c.r = r.r and c.s = s.s group by r.k""")
def table_chi2(spark, sf):
    """D5, P16."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cells = rows.groupBy(F.col("c_mktsegment").alias("k"), "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return stats.table_chi2(cells, ["k"], "l_returnflag", "l_linestatus", "n").withColumn("chi2", F.round("chi2", 4))


_P = "select p_partkey, (p_partkey * 37 % 1000 + 1) / 1001.0 as p from part"


def _adjusted(method: str) -> str:
    h = "(select sum(1.0 / i) from range(1, (select count(*) + 1 from part)) t(i))" if method == "BY" else "1.0"
    return f"""with r as ({_P}), k as (select p, count(*) as k from r group by p), c as (select p, sum(k) over (order by p) as rank, (select count(*) from r) * {h} as m from k),
f as (select p, least(1.0, min(p * m / rank) over (order by p desc rows unbounded preceding)) as fdr from c) select p_partkey, round(fdr::double, 8) as fdr from r join f using (p)"""


def _p_values(spark, sf):
    return table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") * 37 % 1000 + 1) / F.lit(1001.0)).alias("p"))


@query(_adjusted("BH"))
def bh_adjust(spark, sf):
    """D5."""
    return stats.adjust(_p_values(spark, sf), "p", "fdr", "BH").select("p_partkey", F.round("fdr", 8).alias("fdr"))


@query(_adjusted("BY"))
def by_adjust(spark, sf):
    """D4."""
    return stats.adjust(_p_values(spark, sf), "p", "fdr", "BY").select("p_partkey", F.round("fdr", 8).alias("fdr"))


@query("""with m as (select l_suppkey, l_returnflag, sum(l_quantity) as v from lineitem group by 1, 2) select l_suppkey, l_returnflag, round(v - avg(v) over w, 4) as centred, round((v - avg(v) over w) / stddev_samp(v) over w, 4) as z from m window w as (partition by l_suppkey)""")
def zscore_rows(spark, sf):
    """D13, D30."""
    m = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    return aggregate.row_zscore(m, "l_suppkey", "v").select("l_suppkey", "l_returnflag", F.round("centred", 4).alias("centred"), F.round("z", 4).alias("z"))


@query("""select l_suppkey, round((sum(l_quantity) filter (l_returnflag = 'A') + sum(l_quantity) filter (l_returnflag = 'R')) / 2, 4) as g1, round(sum(l_quantity) filter (l_returnflag = 'N'), 4) as g2 from lineitem group by 1 having count(distinct l_returnflag) = 3""")
def group_mean_cols(spark, sf):
    """D12."""
    wide = table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "R", "N"]).agg(F.sum("l_quantity")).dropna().toDF("l_suppkey", "g1_a", "g1_r", "g2_n")
    m = aggregate.group_mean_columns(wide, "l_suppkey", ["g1_a", "g1_r", "g2_n"])
    return m.select("l_suppkey", F.round("g1", 4).alias("g1"), F.round("g2", 4).alias("g2"))


@query("""with t as (select l_returnflag as s, l_partkey as f, sum(l_quantity) as v from lineitem group by 1, 2), n as (select s, sum(v) as n from t group by 1) select f, count(*) filter (v * 1e6 / n > 500) as n_samples from t join n using (s) group by f having count(*) filter (v * 1e6 / n > 500) >= 2""")
def cpm_filter(spark, sf):
    """D22."""
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("s"), F.col("l_partkey").alias("f")).agg(F.sum("l_quantity").alias("v"))
    return aggregate.expressed(t, "f", "s", "v", 500.0, 2)


@query("""with t as (select l_linestatus || l_returnflag as s, l_suppkey as f, log2(sum(l_quantity) + 1) as v from lineitem group by 1, 2) select a.s as sample_a, b.s as sample_b, round(1 - corr(a.v, b.v), 4) as distance from t a join t b on a.f = b.f and a.s < b.s group by 1, 2""")
def sample_distance(spark, sf):
    """D28."""
    t = table(spark, sf, "lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("s"), F.col("l_suppkey").alias("f")).agg(F.sum("l_quantity").alias("v"))
    return aggregate.sample_distance(t, "f", "s", "v").withColumn("distance", F.round("distance", 4))


@query("""select p_partkey, p_type from part where p_type in (select p_type from part group by 1 having count(*) > 3)""")
def frequent_terms(spark, sf):
    """D15."""
    return aggregate.frequent_terms(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", 3)


@query("""with v as (select o_custkey as g, o_orderpriority as c, avg(o_totalprice) / 1000 - 150 as lfc from orders group by 1, 2) select g, round(greatest(0, max(lfc)) - least(0, min(lfc)), 8) as lfc_range from v group by 1""")
def lfc_range(spark, sf):
    """D6, D29."""
    v = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("g"), "o_orderpriority").agg((F.avg("o_totalprice") / 1000 - 150).alias("lfc"))
    return aggregate.lfc_range(v, "g", "lfc").withColumn("lfc_range", F.round("lfc_range", 8))


@query("""select n_a, n_b, common, n_a - common as only_a, n_b - common as only_b from (select (select count(distinct l_partkey) from lineitem where l_returnflag = 'R') as n_a, (select count(distinct l_partkey) from lineitem where l_returnflag = 'A') as n_b, (select count(*) from (select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A')) as common)""")
def set_sizes(spark, sf):
    """U1, U2."""
    lines = table(spark, sf, "lineitem")
    return relational.set_sizes(lines.filter("l_returnflag = 'R'"), lines.filter("l_returnflag = 'A'"), "l_partkey")
