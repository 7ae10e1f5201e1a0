"""Queries over joins, set operations and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import interval as iv
from strandlake.functions import profile as pf
from strandlake.operators import aggregate, ordered, relational
from strandlake.plans.catalog import query, table


@query("""select o_custkey, count(distinct l_partkey) as n_parts from orders join lineitem on o_orderkey = l_orderkey group by o_custkey""")
def flagship_distinct_per_key(spark, sf):
    """Distinct parts (UMIs) of each customer (barcode)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count_distinct("l_partkey").alias("n_parts"))


@query("""select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders)""")
def semi_whitelist(spark, sf):
    """F2, J11."""
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.whitelist(table(spark, sf, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


@query("""select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_orderpriority < '3')""")
def anti_missing(spark, sf):
    """F10, J12."""
    ids = table(spark, sf, "orders").filter("o_orderstatus = 'F' and o_orderpriority < '3'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.blacklist(table(spark, sf, "customer").select("c_custkey", "c_name"), ids, "c_custkey")


@query("""with s as (select l_suppkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1),
p as (select l_suppkey as k, count(*) as n from lineitem where l_linestatus = 'O' group by 1)
select coalesce(s.k, p.k) as k, coalesce(s.n, 0) as returned, coalesce(p.n, 0) as open from s full join p on s.k = p.k""")
def full_outer_counts(spark, sf):
    """Two counts of a key, 0 where one is missing."""
    lines = table(spark, sf, "lineitem")
    a = lines.filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    b = lines.filter("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    return relational.outer_counts({"returned": a, "open": b}, "k", "n")


@query("""with a as (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1),
b as (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'A' group by 1)
select count(*) filter (a.k is not null and b.k is not null and a.n = b.n) as same, count(*) filter (a.k is not null and b.k is not null and a.n <> b.n) as different,
count(*) filter (b.k is null) as only_a, count(*) filter (a.k is null) as only_b from a full join b on a.k = b.k""")
def compare_maps(spark, sf):
    """J10."""
    def of(flag):
        return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return relational.compare_maps(of("R"), of("A"), "k", "n")


@query("""select o_orderkey, coalesce(n_name, '*') as n_name from orders left join (select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where n_regionkey < 2) on o_custkey = c_custkey""")
def left_lookup_default(spark, sf):
    """J2, J4, J24."""
    names = table(spark, sf, "customer").join(table(spark, sf, "nation").filter("n_regionkey < 2"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return relational.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", ["n_name"]).select("o_orderkey", "n_name")


@query("""select r_name, (select string_agg(s, ',' order by s) from (select distinct c_mktsegment as s from customer)) as segments from region""")
def cross_product(spark, sf):
    """Every region with the list of segments."""
    return relational.product_with_list(table(spark, sf, "region").select("r_name"), table(spark, sf, "customer"), "c_mktsegment", "segments")


@query("""select floor(o_totalprice / 1000)::bigint as band, count(*) as n from orders where o_totalprice between 1000 and 99999.99 group by 1""")
def band_counts(spark, sf):
    """Orders by price band."""
    return table(spark, sf, "orders").filter("o_totalprice between 1000 and 99999.99").groupBy(F.floor(F.col("o_totalprice") / 1000).alias("band")).agg(F.count("*").alias("n"))


@query("""with r as (select p_partkey as r_id, p_size * 100 as lo, p_size * 100 + p_partkey % 50 as hi from part),
p as (select event_id, user_id * 7 % 5000 as pt from events)
select event_id, r_id from p join r on pt between lo and hi""")
def range_join_bins(spark, sf):
    """Points in closed ranges, by bins."""
    ranges = table(spark, sf, "part").select(F.col("p_partkey").alias("r_id"), (F.col("p_size") * 100).cast("long").alias("lo"), (F.col("p_size") * 100 + F.col("p_partkey") % 50).alias("hi"), F.lit(1).alias("chr"))
    points = table(spark, sf, "events").select("event_id", (F.col("user_id") * 7 % 5000).alias("at"), F.lit(1).alias("chr"))
    return relational.range_join(points, ranges, "at", "lo", "hi", ["chr"], 64).select("event_id", "r_id")


@query("""with r as (select p_partkey as r_id, p_size * 100 as lo, p_size * 100 + p_partkey % 50 as hi from part),
p as (select event_id, user_id * 7 % 5000 as pt from events)
select event_id, r_id from (select event_id, r_id, row_number() over (partition by event_id order by lo, r_id) as n from p join r on pt between lo and hi) where n = 1""")
def point_first_match(spark, sf):
    """The first range that holds a point."""
    ranges = table(spark, sf, "part").select(F.col("p_partkey").alias("r_id"), (F.col("p_size") * 100).cast("long").alias("lo"), (F.col("p_size") * 100 + F.col("p_partkey") % 50).alias("hi"), F.lit(1).alias("chr"))
    points = table(spark, sf, "events").select("event_id", (F.col("user_id") * 7 % 5000).alias("at"), F.lit(1).alias("chr"))
    return relational.first_range(points, ranges, "at", "lo", "hi", ["chr"], 64, "lo", "r_id").select("event_id", "r_id")


BLOCKS = "select l_orderkey as k, l_linenumber as n, l_linenumber * 40 + l_partkey % 30 as s, l_linenumber * 40 + l_partkey % 30 + l_quantity::bigint as e from lineitem"


def blocks(spark, sf):
    """Intervals (exon blocks) of an order (transcript)."""
    start = F.col("l_linenumber").cast("long") * 40 + F.col("l_partkey") % 30
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), start.alias("s"), (start + F.col("l_quantity").cast("long")).alias("e"))


@query(f"""with b as ({BLOCKS}) select a.k, a.n as n1, b.n as n2, least(a.e, b.e) - greatest(a.s, b.s) + 1 as shared from b a join b on a.k = b.k and a.n < b.n and a.s <= b.e and a.e >= b.s""")
def interval_overlap_pairs(spark, sf):
    """Overlapping pairs, each once, by bins."""
    b = blocks(spark, sf)
    a1, b1 = b.select("k", F.col("n").alias("n1"), F.col("s").alias("a_start"), F.col("e").alias("a_end")), b.select("k", F.col("n").alias("n2"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    pairs = relational.interval_join(a1, b1, ["k"], 64).filter("n1 < n2")
    return pairs.select("k", "n1", "n2", (F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1).alias("shared"))


@query(f"""with b as ({BLOCKS}) select a.k, a.n as n1, b.n as n2 from b a join b on a.k = b.k and a.n < b.n where least(a.e, b.e) + 1 - greatest(a.s, b.s) >= least(5, a.e - a.s + 1, b.e - b.s + 1)""")
def interval_overlap_at_least(spark, sf):
    """I7."""
    b = blocks(spark, sf).select("k", "n", F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("i"))
    pairs = b.select("k", F.col("n").alias("n1"), F.col("i").alias("a")).join(b.select("k", F.col("n").alias("n2"), F.col("i").alias("b")), "k").filter("n1 < n2")
    return pairs.filter(iv.overlaps_at_least(F.col("a"), F.col("b"), 5)).select("k", "n1", "n2")


@query(f"""with b as ({BLOCKS}), g as (select k, e, lead(s) over (partition by k order by s, n, e) as nx from b)
select k, count(*) filter (e + 1 < nx) as n_junctions, coalesce(sum(nx - e - 1) filter (e + 1 < nx), 0)::bigint as gap_length from g group by k""")
def junctions_from_blocks(spark, sf):
    """Introns of sorted blocks."""
    lists = blocks(spark, sf).groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("n"), F.col("e").alias("end")))).alias("b"))
    j = iv.junctions(F.col("b"))
    return lists.select("k", F.size(j).cast("long").alias("n_junctions"), iv.total_length(j).alias("gap_length"))


@query(f"""with b as ({BLOCKS}) select k, sum(e - s + 1)::bigint as total from b group by k""")
def interval_sum(spark, sf):
    """I10, A14."""
    return blocks(spark, sf).groupBy("k").agg(F.sum(F.col("e") - F.col("s") + 1).alias("total"))


MERGED = f"""with b as ({BLOCKS}), m as (select *, max(e) over (partition by k order by s, n rows between unbounded preceding and 1 preceding) as r from b),
i as (select *, sum(case when s > r then 1 else 0 end) over (partition by k order by s, n rows unbounded preceding) as island from m)"""


@query(MERGED + """ select k, island::bigint as island, min(s) as s, max(e) as e, count(*) as n from i group by k, island""")
def merged_intervals(spark, sf):
    """Unions of overlapping blocks."""
    return ordered.merge_intervals(blocks(spark, sf).withColumnRenamed("n", "line"), ["k"], "s", "e", "line")


@query(MERGED + """, u as (select k, island, min(s) as s, max(e) as e from i group by k, island)
select k, round(sum(e - s + 1) / (max(e) - min(s) + 1)::double, 6) as covered from u group by k""")
def coverage_fraction(spark, sf):
    """Covered share of the span."""
    u = ordered.merge_intervals(blocks(spark, sf).withColumnRenamed("n", "line"), ["k"], "s", "e", "line")
    return u.groupBy("k").agg(F.round(F.sum(F.col("e") - F.col("s") + 1) / (F.max("e") - F.min("s") + 1), 6).alias("covered"))


@query(f"""with b as ({BLOCKS}), x as (select k, s as pt, 1 as d from b union all select k, e + 1, -1 from b), g as (select k, pt, sum(d) as d from x group by k, pt),
c as (select k, pt, sum(d) over (partition by k order by pt) as depth, lead(pt) over (partition by k order by pt) - 1 as till from g)
select k, pt as s, till as e, depth::bigint as depth from c where depth > 0""")
def split_segments(spark, sf):
    """P10: elementary segments with their depth."""
    return ordered.split_segments(blocks(spark, sf), ["k"], "s", "e")


@query("""select k, case when ina and inb then 'both' when ina then 'a' else 'b' end as side from (
select k, bool_or(a) as ina, bool_or(not a) as inb from (select distinct l_partkey as k, true as a from lineitem where l_returnflag = 'R' union all select distinct l_partkey, false from lineitem where l_shipdate < date '1995-01-01') group by k)""")
def set_report(spark, sf):
    """U1, U7."""
    lines = table(spark, sf, "lineitem")
    both = relational.set_report(lines.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), lines.filter("l_shipdate < date'1995-01-01'").select(F.col("l_partkey").alias("k")), "k")
    return both.select("k", F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "a").otherwise("b").alias("side"))


@query("""select l_suppkey as k from lineitem where l_returnflag = 'R' intersect select s_suppkey from supplier where s_acctbal > 0""")
def set_intersect(spark, sf):
    """U1."""
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(table(spark, sf, "supplier").filter("s_acctbal > 0").select("s_suppkey"))


@query("""select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'F'""")
def set_except(spark, sf):
    """U11."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@query("""select n_name as name from nation union select r_name from region""")
def set_union(spark, sf):
    """U6."""
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf, "region").select("r_name")).distinct()


@query("""with a as (select user_id, list_sort(list_distinct(list(event_type))) as t from events where event_id % 2 = 0 group by 1), b as (select user_id, list_sort(list_distinct(list(event_type))) as t from events where event_id % 2 = 1 group by 1)
select coalesce(a.user_id, b.user_id) as user_id, array_to_string(case when a.t is null then b.t when b.t is null then a.t else list_sort(list_intersect(a.t, b.t)) end, ',') as types from a full join b on a.user_id = b.user_id""")
def map_merge(spark, sf):
    """U4: merged maps of sets."""
    def of(r):
        return table(spark, sf, "events").filter(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return relational.merge_collections(of(0), of(1), "user_id", "t").select("user_id", F.array_join("t", ",").alias("types"))


@query("""with c as (select user_id, count(*) filter (event_type = 'click') - count(*) filter (event_type = 'view') as a, count(*) filter (value > 50) - 3 as b, count(*) - 10 as c, hash_seed.x as d from events, (select 1 as x) hash_seed group by user_id, hash_seed.x),
p as (select user_id, [sign(a), sign(b), sign(c)]::int[] as p, [sign(b), sign(c), sign(a)]::int[] as q from c)
select user_id, list_sum(list_transform([1, 2, 3], lambda i: case when p[i] <> 0 and q[i] <> 0 and p[i] <> q[i] then 1 else 0 end))::int as diff from p""")
def profile_diff(spark, sf):
    """P5: places where two ternary profiles contradict each other."""
    c = table(spark, sf, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "click") - F.count_if(F.col("event_type") == "view")).alias("a"), (F.count_if(F.col("value") > 50) - 3).alias("b"), (F.count("*") - 10).alias("c"))
    p = [F.signum(x).cast("int") for x in ("a", "b", "c")]
    return c.select("user_id", pf.diff_only_present(F.array(*p), F.array(p[1], p[2], p[0])).alias("diff"))


@query("""with v as (select user_id, extract(hour from ts) // 6 as i, case when value > 60 then 1 when value < 30 then -1 else 0 end as v from events),
c as (select user_id, i, count(*) filter (v > 0) as p, count(*) filter (v < 0) as m from v group by user_id, i)
select user_id, i::int as i, case when p = 0 and m = 0 then 0 when m = 0 or p >= 5 * m then 1 when p = 0 or m >= 5 * p then -1 end::int as vote from c""")
def consensus_vote(spark, sf):
    """Majority vote with a ratio of five."""
    v = table(spark, sf, "events").select("user_id", F.floor(F.hour("ts") / 6).cast("int").alias("i"), F.when(F.col("value") > 60, 1).when(F.col("value") < 30, -1).otherwise(0).alias("v"))
    c = v.groupBy("user_id", "i").agg(F.count_if(F.col("v") > 0).alias("p"), F.count_if(F.col("v") < 0).alias("m"))
    vote = F.expr("case when p = 0 and m = 0 then 0 when m = 0 or p >= 5 * m then 1 when p = 0 or m >= 5 * p then -1 end")
    return c.select("user_id", "i", vote.alias("vote"))


@query("""select l_suppkey, l_partkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1""")
def duplicate_groups(spark, sf):
    """A6."""
    return aggregate.duplicated(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"])


@query("""select a.c_custkey as a, b.s_suppkey as b from customer a join supplier b on a.c_nationkey = b.s_nationkey and abs(a.c_acctbal - b.s_acctbal) <= 50""")
def near_value_join(spark, sf):
    """Values within a tolerance of each other, by bins."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("y"))
    left = a.withColumn("bin", F.floor(F.col("x") / 50))
    right = b.withColumn("bin", F.explode(F.array(*[F.floor(F.col("y") / 50) + i for i in (-1, 0, 1)])))
    return left.join(right, ["k", "bin"]).filter(F.abs(F.col("x") - F.col("y")) <= 50).select("a", "b")
