"""Queries over the operators of domain, pipelines and simulate, and over interval, profile and sequence expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlake.functions import align
from strandlake.functions import interval as iv
from strandlake.functions import profile as pf
from strandlake.functions import sequence as sq
from strandlake.operators import aggregate, domain, ordered, pipelines, relational, simulate, stats
from strandlake.plans.catalog import query, table
from strandlake.plans.scans import EXONS, exons, features, number, transcripts
from strandlake.plans.sequences import BASES, bases
from strandlake.streaming import streams

# Intervals

PAIRS = f"with {EXONS}, p as (select a.t, a.n as n1, b.n as n2, a.s as s1, a.e as e1, b.s - 100 as s2, b.e - 100 as e2 from ex a join ex b on a.t = b.t and b.n = a.n + 1)"


def pairs(spark, sf):
    """Neighbouring exons of a transcript, the second moved over the first."""
    x = exons(spark, sf)
    a = x.select("t", F.col("n").alias("n1"), F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("a"))
    b = x.select("t", (F.col("n") - 1).alias("n1"), F.struct((F.col("s") - 100).alias("start"), (F.col("e") - 100).alias("end")).alias("b"))
    return a.join(b, ["t", "n1"])


@query(PAIRS + """ select t, n1, s1 <= e2 and e1 >= s2 as ovl, e1 < s2 as lft, s1 > e2 as rgt, s1 <= s2 and e1 >= e2 as con, s1 - 5 <= s2 and e1 + 5 >= e2 as app, abs(s1 - s2) <= 3 and abs(e1 - e2) <= 3 as eq,
s1 <= s2 and e1 >= s2 and e1 < e2 as cs, s1 > s2 and s1 <= e2 and e1 >= e2 as ce, round(greatest(0, least(e1, e2) - greatest(s1, s2) + 1) / least(e1 - s1 + 1, e2 - s2 + 1)::double, 6) as frac,
s1 > s2 and e1 < e2 as inn, s1 = s2 and e1 < e2 as st, e1 = e2 and s1 > s2 as en from p""")
def interval_predicates(spark, sf):
    """I1-I6, I9, I18."""
    a, b = F.col("a"), F.col("b")
    return pairs(spark, sf).select("t", "n1", iv.overlaps(a, b).alias("ovl"), iv.left_of(a, b).alias("lft"), iv.right_of(a, b).alias("rgt"), iv.contains(a, b).alias("con"), iv.contains(a, b, 5).alias("app"), iv.equal_ranges(a, b, 3).alias("eq"), iv.covers_start(a, b).alias("cs"), iv.covers_end(a, b).alias("ce"), F.round(iv.overlap_fraction(a, b), 6).alias("frac"), iv.range_in(a, b).alias("inn"), iv.range_at_start(a, b).alias("st"), iv.range_at_end(a, b).alias("en"))


LISTS = f"with {EXONS}, one as (select g, s, e from ex where t % 8 = 0), two as (select g, s, e from ex where t % 8 = 1), both_g as (select g from one intersect select g from two)"


def lists(spark, sf):
    """Two transcripts of a gene, side by side."""
    t = transcripts(spark, sf)
    return t.filter("t % 8 = 0").select("g", F.col("exons").alias("a")).join(t.filter("t % 8 = 1").select("g", F.col("exons").alias("b")), "g")


@query(LISTS + """ select g, (select count(*) from one a join two b on a.g = b.g and a.s <= b.e and a.e >= b.s where a.g = k.g) > 0 as any_overlap,
coalesce((select sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1)) from one a join two b on a.g = b.g where a.g = k.g), 0)::bigint as shared,
coalesce((select sum(least(e, 250) - s + 1) from one where g = k.g and s <= 250), 0)::bigint as before, coalesce((select sum(e - greatest(s, 250) + 1) from one where g = k.g and e >= 250), 0)::bigint as after from both_g k""")
def interval_lists(spark, sf):
    """Overlap, shared length and clipping of sorted lists."""
    a, b = F.col("a"), F.col("b")
    return lists(spark, sf).select("g", iv.lists_overlap(a, b).alias("any_overlap"), iv.shared_length(a, b).alias("shared"), iv.total_length(iv.until(a, F.lit(250))).alias("before"), iv.total_length(iv.starting_from(a, F.lit(250))).alias("after"))


@query(LISTS + """, sp as (select k.g, (select min(s) from one where g = k.g) as lo1, (select max(e) from one where g = k.g) as hi1, (select min(s) from two where g = k.g) as lo2, (select max(e) from two where g = k.g) as hi2 from both_g k), al as (select * from one union all select * from two)
select g, coalesce((select sum(least(e, greatest(lo1, lo2) - 1) - s + 1) from al where al.g = sp.g and s <= greatest(lo1, lo2) - 1), 0)::bigint as left_unique, coalesce((select sum(e - greatest(s, least(hi1, hi2) + 1) + 1) from al where al.g = sp.g and e >= least(hi1, hi2) + 1), 0)::bigint as right_unique from sp""")
def interval_trailing_unique(spark, sf):
    """I14."""
    u = iv.trailing_unique(F.col("a"), F.col("b"))
    return lists(spark, sf).select("g", iv.total_length(u["left"]).alias("left_unique"), iv.total_length(u["right"]).alias("right_unique"))


@query(LISTS + """, x as (select a.g, a.s, a.e, b.s as s2, b.e as e2, greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1) as o from one a join two b on a.g = b.g)
select g, s, bool_or(s - 4 <= s2 and e + 4 >= e2) as holds, bool_or(abs(s - s2) <= 2 and abs(e - e2) <= 2) as equals, round(max(o / (e - s + 1)::double), 6) as best, first(s2 order by o desc, s2) filter (o > 0) as best_start from x group by g, s, e""")
def interval_best_feature(spark, sf):
    """I16, I17."""
    rows = lists(spark, sf).select("g", "b", F.explode("a").alias("x"))
    x, b = F.col("x"), F.col("b")
    return rows.select("g", F.col("x.start").alias("s"), iv.contains_any(x, b, 4).alias("holds"), iv.equals_any(x, b, 2).alias("equals"), F.round(iv.best_fraction(x, b), 6).alias("best"), iv.best_feature(x, b)["start"].alias("best_start"))


@query(f"""with {EXONS} select t, sum(case when strand = '-' then case when s <= 349 and least(e, 349) >= 120 then least(e, 349) - greatest(s, 120) + 1 else 0 end else case when e >= 301 and greatest(s, 301) <= 620 then least(e, 620) - greatest(s, 301) + 1 else 0 end end)::bigint as utr from ex group by t""")
def utr_lengths(spark, sf):
    """Exonic bases between coding end and poly-A site."""
    minus = F.col("strand") == "-"
    blocks = iv.utr_blocks(F.col("exons"), F.when(minus, 350).otherwise(300), F.when(minus, 120).otherwise(620), F.col("strand"))
    return transcripts(spark, sf).select("t", iv.total_length(blocks).alias("utr"))


# Profiles: arrays of four signs of a customer's orders

SIGNS = "with c as (select o_custkey as k, min(o_orderkey) as x, max(o_orderkey) as y, count(*) as z from orders group by 1), p as (select k, [x % 3 - 1, y % 3 - 1, z % 3 - 1, (x + y) % 3 - 1]::bigint[] as a, [y % 3 - 1, z % 3 - 1, (x + z) % 3 - 1, x % 3 - 1]::bigint[] as b from c)"


def signs(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("x"), F.max("o_orderkey").alias("y"), F.count("*").alias("z"))
    x, y, z = (F.col(n) for n in "xyz")
    return c.select("k", F.array(x % 3 - 1, y % 3 - 1, z % 3 - 1, (x + y) % 3 - 1).alias("a"), F.array(y % 3 - 1, z % 3 - 1, (x + z) % 3 - 1, x % 3 - 1).alias("b"))


FIRST, LAST = "coalesce(list_position(list_transform(a, lambda v: v <> 0), true), 0)", "case when list_contains(list_transform(a, lambda v: v <> 0), true) then 5 - list_position(list_reverse(list_transform(a, lambda v: v <> 0)), true) else 0 end"


@query(SIGNS + f""", f as (select *, {FIRST} as lo, {LAST} as hi from p) select k, array_to_string(list_transform(range(1, 5), lambda i: case when lo > 0 and a[i] = 0 and i > lo and i < hi then -1 else a[i] end), ',') as filled,
case when list_contains(list_transform(range(1, 5), lambda i: a[i] <> 0 and b[i] <> 0 and a[i] <> b[i]), true) then null else array_to_string(list_transform(range(1, 5), lambda i: case when a[i] = 0 then b[i] else a[i] end), ',') end as merged,
list_sum(list_transform(range(1, 5), lambda i: case when a[i] * b[i] < 0 then abs(a[i]) else 0 end))::bigint as signed, array_to_string(list_transform(range(1, 5), lambda i: case when a[i] = b[i] then 1 else 0 end), ',') as matching,
list_sum(list_transform(range(1, 5), lambda i: case when lo > 0 and a[i] = 0 and i > lo and i < hi then 1 else 0 end)) = 0 as complete from f""")
def profile_expressions(spark, sf):
    """P2-P4, P6, P7, P23."""
    a, b = F.col("a"), F.col("b")
    return signs(spark, sf).select("k", F.array_join(pf.fill_gaps(a), ",").alias("filled"), F.array_join(pf.merge(a, b), ",").alias("merged"), pf.signed_cover_diff(a, b).alias("signed"), F.array_join(pf.matching_places(a, b), ",").alias("matching"), pf.is_complete(a).alias("complete"))


@query(SIGNS + ", o as (select k, a, b, list_position(a, 1) as lo, 5 - list_position(list_reverse(a), 1) as hi from p) select k, case when not list_contains(a, 1) then null else a[lo:hi] = b[lo:hi] end as part from o")
def profile_part(spark, sf):
    """P8."""
    return signs(spark, sf).select("k", pf.is_subprofile(F.col("a"), F.col("b")).alias("part"))


@query(LISTS + """, f as (select b.g, b.s, b.e, (select count(*) from one a where a.g = b.g and abs(a.s - b.s) <= 5 and abs(a.e - b.e) <= 5) as eq, (select count(*) from one a where a.g = b.g and a.s <= b.e and a.e >= b.s) as ov, (select count(*) from one a where a.g = b.g and a.s <= b.s and a.e >= b.e) as hold from two b where g in (select g from both_g))
select g, string_agg(case when eq > 0 then 1 when ov > 0 then -1 else 0 end::varchar, ',' order by s) as profile, string_agg(case when hold > 0 then 1 else -1 end::varchar, ',' order by s) as hot from f group by g""")
def feature_profiles(spark, sf):
    """One transcript's blocks against the features of another."""
    return lists(spark, sf).select("g", F.array_join(pf.feature_profile(F.col("a"), F.col("b"), 5), ",").alias("profile"), F.array_join(pf.one_hot(F.col("a"), F.col("b")), ",").alias("hot"))


@query(LISTS + ", f as (select b.g, b.s, (select count(*) from one a where a.g = b.g and a.s <= b.e and a.e >= b.s) > 0 as hit from two b where g in (select g from both_g)), m as (select *, min(s) filter (hit) over (partition by g) as lo, max(s) filter (hit) over (partition by g) as hi from f) select g, string_agg(case when hit then 1 when s > lo and s < hi then -1 else 0 end::varchar, ',' order by s) as vector from m group by g")
def exon_vectors(spark, sf):
    """P21."""
    return lists(spark, sf).select("g", F.array_join(domain.exon_vector(F.col("a"), F.col("b")), ",").alias("vector"))


# Filters and joins


@query("with c as (select l_partkey as exon, count(*) filter (l_returnflag = 'R') as i, count(*) filter (l_returnflag <> 'R') as e from lineitem group by 1) select exon, i as include, e as exclude from c where i + e >= 5 and least(i, e) > 0")
def exon_count_filter(spark, sf):
    """F15."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("exon")).agg(F.count_if(F.col("l_returnflag") == "R").alias("include"), F.count_if(F.col("l_returnflag") != "R").alias("exclude"))
    return domain.filter_exon_counts(c, 5)


@query("select c_custkey from customer where c_acctbal >= 500 and c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def quality_filter(spark, sf):
    """F16."""
    ids = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return domain.quality_whitelist(table(spark, sf, "customer"), "c_acctbal", 500, ids, "c_custkey").select("c_custkey")


@query(f"select p_partkey, length(regexp_extract(s, '(A*)$', 1))::int as tail from (select p_partkey, {BASES} as s from part)")
def trailing_runs(spark, sf):
    """F17."""
    return bases(spark, sf).select("p_partkey", sq.trailing_run("seq", "A").alias("tail"))


@query("with c as (select l_suppkey as k, l_returnflag as s, count(*) as n from lineitem group by 1, 2), f as (select k from c group by k having avg(n) >= 5) select k, s, n from c where k in (select k from f) and k in (select k from c group by k having min(n) >= 3) and k in (select k from c group by k having max(n) >= 6)")
def coverage_strategies(spark, sf):
    """all, any and the mean."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("s")).agg(F.count("*").alias("n"))
    return pipelines.coverage_filter(pipelines.coverage_filter(pipelines.coverage_filter(c, "k", "n", 1, 3), "k", "n", 2, 6), "k", "n", 3, 5)


@query(f"""with i as (select 'g' || o_custkey as g, 't' || o_orderkey as t, o_totalprice as tpm, {number("'4|t' || o_orderkey")} < 0.3 and o_totalprice >= 1000 as h from orders), k as (select *, count(*) filter (not h) over (partition by g) as kept, row_number() over (partition by g order by tpm desc, t) as n from i) select t as transcript_id, h and not (kept = 0 and n = 1) as held_out from k""")
def hold_out_isoforms(spark, sf):
    """A repeatable part of the expressed ones, never all of a gene."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("g"), "o_custkey").alias("gene_id"), F.concat(F.lit("t"), "o_orderkey").alias("transcript_id"), F.col("o_totalprice").alias("tpm"))
    return domain.hold_out(o, 4, 0.3, 1000).select("transcript_id", "held_out")


@query("select 'E' || c_custkey || '.' || c_nationkey as full_id, 'E' || c_custkey as short from customer where c_custkey in (select o_custkey from orders)")
def versions_restored(spark, sf):
    """F27, X15."""
    full = table(spark, sf, "customer").select(F.concat(F.lit("E"), "c_custkey", F.lit("."), "c_nationkey").alias("id"))
    short = table(spark, sf, "orders").select(F.concat(F.lit("E"), "o_custkey").alias("short")).distinct()
    return domain.restore_versions(short, full, "id").select("full_id", "short")


@query("select c_custkey, split_part(c_name, '#', 1) as head, split_part(c_name, '#', 2) as tail from customer")
def column_parts(spark, sf):
    """F28, F29."""
    return domain.split_column(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", ["head", "tail"], "#")


@query("with t as (select o_custkey as test, count(*) as n, min(o_orderkey) as a, max(o_orderkey) as b from orders group by 1) select test from t where n >= 3 and b - a >= 500 and (test % 10) / 10.0 <= 0.6")
def exon_polya_tests(spark, sf):
    """F30."""
    t = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("test")).agg(F.count("*").alias("n_combinations"), F.min("o_orderkey").alias("polya1"), F.max("o_orderkey").alias("polya2")).withColumn("a_fraction", (F.col("test") % 10) / 10)
    return domain.exon_polya_filter(t, 3, 500, 0.6).select("test")


@query("select o_orderkey as read, case when c_mktsegment = 'BUILDING' then c_name || '_' || n_name end as group_id from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def cells_merged(spark, sf):
    """Reads, cells and cell types."""
    reads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("read"), F.col("o_custkey").alias("barcode_id"))
    barcodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("barcode_id"), F.col("c_custkey").alias("cell_id"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "singlet").otherwise("doublet")
    cells = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("cell_id"), kind.alias("spot_type"), F.col("c_name").alias("cell_type1"), F.col("n_name").alias("region"))
    return domain.merge_cells(reads, barcodes, cells).select("read", "group_id")


@query("""with a as (select event_id as i, case when event_id % 3 = 0 then '*' else 'A' || user_id end as b, repeat('A', (event_id % 12)::int) as u from events), c as (select event_id as i, case when event_id % 5 = 0 then '*' else 'B' || user_id end as b, repeat('C', (event_id % 11)::int) as u from events)
select i as read_id, case when a.b = '*' then c.b when c.b = '*' then a.b when abs(length(c.u) - 9) < abs(length(a.u) - 9) then c.b else a.b end as barcode, case when a.b = '*' then c.u when c.b = '*' then a.u when abs(length(c.u) - 9) < abs(length(a.u) - 9) then c.u else a.u end as umi from a join c using (i)""")
def two_callers(spark, sf):
    """The better of two tools' calls."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    a = e.select(i.alias("read_id"), F.when(i % 3 == 0, "*").otherwise(F.concat(F.lit("A"), "user_id")).alias("barcode"), F.repeat(F.lit("A"), (i % 12).cast("int")).alias("umi"))
    b = e.select(i.alias("read_id"), F.when(i % 5 == 0, "*").otherwise(F.concat(F.lit("B"), "user_id")).alias("barcode"), F.repeat(F.lit("C"), (i % 11).cast("int")).alias("umi"))
    return domain.merge_two_calls(a, b)


MD5_BASES = "translate(md5({}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""with r as (select o_orderkey as read_id, {MD5_BASES.format("(o_custkey % 60)::varchar")} as b from orders), c as (select substr({MD5_BASES.format("k::varchar")}, 1, case when k % 2 = 0 then 16 else 14 end) as b, k % 5 as cluster from range(0, 40) t(k))
select read_id, coalesce(x.cluster, y.cluster)::bigint as cluster from r left join c x on x.b = substr(r.b, 1, 16) left join c y on y.b = substr(r.b, 1, 14) where coalesce(x.cluster, y.cluster) is not null""")
def clusters_by_barcode(spark, sf):
    """By the longest prefix that is known."""
    mer = lambda c: F.translate(F.md5(c.cast("string")), "0123456789abcdef", "ACGT" * 4)
    reads = table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), mer(F.col("o_custkey") % 60).alias("barcode_read"))
    known = spark.range(40).select(F.substring(mer(F.col("id")), F.lit(1), F.when(F.col("id") % 2 == 0, 16).otherwise(14)).alias("barcode"), (F.col("id") % 5).alias("cluster"))
    return domain.cluster_of_barcode(reads, known).select("read_id", "cluster")


@query(LISTS + """, x as (select a.g, a.s, a.e, b.s as s2, b.e as e2, least(a.e, b.e) - greatest(a.s, b.s) + 1 as o from one a left join two b on a.g = b.g and a.s <= b.e and a.e >= b.s)
select g as gene_id, s as start, case when bool_or(s = s2 and e = e2) then s else first(s2 order by o desc, s2) filter (s2 is not null) end as normal_start from x where g in (select g from two) group by g, s, e""")
def exons_normalised(spark, sf):
    """J19, G8."""
    x = exons(spark, sf)
    own = x.filter("t % 8 = 0").select(F.col("g").alias("gene_id"), F.col("s").alias("start"), F.col("e").alias("end"))
    known = x.filter("t % 8 = 1").select(F.col("g").alias("gene_id"), F.col("s").alias("start"), F.col("e").alias("end"))
    return domain.normalise_exons(own.join(known.select("gene_id").distinct(), "gene_id", "left_semi"), known).select("gene_id", "start", F.col("normal.start").alias("normal_start"))


@query("select c_nationkey as gene_id, count(*)::bigint as count, round(count(*) * 1e6 / (select count(*) from orders), 4) as tpm from orders join customer on o_custkey = c_custkey group by 1")
def counts_by_gene(spark, sf):
    """A lookup that must succeed, sums and TPM."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("transcript_id")).agg(F.count("*").alias("count"))
    genes = table(spark, sf, "customer").select(F.col("c_custkey").alias("transcript_id"), F.col("c_nationkey").alias("gene_id"))
    return domain.gene_counts(counts, genes).select("gene_id", "count", F.round("tpm", 4).alias("tpm"))


@query("select event_id as barcode, 'G' || user_id % 20 as name from events")
def guides_by_key(spark, sf):
    """A join on the first tokens of a key."""
    b = table(spark, sf, "events").select(F.col("event_id").alias("barcode"), F.concat(F.lit("a_b_"), F.col("user_id") % 20, F.lit("_"), "event_id").alias("name_key"))
    guides = spark.range(20).select(F.concat(F.lit("a_b_"), "id").alias("key"), F.concat(F.lit("G"), "id").alias("name"))
    return domain.truncated_key_join(b, guides, "name_key").select("barcode", "name")


@query("select c_custkey from customer where substr(c_name, 10, 6) in (select substr(c_name, 10, 6) from customer where c_custkey % 2 = 0) and substr(c_name, 16, 3) in (select substr(c_name, 16, 3) from customer where c_custkey % 3 = 0)")
def barcode_parts(spark, sf):
    """A two-part whitelist without its product."""
    c = table(spark, sf, "customer").select("c_custkey", F.substring("c_name", 10, 9).alias("barcode"))
    one = c.filter("c_custkey % 2 = 0").select(F.substring("barcode", 1, 6).alias("part1")).distinct()
    two = c.filter("c_custkey % 3 = 0").select(F.substring("barcode", 7, 3).alias("part2")).distinct()
    return relational.split_barcode_join(c, one, two, "barcode", 6).select("c_custkey")


@query("with c as (select l_partkey as exon, l_suppkey as barcode, count(*) filter (l_returnflag = 'R') as i, count(*) filter (l_returnflag = 'A') as e from lineitem group by 1, 2) select s_nationkey as grp, sum(i)::bigint as include, sum(e)::bigint as exclude, count(*) as exons from c join supplier on barcode = s_suppkey where i + e > 0 group by 1")
def counts_by_group(spark, sf):
    """J27, J28."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("exon"), F.col("l_suppkey").alias("barcode")).agg(F.count_if(F.col("l_returnflag") == "R").alias("include"), F.count_if(F.col("l_returnflag") == "A").alias("exclude"))
    groups = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("barcode"), F.col("s_nationkey").alias("grp"))
    return domain.grouped_counts(c, groups, "barcode", ["include", "exclude"]).groupBy("grp").agg(F.sum("include").alias("include"), F.sum("exclude").alias("exclude"), F.count("*").alias("exons"))


@query("""with a as (select o_orderkey as read_id, 'c' || o_custkey % 3 as chr, case when o_orderkey % 4 = 0 then 256 else 0 end as flag from orders where o_orderkey % 3 <> 0), b as (select o_orderkey as read_id, 'c' || o_custkey % 5 as chr, case when o_orderkey % 7 = 0 then 2048 else 16 end as flag from orders)
select b.read_id, b.chr as corrected, x.chr as raw from b left join (select * from a where flag = 0) x on b.read_id = x.read_id where b.flag = 16""")
def paired_runs(spark, sf):
    """A read's primary alignments in two runs."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    rest = [F.lit(1).alias("start"), F.lit(60).alias("mapq"), F.lit("5M").alias("cigar")]
    a = o.filter(k % 3 != 0).select(k.alias("read_id"), F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("chr"), F.when(k % 4 == 0, 256).otherwise(0).alias("flag"), *rest)
    b = o.select(k.alias("read_id"), F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("chr"), F.when(k % 7 == 0, 2048).otherwise(16).alias("flag"), *rest)
    return domain.paired_alignments(a, b).select("read_id", F.col("corrected.chr").alias("corrected"), F.col("raw.chr").alias("raw"))


@query("select case when n_nationkey is null then 'c' || c_custkey else 'c' || c_custkey || '_' || n_name end as id from customer left join (select * from nation where n_regionkey < 2) on c_nationkey = n_nationkey")
def contigs_tagged(spark, sf):
    """J32."""
    names = table(spark, sf, "customer").join(table(spark, sf, "nation").filter("n_regionkey < 2"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("n_name").alias("dataset"))
    return domain.tag_contigs(table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")), names)


@query("with c as (select l_partkey as pos, l_returnflag as f, count(*) as cov, count(*) filter (l_linestatus = 'O') as r from lineitem group by 1, 2), k as (select pos, count(distinct f) as n, round(sum(r) / sum(cov)::double, 6) as freq, max(r / cov::double) as m from c where cov >= 3 group by 1) select pos, freq from k where n = 3 and m >= 0.5")
def common_snps(spark, sf):
    """Variants that all tables have."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos"), "l_returnflag").agg(F.count("*").alias("cov"), F.count_if(F.col("l_linestatus") == "O").alias("reads")).withColumns({"chr": F.lit("1"), "ref": F.lit("A"), "alt": F.lit("G")})
    parts = [c.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "ANR"]
    return domain.intersect_snps(parts, 3, 0.5).select("pos", F.round("freq", 6).alias("freq"))


@query("select n_nationkey as gene_id, count(distinct s_suppkey) as n_paralogs, count(distinct case when s_acctbal > 0 then s_suppkey end) as n_coding from nation left join supplier on s_nationkey = n_nationkey group by 1")
def paralogs_of_genes(spark, sf):
    """J35."""
    p = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("gene_id"), F.col("s_suppkey").alias("paralog"), F.when(F.col("s_acctbal") > 0, "protein_coding").otherwise("other").alias("biotype"))
    return domain.paralog_report(table(spark, sf, "nation").select(F.col("n_nationkey").alias("gene_id")), p)


# Aggregations


@query("""select l_suppkey as chr, count(*) filter (l_returnflag = 'A') as "A", count(*) filter (l_returnflag = 'N') as "N", count(*) filter (l_returnflag = 'R') as "R", count(*) as total from lineitem group by 1 having count(*) >= 20""")
def counts_by_sample(spark, sf):
    """A1b, A12, R18."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chr"), F.col("l_returnflag").alias("s"))
    return domain.sample_counts(rows, "s", ["A", "N", "R"], 20)


@query("select user_id as barcode, count(distinct (event_type, event_id % 7)) as n_distinct from events group by 1")
def distinct_pairs(spark, sf):
    """A5, A36, A38, P63, P64."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("barcode"), "event_type", (F.col("event_id") % 7).alias("u"))
    return aggregate.distinct_per_key(rows, "barcode", "event_type", "u")


@query("select l_returnflag, l_suppkey, round(count(*) * 1e6 / sum(count(*)) over (partition by l_returnflag), 4)::double as cpm from lineitem group by 1, 2")
def counts_per_million(spark, sf):
    """Counts as shares of their sample."""
    c = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return c.select("l_returnflag", "l_suppkey", F.round(aggregate.share_of(F.col("n"), 1e6, ["l_returnflag"]), 4).alias("cpm"))


@query(f"""with {EXONS}, t as (select g, t, sum(e - s + 1) as len, count(*) as n from ex group by g, t) select 'g' || g as gene_id, max(len)::bigint as longest, floor(avg(len))::bigint as mean_length, bool_or(n > 1) as spliced, count(*) as n_transcripts, sum(n)::bigint as n_exons, least(max(len) // 1000, 5)::bigint as bin from t group by g""")
def lengths_of_genes(spark, sf):
    """A13-A16, P51."""
    return domain.gene_lengths(transcripts(spark, sf))


@query("with c as (select l_partkey as k, count(*) filter (l_returnflag = 'R')::double as a, count(*) filter (l_returnflag = 'N')::double as b from lineitem group by 1) select k, case when b = 0 then -1.0 else round(a / b, 6) end as change from c")
def fold_changes(spark, sf):
    """A31."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "R").cast("double").alias("a"), F.count_if(F.col("l_returnflag") == "N").cast("double").alias("b"))
    return c.select("k", F.round(aggregate.fold_change(F.col("a"), F.col("b")), 6).alias("change"))


@query("with r as (select l_partkey as t, l_suppkey % 6 as s, l_returnflag = 'R' as u, l_linestatus = 'O' as f from lineitem), p as (select t, s, count(*) as n, count(*) filter (u) as u, count(*) filter (u and f) as f from r group by 1, 2) select t as transcript_id, sum(n)::bigint as reads, sum(u)::bigint as \"unique\", sum(f)::bigint as full, count(*) filter (u >= 1) as u_in_1, count(*) filter (u >= 3) as u_in_3, count(*) filter (f >= 1) as f_in_1, count(*) filter (u >= 1) * 2 > 6 as broad from p group by t")
def transcripts_over_samples(spark, sf):
    """A32, A33."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("transcript_id"), (F.col("l_suppkey") % 6).alias("sample"), (F.col("l_returnflag") == "R").alias("is_unique"), (F.col("l_linestatus") == "O").alias("is_full"))
    return domain.sample_summary(rows, 6).select("transcript_id", "reads", "unique", "full", "u_in_1", "u_in_3", "f_in_1", "broad")


@query("select o_custkey, coalesce(sum(o_orderkey) filter (o_orderstatus = 'F'), 0)::bigint as first, coalesce(sum(o_orderkey) filter (o_orderstatus <> 'F'), 0)::bigint as other from orders group by 1")
def two_classes(spark, sf):
    """A35."""
    return domain.two_class_counts(table(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderkey")


@query("with e as (select user_id as r, event_type || '_x,' || case when event_id % 2 = 0 then 'polya' else 'tss+alt' end as ev, row_number() over (partition by user_id order by event_id) as n from events), one as (select * from e where n = 1) select count(*) as reads, count(*) filter (ev like 'view%') as view, count(*) filter (ev like '%,polya%') as polya, count(*) filter (ev like '%+alt%') as alt from one")
def read_event_flags(spark, sf):
    """A40, P42."""
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("read_id"), i.alias("isoform_id"), F.concat("event_type", F.lit("_x,"), F.when(i % 2 == 0, "polya").otherwise("tss+alt")).alias("events"))
    return domain.event_flags(rows, ["view", "polya", "alt"])


CODING = f"{EXONS}, cds as (select t, s + 10 as s, e as e from ex where n <= 3 and e - s >= 10), hit as (select ex.g, ex.t, ex.s, ex.e, ex.strand, greatest(0, least(ex.e, cds.e) - greatest(ex.s, cds.s) + 1) as shared from ex left join cds on ex.t = cds.t), cls as (select g, s, e, strand, bool_or(coalesce(shared > 0, false)) as is_cds, coalesce(max(shared / (e - s + 1)::double), 0) as coding_share, count(distinct t) as n_transcripts from hit group by g, s, e, strand)"


def with_coding(spark, sf):
    f = features(spark, sf).select("feature", "chr", "start", "end", "strand", "gene_id", "transcript_id")
    coding = exons(spark, sf).filter("n <= 3 and e - s >= 10").select(F.lit("CDS").alias("feature"), F.concat(F.lit("chr"), F.col("g") % 3).alias("chr"), (F.col("s") + 10).alias("start"), F.col("e").alias("end"), "strand", F.concat(F.lit("g"), "g").alias("gene_id"), F.concat(F.lit("t"), "t").alias("transcript_id"))
    return f.unionByName(coding)


@query(f"with {CODING} select 'g' || g as gene_id, s as start, e as \"end\", is_cds, round(coding_share, 6) as coding_share, n_transcripts from cls")
def exon_coding(spark, sf):
    """G7, A42."""
    return pipelines.exon_classes(with_coding(spark, sf)).select("gene_id", "start", "end", "is_cds", F.round("coding_share", 6).alias("coding_share"), "n_transcripts")


@query(f"with {CODING} select count(*) as exons, count(*) filter (is_cds) as coding, count(*) filter (not is_cds) as noncoding, count(*) filter (coding_share >= 1) as fully_coding, count(*) filter (coding_share > 0 and coding_share < 1) as partly_coding, round(avg(coding_share), 6) as mean_share from cls")
def exon_report(spark, sf):
    """A43, A44."""
    return domain.exon_summary(pipelines.exon_classes(with_coding(spark, sf))).withColumn("mean_share", F.round("mean_share", 6))


@query(f"select p_partkey, round(100.0 * (length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / length(s), 6) as gc, length(s)::int as length, coalesce(list_max(list_transform(regexp_extract_all(s, 'A+|C+|G+|T+|N+'), lambda x: length(x))), 0)::int as longest_run from (select p_partkey, {BASES} as s from part)")
def sequence_report(spark, sf):
    """A45, D16."""
    return domain.sequence_summary(bases(spark, sf)).select("p_partkey", F.round("gc", 6).alias("gc"), "length", "longest_run")


@query("with p as (select user_id as b, count(*) as n, count(*) filter (event_type = 'view') as c from events group by 1 having count(*) >= 2) select b as barcode, n as called, c as correct, round(100.0 * c / n, 6) as share, (floor(100.0 * c / n / 5) * 5)::int as bin, 100.0 * c / n <= 80 as poor from p")
def precision_of_barcodes(spark, sf):
    """A51."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("barcode"), F.when(F.col("event_type") == "view", F.col("user_id")).otherwise(-1).alias("truth"))
    return domain.precision_by_barcode(rows, 2).withColumn("share", F.round("share", 6))


@query("with a as (select user_id, list(distinct event_type) as c from events where event_id % 2 = 0 group by 1), b as (select user_id, list(distinct event_type) as t from events where event_id % 3 = 0 group by 1) select user_id, len(list_intersect(c, t))::int as common, len(list_filter(c, lambda x: not list_contains(t, x)))::int as extra, len(list_filter(t, lambda x: not list_contains(c, x)))::int as missed from a join b using (user_id)")
def several_barcodes(spark, sf):
    """A52."""
    e = table(spark, sf, "events")
    a = e.filter("event_id % 2 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("c"))
    b = e.filter("event_id % 3 = 0").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    o = aggregate.set_overlap_counts(F.col("c"), F.col("t"))
    return a.join(b, "user_id").select("user_id", o["common"].alias("common"), o["extra"].alias("extra"), o["missed"].alias("missed"))


@query("with c as (select l_partkey as pos, l_suppkey as s, count(*) as cov, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1, 2), p as (select pos, count(*) as n, count(*) filter (r > 0) as a from c group by 1) select least(10 * a // n, 9)::bigint as decile, count(*) as n from p group by 1")
def snp_deciles(spark, sf):
    """A55, A56."""
    c = table(spark, sf, "lineitem").groupBy(F.lit("1").alias("chr"), F.col("l_partkey").alias("pos"), F.lit("G").alias("alt"), "l_suppkey").agg(F.count("*").alias("cov"), F.count_if(F.col("l_returnflag") == "R").alias("reads"))
    return domain.abundance_deciles(c)


@query("select s_suppkey, round(((s_acctbal / 10000 >= 0.3)::int + (s_nationkey / 25.0 >= 0.3)::int) / 2.0, 6)::double as early, ((s_suppkey % 10) / 10.0 >= 0.3)::int::double as late from supplier")
def abundance_of_groups(spark, sf):
    """Shares of two ranges of samples that reach a frequency."""
    freqs = F.array(F.col("s_acctbal") / 10000, F.col("s_nationkey") / 25.0, (F.col("s_suppkey") % 10) / 10.0)
    shares = domain.group_abundance(freqs, {"early": (0, 2), "late": (2, 3)})
    return table(spark, sf, "supplier").select("s_suppkey", *[c.alias(n) for n, c in shares.items()])


@query("with r as (select l_quantity / 51.0 as l, l_discount as r, l_linenumber * 300 as len from lineitem), x as (select unnest([500, 1000, 2500]) as stratum), b as (select stratum, least(floor(l * 10), 9)::bigint as left_bin, least(floor(r * 100), 99)::bigint as right_bin, count(*) as n from r join x on len <= stratum group by 1, 2, 3) select stratum::int as stratum, left_bin, right_bin, n, round(n / sum(n) over (partition by stratum, left_bin), 6)::double as share from b")
def truncation_strata(spark, sf):
    """By cumulative strata of length."""
    rows = table(spark, sf, "lineitem").select((F.col("l_quantity") / 51.0).alias("left"), F.col("l_discount").alias("right"), (F.col("l_linenumber") * 300).alias("length"))
    return domain.truncation_histogram(rows, [500, 1000, 2500]).withColumn("share", F.round("share", 6))


@query("with r as (select (l_linenumber - 1) / 10.0 as a, l_tax as b from lineitem), s as (select round(a * 100)::int as lo, round((1 - b) * 100)::int - 1 as hi from r) select bin::int as bin, count(*) as n from s, range(0, 100) t(bin) where bin between lo and hi group by 1")
def coverage_bins(spark, sf):
    """A60."""
    return domain.coverage_profile(table(spark, sf, "lineitem").select(((F.col("l_linenumber") - 1) / 10.0).alias("left"), F.col("l_tax").alias("right")))


@query("with r as (select (c_custkey % 5)::int as c, 5 + c_custkey % 4 as m, 2 as i from customer), q as (select unnest(list_concat(list_concat(list_transform(range(0, c), lambda x: {'op': 'S', 'q': 10}), list_transform(range(0, m), lambda x: {'op': 'M', 'q': 30})), list_transform(range(0, i), lambda x: {'op': 'I', 'q': 5}))) as v from r) select v.op as op, v.q::int as quality, count(*) as n from q group by 1, 2")
def qualities_by_event(spark, sf):
    """Base qualities by what the CIGAR says of the base."""
    c, m = (F.col("c_custkey") % 5).cast("int"), (5 + F.col("c_custkey") % 4).cast("int")
    cigar = F.concat(F.when(c > 0, F.concat(c, F.lit("S"))).otherwise(""), m, F.lit("M3D2I"))
    qual = F.concat(F.repeat(F.lit("+"), c), F.repeat(F.lit("?"), m), F.lit("&&"))
    return domain.quality_by_event(table(spark, sf, "customer").select(cigar.alias("cigar"), qual.alias("qual")))


@query("select length::bigint as length, (select count(*) from lineitem where l_linenumber * 3 = length) as a, (select count(*) from lineitem where l_quantity = length) as b from range(1, 60) t(length)")
def length_spine(spark, sf):
    """Two inputs' lengths side by side, with those that nothing has."""
    rows = table(spark, sf, "lineitem")
    return domain.length_distribution({"a": rows.select((F.col("l_linenumber") * 3).alias("length")), "b": rows.select(F.col("l_quantity").cast("long").alias("length"))}, "length", 60)


@query("select o_custkey - case when o_orderkey % 3 = 0 then 7 else 0 end as pos, count(*) as n from orders where o_custkey - case when o_orderkey % 3 = 0 then 7 else 0 end between 50 and 199 group by 1")
def clipped_starts(spark, sf):
    """A64."""
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("start"), F.when(F.col("o_orderkey") % 3 == 0, "7S20M").otherwise("20M").alias("cigar"))
    return domain.end_positions(a, 50, 200)


@query("with r as (select l_partkey as pos, l_returnflag as sub, count(*) as reads from lineitem group by 1, 2) select sub, sum(reads)::bigint as reads, count(*) as places from r where (pos, sub) not in (select l_partkey, l_returnflag from lineitem where l_linestatus = 'F' and l_quantity < 10) group by 1")
def substitutions(spark, sf):
    """Those that the genome does not have."""
    rows = table(spark, sf, "lineitem").select(F.lit("1").alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("sub"), "l_linestatus", "l_quantity")
    return domain.substitution_counts(rows.groupBy("chr", "pos", "sub").agg(F.count("*").alias("reads")), rows.filter("l_linestatus = 'F' and l_quantity < 10"))


@query("select c_mktsegment as biotype, count(*) as n, count(*) filter (c_nationkey = 1) as unspliced, round(avg(c_acctbal), 2) as mean_length from customer where c_custkey in (select o_custkey from orders) group by 1")
def gene_set_report(spark, sf):
    """A67."""
    info = table(spark, sf, "customer").select(F.col("c_custkey").alias("gene_id"), F.col("c_mktsegment").alias("biotype"), F.col("c_nationkey").alias("mean_exons"), F.col("c_acctbal").alias("length"))
    genes = table(spark, sf, "orders").select(F.col("o_custkey").alias("gene_id")).distinct()
    return domain.gene_set_summary(genes, info).withColumn("mean_length", F.round("mean_length", 2))


@query("with c as (select l_partkey as g, l_linestatus as p, l_returnflag as f, count(*) as n from lineitem group by 1, 2, 3), b as (select g, f, first(p order by n desc, p desc) as p from c where g in (select g from c group by g having count(distinct p) = 2) group by g, f) select g as gene_id, string_agg(f || p, ',' order by f) as preferred from b group by g having count(distinct p) = 2")
def utr_preferences(spark, sf):
    """Genes of which groups prefer another poly-A site."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene_id"), F.col("l_linestatus").alias("polya"), F.col("l_returnflag").alias("grp")).agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("preferred")), lambda x: F.concat(x["key"], x["value"])), ",")
    return pipelines.utr_classes(c).select("gene_id", text.alias("preferred"))


@query("with s as (select l_partkey as g, l_suppkey % 3 = 0 as used, count(*) as n from lineitem group by l_partkey, l_suppkey) select g as gene_id, round(min(n) filter (used) / max(n) filter (not used)::double, 6) as ratio from s group by g")
def site_usage(spark, sf):
    """A69."""
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gene_id"), "l_suppkey").agg(F.count("*").alias("n")).withColumn("used", F.col("l_suppkey") % 3 == 0)
    return domain.used_site_ratio(s).withColumn("ratio", F.round("ratio", 6))


@query("select l_partkey as test, count(distinct (l_linestatus, l_returnflag = 'R')) as n_combinations from lineitem group by 1")
def site_combinations(spark, sf):
    """A70."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("test"), F.col("l_linestatus").alias("polya"), (F.col("l_returnflag") == "R").alias("has_exon"))
    return domain.site_exon_combinations(rows)


# Order, sets and sequences


@query(f"""with r as (select user_id, event_type, {number("'6|' || event_id")} as u from events), k as (select *, row_number() over (order by u) as rn, count(*) over () as n from r), f as (select min(rn) as rn from k group by user_id, event_type)
select step::int as step, (n * step // 10)::bigint as n_rows, (select count(*) from f where f.rn <= n * step // 10) as n_distinct from (select unnest(range(1, 11)) as step, (select max(n) from k) as n)""")
def saturation_shuffled(spark, sf):
    """The saturation curve in a repeatable random order."""
    return domain.shuffled_saturation(table(spark, sf, "events"), "event_id", ["user_id", "event_type"], 6)


@query(f"""with r as (select event_id, user_id as g from events), d as (select it, g, {number("'1|' || it || '|' || event_id")} as u from r, range(0, 20) t(it)), c as (select it, tenth, g, count(*) filter (u < tenth / 10.0) as n from d, range(1, 10) s(tenth) group by 1, 2, 3), k as (select it, tenth, count(*) filter (n >= 10) as genes from c group by 1, 2)
select tenth::bigint as tenth, quantile_cont(genes, 0.25) as q1, quantile_cont(genes, 0.5) as median, quantile_cont(genes, 0.75) as q3 from k group by 1""")
def subsampled_genes(spark, sf):
    """W12."""
    return domain.subsampling_curve(table(spark, sf, "events").select(F.col("event_id").alias("read_id"), F.col("user_id").alias("gene_id")))


@query(f"with {EXONS}, r as (select *, row_number() over (partition by t order by case when strand = '-' then s else -s end) as k, row_number() over (partition by t order by case when strand = '-' then -s else s end) as j from ex) select a.t, a.s as last_start, b.s as first_start from r a join r b on a.t = b.t where a.k = 1 and b.j = 1")
def terminal_exons(spark, sf):
    """By strand."""
    x = exons(spark, sf)
    last = ordered.terminal_feature(x, "t", "strand", "s").select("t", F.col("s").alias("last_start"))
    return last.join(ordered.terminal_feature(x, "t", "strand", "s", last=False).select("t", F.col("s").alias("first_start")), "t")


INTRONS = f"{EXONS}, nx as (select *, lead(s) over (partition by t order by s) as nx from ex), intr as (select distinct g, strand, e + 1 as a, nx - 1 as b from nx where nx is not null)"


@query(f"""with {INTRONS}, s as (select g, strand, a as anchor, string_agg(distinct b::varchar, ',' order by b::varchar) as sites, case when strand = '-' then 'donor' else 'acceptor' end as kind from intr group by g, strand, a having count(distinct b) > 1
union all select g, strand, b, string_agg(distinct a::varchar, ',' order by a::varchar), case when strand = '-' then 'acceptor' else 'donor' end from intr group by g, strand, b having count(distinct a) > 1) select 'g' || g as gene_id, anchor, sites, kind from s""")
def alternative_splice_sites(spark, sf):
    """Both strands alike."""
    text = F.array_join(F.array_sort(F.transform("sites", lambda x: x.cast("string"))), ",")
    return pipelines.alternative_sites(transcripts(spark, sf)).select("gene_id", "anchor", text.alias("sites"), "kind")


@query("""with c as (select l_suppkey as chr, l_linenumber as s, l_returnflag as f, sum(l_quantity)::bigint as i from lineitem group by 1, 2, 3) select s_suppkey as chr, n::int as start, coalesce((select sum(i) from c where c.chr = s_suppkey and c.s = n and f = 'A'), 0)::bigint as "A", coalesce((select sum(i) from c where c.chr = s_suppkey and c.s = n and f = 'R'), 0)::bigint as "R" from supplier, range(1, 10) t(n)""")
def counts_at_introns(spark, sf):
    """Several samples' counts at the places of a list."""
    c = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chr"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end"), F.col("l_quantity").cast("long").alias("include"), "l_returnflag")
    places = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("chr"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("start")).withColumn("end", F.col("start"))
    return domain.counts_by_chromosome([c.filter("l_returnflag = 'A'"), c.filter("l_returnflag = 'R'")], places, ["A", "R"]).drop("end")


@query("select o_orderkey, o_custkey, o_orderpriority, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) as place from orders")
def sorted_orders(spark, sf):
    """A total order, checked by its places."""
    rows = domain.sorted_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice", "o_orderkey", descending=["o_totalprice"])
    # The numbers are given to the sorted rows as they stand: by partition, then by place in it.
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    return placed.select("o_orderkey", "o_custkey", "o_orderpriority", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@query("select l_suppkey, first(l_returnflag order by n desc, l_returnflag desc) as l_returnflag, max(n) as n from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2) group by 1")
def largest_value(spark, sf):
    """T8."""
    c = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return domain.arg_max(c, "l_suppkey", "l_returnflag", "n")


@query("with x as (select user_id as k, event_type as v, event_id % 3 as f from events where event_id % 5 = 0), a as (select k, list(distinct v) as v from x where f = 0 group by 1), b as (select k, list(distinct v) as v from x where f = 1 group by 1), c as (select k, list(distinct v) as v from x where f = 2 group by 1), ab as (select coalesce(a.k, b.k) as k, case when a.v is null then b.v when b.v is null then a.v else list_intersect(a.v, b.v) end as v from a full join b on a.k = b.k), abc as (select coalesce(ab.k, c.k) as k, case when ab.v is null then c.v when c.v is null then ab.v else list_intersect(ab.v, c.v) end as v from ab full join c on ab.k = c.k) select k, v[1] as v from abc where len(v) = 1")
def folded_collections(spark, sf):
    """Maps of sets merged one after another, unique ones only."""
    x = table(spark, sf, "events").filter("event_id % 5 = 0").select(F.col("user_id").alias("k"), F.col("event_type").alias("v"), (F.col("event_id") % 3).alias("f"))
    parts = [x.filter(F.col("f") == i).groupBy("k").agg(F.collect_set("v").alias("v")) for i in range(3)]
    return relational.fold_collections(parts, "k", "v", unique_only=True).select("k", F.col("v")[0].alias("v"))


@query("with a as (select l_partkey as k from lineitem where l_returnflag = 'R' group by 1 having count(*) >= 10), b as (select l_partkey as k from lineitem where l_returnflag = 'A' group by 1 having count(*) >= 10) select coalesce(a.k, b.k) as k, a.k is not null as in_a, b.k is not null as in_b from a full join b on a.k = b.k")
def genes_in_both(spark, sf):
    """U8."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return domain.common_unique(rows.filter("l_returnflag = 'R'"), rows.filter("l_returnflag = 'A'"), "k", 10)


@query("select lower(c_mktsegment) || c_custkey % 40 as name, n_nationkey as value from customer left join nation on upper(lower(c_mktsegment) || c_custkey % 40) = 'BUILDING' || n_nationkey")
def names_to_ids(spark, sf):
    """Whatever the case; what is not found stays, without an id."""
    names = table(spark, sf, "customer").select(F.concat(F.lower("c_mktsegment"), F.col("c_custkey") % 40).alias("name"))
    ids = table(spark, sf, "nation").select(F.concat(F.lit("Building"), "n_nationkey").alias("name"), F.col("n_nationkey").alias("value"))
    return relational.name_lookup(names, ids, "name", "value").select("name", "value")


@query(f"""with s as (select p_partkey, {BASES} || 'X' as s, p_size from part) select p_partkey, reverse(translate(substr(s, 1, length(s) - 1), 'ACGT', 'TGCA')) as chomped, reverse(translate(replace(s, 'X', 'N'), 'ACGT', 'TGCA')) as strict, (length(s) - length(replace(replace(s, 'G', ''), 'C', '')))::int as gc,
substr(s, 2, 4) as cut, reverse(translate(substr(s, 2, 4), 'ACGT', 'TGCA')) as cut_minus, s || 'AAA' as tailed, 's_002um_' || p_size || '_' || p_partkey as spot, (p_partkey // 3600) || ':' || lpad(((p_partkey // 60) % 60)::varchar, 2, '0') || ':' || lpad((p_partkey % 60)::varchar, 2, '0') as time from s""")
def sequence_expressions(spark, sf):
    """X2, X3, X7b, X11, X22, X25, X26."""
    r = bases(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("s", F.concat("seq", F.lit("X")))
    two, five = F.lit(2), F.lit(5)
    return r.select("p_partkey", sq.revcomp_chomped("s").alias("chomped"), sq.revcomp_strict("s").alias("strict"), sq.count_chars("s", "GC").alias("gc"), sq.slice_1based("s", two, five).alias("cut"), sq.slice_1based("s", two, five, F.lit("-")).alias("cut_minus"), sq.append_polya("s", 3).alias("tailed"), sq.format_spot(F.col("p_size"), F.col("p_partkey")).alias("spot"), sq.human_time(F.col("p_partkey")).alias("time"))


def long_bases(spark, sf):
    """MD5 digests as sequences of 32."""
    return table(spark, sf, "part").select("p_partkey", F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "TTTTTTACGTACTTTT").alias("seq"))


LONG = "select p_partkey, translate(md5(p_partkey::varchar), '0123456789abcdef', 'TTTTTTACGTACTTTT') as s from part"


@query(f"""with l as ({LONG}), w as (select p_partkey, s, i, length(substr(s, i + 1, 16)) - length(replace(substr(s, i + 1, 16), 'T', '')) as c from l, range(0, 16) t(i)), f as (select p_partkey, any_value(s) as s, min(i) filter (c >= 12) as i from w group by 1)
select p_partkey, (case when i is null then -1 else i + greatest(instr(substr(s, i + 1), 'TTT') - 1, 0) end)::int as at from f""")
def polyt_windows(spark, sf):
    """The first dense window, moved to its first three in a row."""
    return long_bases(spark, sf).select("p_partkey", sq.first_dense_window("seq", "T").cast("int").alias("at"))


@query(f"with l as ({LONG}) select p_partkey, case when p_partkey % 2 = 0 then substr(s, 7, 4) else reverse(translate(substr(s, 21, 4), 'ACGT', 'TGCA')) end as lft, case when p_partkey % 2 = 0 then substr(s, 21, 4) else reverse(translate(substr(s, 7, 4), 'ACGT', 'TGCA')) end as rgt, case when p_partkey % 2 = 0 then substr(s, 2, 3) || substr(s, 8, 2) else reverse(translate(substr(s, 2, 3), 'ACGT', 'TGCA')) || reverse(translate(substr(s, 8, 2), 'ACGT', 'TGCA')) end as joined from l")
def sequence_ranges(spark, sf):
    """Flanks and ranges put together, by strand."""
    strand = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    f = sq.flanks("seq", F.lit(11), F.lit(20), strand, 4)
    ranges = F.array(F.struct(F.lit(2).alias("start"), F.lit(4).alias("end")), F.struct(F.lit(8).alias("start"), F.lit(9).alias("end")))
    return long_bases(spark, sf).select("p_partkey", f["left"].alias("lft"), f["right"].alias("rgt"), sq.concat_ranges("seq", ranges, strand).alias("joined"))


@query(f"with l as ({LONG}), d as (select p_partkey, s, d from l, range(-6, 7) t(d)) select p_partkey, (select substr(s, 3, 2) = 'GT' and substr(s, 9, 2) = 'AG' from l x where x.p_partkey = d.p_partkey) as canonical, first(d order by abs(d), d) filter (substr(s, (12 + d)::int, 2) = 'GT')::int as nearest from d group by p_partkey")
def splice_motifs(spark, sf):
    """X16, P44, X17."""
    r = long_bases(spark, sf)
    return r.select("p_partkey", sq.is_canonical(F.substring("seq", 3, 2), F.substring("seq", 9, 2), F.lit("+")).alias("canonical"), sq.nearest_site("seq", F.lit(12), "GT").alias("nearest"))


@query(f"with l as ({LONG}), t as (select p_partkey, i, substr(s, i::int, 12) as t from l, range(1, 33, 12) t(i)) select p_partkey, t as tile, substr(t, 1, 5) as r1, substr(reverse(translate(t, 'ACGT', 'TGCA')), 1, 5) as r2 from t where length(t) >= 8")
def read_tiles(spark, sf):
    """X19."""
    t = long_bases(spark, sf).select("p_partkey", F.posexplode(sq.tiles(F.col("seq"), 5, 12, 8)).alias("i", "t"), "seq")
    return t.select("p_partkey", F.substring(F.col("seq"), F.col("i") * 12 + 1, F.lit(12)).alias("tile"), "t.r1", "t.r2")


@query(f"with l as ({LONG}), m as (select p_partkey, s, reverse(s) as r from l) select p_partkey, case when p_partkey % 5 = 0 then substr(s, 1, 20) else array_to_string(list_transform(range(1, 33), lambda i: case when i % 3 >= 1 then substr(s, i, 1) else substr(r, i, 1) end), '') end as merged from m")
def merged_reads(spark, sf):
    """Base by base the one of higher quality, the shorter read where lengths differ."""
    r = long_bases(spark, sf).withColumn("back", F.reverse("seq"))
    short = F.col("p_partkey") % 5 == 0
    own = F.when(short, F.substring("seq", 1, 20)).otherwise(F.col("seq"))
    quality = F.lit("".join("!" if i % 3 == 0 else "I" for i in range(1, 33)))
    return r.select("p_partkey", sq.merge_by_quality(own, F.when(short, F.substring(quality, 1, 20)).otherwise(quality), F.col("back"), F.lit("5" * 32)).alias("merged"))


PRIMER, LINKER, TSO = "TACACGACGCTCTTCCGATCT", "TCTTCAGCGTTCCCGAGA", "CCCATGTACTCTGCGTTGATACCACTGCTT"


@query(f"with l as ({LONG}), b as (select p_partkey, s, substr(s, 1, 14) as bc, substr(s, 15, 9) as umi from l) select p_partkey, reverse(translate('{PRIMER}' || substr(bc, 1, 8) || '{LINKER}' || substr(bc, 9) || umi || repeat('T', 30) || reverse(translate(s, 'ACGT', 'TGCA')) || '{TSO}', 'ACGT', 'TGCA')) as read from b")
def read_templates(spark, sf):
    """X23."""
    r = long_bases(spark, sf)
    return r.select("p_partkey", sq.template(F.col("seq"), F.substring("seq", 1, 14), F.substring("seq", 15, 9), "double").alias("read"))


@query(f"with l as ({LONG}) select p_partkey, substr(s, 6, 4) as barcode, greatest(instr(s, substr(s, 6, 4)), 0)::int as at, substr(s, greatest(instr(s, substr(s, 6, 4)) - 3, 1)::int, least(instr(s, substr(s, 6, 4)) - 1, 3)::int) as lft, substr(s, (instr(s, substr(s, 6, 4)) + 4)::int, 3) as rgt from l")
def tags_in_reads(spark, sf):
    """Where a raw barcode lies, and what is beside it."""
    r = long_bases(spark, sf).withColumns({"raw_bc": F.substring("seq", 6, 4), "raw_umi": F.substring("seq", 12, 4)})
    return domain.tag_flanks(r, "raw_bc", "raw_umi", 3).select("p_partkey", F.col("raw_bc").alias("barcode"), "at", F.col("left").alias("lft"), F.col("right").alias("rgt"))


@query(f"""with l as ({LONG}), r as (select p_partkey, s, coalesce(list_filter(range(1, 33), lambda i: substr(s, i, 1) = 'T' and (i = 1 or substr(s, i - 1, 1) <> 'T')), []) as starts from l), x as (select p_partkey, s, unnest(starts) as i from r)
select p_partkey, i::int as start, (i - 1 + length(regexp_extract(substr(s, i::int), '^(T+)', 1)))::int as "end" from x where length(regexp_extract(substr(s, i::int), '^(T+)', 1)) >= 4""")
def base_stretches(spark, sf):
    """P49."""
    return long_bases(spark, sf).select("p_partkey", F.explode(sq.stretches("seq", "T", 4)).alias("r")).select("p_partkey", F.col("r.start").cast("int").alias("start"), F.col("r.end").cast("int").alias("end"))


@query(f"""with r as (select p_partkey, s, instr(s, 'TT') as p0 from (select p_partkey, {BASES} as s from part)), c as (select p_partkey, case when p0 > 3 then substr(s, (p0 - 3)::int, 3) end as l, case when p0 > 0 then substr(s, (p0 + 2)::int, 2) end as r from r)
select p_partkey, case when l is null then 'no linker' when l in ('ACG', 'CGT', 'GTA') and r in ('AC', 'GA') then 'both' when l in ('ACG', 'CGT', 'GTA') then 'left' when r in ('AC', 'GA') then 'right' else 'none' end as status from c""")
def linker_parts(spark, sf):
    """Both parts around an exact linker."""
    words = lambda *x: spark.createDataFrame([(w,) for w in x], "part string")
    return domain.linker_halves(bases(spark, sf), words("ACG", "CGT", "GTA"), words("AC", "GA"), "TT", (3, 2)).select("p_partkey", "status")


@query("with l as (select c_custkey as read_id, translate(md5(c_custkey::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT') || 'TTTTTTTTT' as s from customer), a as (select read_id, s, instr(s, 'TTTTTTTTT') - 1 as p0 from l), w as (select distinct read_id, substr(s, (i + 1)::int, 16) as barcode from a, range(0, 40) t(i) where p0 >= 16 and i >= greatest(p0 - 36, 0) and i <= greatest(p0 - 22, 0)) select read_id, barcode from w where barcode in (select substr(translate(md5(k::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT'), 4, 16) from range(0, 900) t(k))")
def barcodes_before_t(spark, sf):
    """Known 16-mers in the windows before nine T."""
    mer = lambda c: F.translate(F.md5(c.cast("string")), "0123456789abcdef", "ACGT" * 4)
    reads = table(spark, sf, "customer").select(F.col("c_custkey").alias("read_id"), F.concat(mer(F.col("c_custkey")), F.lit("T" * 9)).alias("seq"))
    return domain.barcode_before_t9(reads, spark.range(900).select(F.substring(mer(F.col("id")), 4, 16).alias("barcode")))


@query("select c_custkey as read_id from customer where c_custkey % 3 <> 2")
def guides_verified(spark, sf):
    """Reads that hold their guide with few substitutions."""
    guide = F.translate(F.md5(F.col("c_custkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    other = F.concat(F.substring(guide, 1, 12), F.translate(F.substring(guide, 13, 1), "ACGT", "CGTA"), F.substring(guide, 14, 19))
    seq = F.when(F.col("c_custkey") % 3 == 0, guide).when(F.col("c_custkey") % 3 == 1, other).otherwise(F.lit("A" * 8))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("read_id"), F.concat(F.lit("NNN"), seq, F.lit("NNN")).alias("seq"), guide.alias("guide_seq"))
    return domain.verify_guides(rows, 31, 1, 0).select("read_id")


@query("select k::bigint as k, k % 2 = 0 as good from range(0, 6) t(k)")
def adapters_checked(spark, sf):
    """Adapters by their best score against the known ones."""
    known = [PRIMER, TSO]
    found = [(k, domain.good_adapter(PRIMER[2:18] if k % 2 == 0 else "ACGTACGTTTTTTTTTTTTTTTTT", known)) for k in range(6)]
    return spark.createDataFrame(found, "k long, good boolean")


# Generators


@query(f"select id, array_to_string(list_transform(range(1, 13), lambda i: case when i > 9 then substr('ACG', floor({number("'3|' || id || '|' || i")} * 3)::int + 1, 1) else substr('ACGT', floor({number("'3|' || id || '|' || i")} * 4)::int + 1, 1) end), '') as seq from range(0, 500) t(id)")
def random_umis(spark, sf):
    """The last places without T."""
    return simulate.random_sequences(spark, 500, 12, 3, 3)


@query(f"with a as (select id, array_to_string(list_transform(range(1, 9), lambda i: substr('ACGT', floor({number("'3|' || id || '|' || i")} * 4)::int + 1, 1)), '') as x, array_to_string(list_transform(range(1, 9), lambda i: substr('ACGT', floor({number("'4|' || id || '|' || i")} * 4)::int + 1, 1)), '') as y from range(0, 400) t(id)) select levenshtein(x, y)::int as distance, count(*) as n from a group by 1")
def random_distances(spark, sf):
    """R8."""
    return simulate.edit_distance_sample(spark, 400, 8, 3)


@query("select n_nationkey, 1::int as count, 40000.0::double as tpm from nation")
def ideal_expression(spark, sf):
    """R9, R11."""
    return simulate.ideal_counts(table(spark, sf, "nation").select("n_nationkey"))


@query("select p_partkey, floor(1000000 * p_retailprice / (select sum(p_retailprice) from part))::bigint as reads from part")
def reads_by_abundance(spark, sf):
    """R16."""
    return simulate.read_counts(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1_000_000).select("p_partkey", "reads")


PERTURB = f"""with {EXONS}, x as (select t, strand, 't' || t as id, list(struct_pack(s := s, e := e) order by s) as b from ex group by t, strand), c as (select *, floor(50 + {number("'12|' || id")} * 251)::bigint * case when {number("'13|' || id")} < 0.5 then -1 else 1 end as size from x where {number("'11|' || id")} < 0.5)"""


@query(PERTURB + " select id || '_alt' as transcript_id, b[1].s + case when strand = '-' then case when b[1].s + size < b[1].e then size else -size end else 0 end as first, b[-1].e + case when strand <> '-' then case when b[-1].e + size > b[-1].s then size else -size end else 0 end as last from c")
def perturbed_polya(spark, sf):
    """Transcripts that end elsewhere."""
    e = F.col("exons")
    return simulate.perturb_ends(transcripts(spark, sf), 11, 0.5).select("transcript_id", e[0]["start"].alias("first"), F.element_at(e, -1)["end"].alias("last"))


@query(PERTURB + " select id || '_alt' as transcript_id, b[1].s + case when strand <> '-' then case when b[1].s + size < b[1].e then size else -size end else 0 end as first, b[-1].e + case when strand = '-' then case when b[-1].e + size > b[-1].s then size else -size end else 0 end as last from c")
def perturbed_starts(spark, sf):
    """Transcripts that start elsewhere."""
    e = F.col("exons")
    return simulate.perturb_ends(transcripts(spark, sf), 11, 0.5, at_polya=False).select("transcript_id", e[0]["start"].alias("first"), F.element_at(e, -1)["end"].alias("last"))


@query(f"with {EXONS}, x as (select t, g, strand, min(s) as lo, max(e) as hi from ex group by t, g, strand), m as (select 't' || t as id, g, strand, case when strand = '-' then hi else lo end + floor(({number("'8|t' || t")} - 0.5) * 100)::bigint as m from x where {number("'9|t' || t")} >= 0.3) select id as transcript_id, 'chr' || g % 3 as chr, m - 10 as start, m + 10 as \"end\", strand from m")
def start_peaks(spark, sf):
    """R17."""
    return simulate.cage_peaks(transcripts(spark, sf), 8, 0.3)


@query(f"select event_id from events where {number("'2|' || event_id")} < 0.25")
def bernoulli_sample(spark, sf):
    """R1."""
    return ordered.bernoulli(table(spark, sf, "events"), 0.25, 2, "event_id").select("event_id")


@query(f"with a as (select 'c' || o_custkey % 5 as chr, o_orderkey as r, (o_custkey % 10) as s from orders), n as (select *, row_number() over (partition by chr order by s, r) as k from a), q as (select 'c' || k as id, translate(md5(k::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from range(0, 5) t(k)) select chr || '_' || k as id, substr(seq, (s + 1)::int, 12) as seq from n join q on q.id = chr")
def read_fragments(spark, sf):
    """The aligned part of each transcript."""
    a = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 5).alias("chr"), F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 10).alias("start"), (F.col("o_custkey") % 10 + 12).alias("end"))
    s = spark.range(5).select(F.concat(F.lit("c"), "id").alias("id"), F.translate(F.md5(F.col("id").cast("string")), "0123456789abcdef", "ACGT" * 4).alias("seq"))
    return simulate.fragments(a, s)


@query("with k as (select unnest(['gene', 'transcript', 'exon']) as feature) select 'n' || n_nationkey as chr, feature, (length(n_name) + 8)::bigint as \"end\", 'HEAD' || n_name || 'TAIL' as contig_seq from nation, k")
def guide_contigs(spark, sf):
    """G20."""
    g = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("seq"))
    return simulate.guide_reference(g, "HEAD", "TAIL").select("chr", "feature", "end", "contig_seq")


SIMULATED = f"""with p as (select p_partkey::varchar as t, {BASES} as s from part), r as (select t, s, i, floor({number("'3|' || t || '|' || i")} * 50)::bigint as b from p, range(1, 3) x(i)),
x as (select *, substr({MD5_BASES.format("'4|' || b")}, 1, 16) as bc, substr({MD5_BASES.format("'5|' || t || '|' || i")}, 1, 12) as umi from r)"""


@query(SIMULATED + f" select 'READ_' || i || '_' || t || '_' || bc || '_' || umi || '_+' as read_id, reverse(translate('C{PRIMER}' || bc || umi || repeat('T', 30) || reverse(translate(s, 'ACGT', 'TGCA')) || '{TSO}', 'ACGT', 'TGCA')) as seq from x")
def simulated_reads(spark, sf):
    """Reads of templates with their truth in the name."""
    parts = bases(spark, sf).select(F.col("p_partkey").cast("string").alias("transcript_id"), "seq", F.lit(10_000.0).alias("tpm"))
    return pipelines.simulate_reads(parts, 200, "10x", 50, 12, 3).select("read_id", "seq")


@query(f"select 't' || t as read_id, length(s)::int as n from (select p_partkey as t, {BASES} as s from part)")
def truncated_reads(spark, sf):
    """Pieces of a normal length; of 500 on average none is cut."""
    r = bases(spark, sf).select(F.concat(F.lit("t"), "p_partkey").alias("read_id"), "seq", (F.col("p_partkey") % 2 == 0).alias("same_strand"))
    return simulate.truncate_reads(r, 2, 500.0, 20.0).select("read_id", F.length("seq").alias("n"))


# Variants, isoforms, contigs


@query("with c as (select l_partkey as pos, l_suppkey % 3 as s, count(*) as cov, count(*) filter (l_returnflag = 'R') as r from lineitem group by 1, 2) select pos, s as sample, case when r > 0 then r / cov::double end as f0, round(coalesce(case when cov >= 1 then r / cov::double end, 0), 6) as freq from c")
def snp_frequencies(spark, sf):
    """The matrix, long."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos"), (F.col("l_suppkey") % 3).alias("sample")).agg(F.count("*").alias("cov"), F.count_if(F.col("l_returnflag") == "R").alias("reads"))
    snps = c.groupBy("pos").agg(F.collect_list(F.struct("sample", "cov", "reads")).alias("samples")).withColumns({"chr": F.lit("1"), "ref": F.lit("A"), "alt": F.lit("G")})
    m = pipelines.snp_matrix(snps, mean_fill=True)
    return m.select("pos", "sample", F.when(F.col("reads") > 0, F.col("reads") / F.col("cov")).alias("f0"), F.round("freq", 6).alias("freq"))


@query("with c as (select event_type as chr, event_id as i, user_id as pos from events), s as (select chr, pos, count(*) filter (i % 4 = 0) as a, count(*) filter (i % 4 = 1) as c, count(*) filter (i % 4 = 2) as g, count(*) filter (i % 4 = 3) as t from c group by 1, 2), u as (select chr, pos, a + c + g + t as cov, unnest([{'alt': 'A', 'r': a}, {'alt': 'C', 'r': c}, {'alt': 'G', 'r': g}, {'alt': 'T', 'r': t}]) as b from s) select chr, pos, b.alt as alt, case when b.r / cov::double >= 0.2 then 'germline' else 'somatic' end as type from u where b.alt <> 'A' and cov >= 8 and b.r / cov::double >= 0.2")
def snps_called(spark, sf):
    """G1, G1b, G2, entry point 3: over pileups of one sample."""
    i = F.col("event_id")
    p = table(spark, sf, "events").groupBy(F.col("event_type").alias("chr"), F.col("user_id").alias("pos")).agg(*[F.count_if(i % 4 == j).alias(b) for j, b in enumerate("ACGT")]).withColumn("sample", F.lit("s"))
    return pipelines.call_snps(p, p.select("chr", "pos", F.lit("A").alias("ref")), 0.2, 2.0, 8, keep_germline=True).select("chr", "pos", "alt", "type")


CONTIGS = "with a as (select l_orderkey as contig, l_linenumber = 1 as prim, 'c' || l_suppkey % 4 as chr, l_partkey * 3 as at, l_linenumber * 60 as qs, l_linenumber * 60 + l_quantity::bigint + 40 as qe from lineitem), p as (select * from a where prim), s as (select * from a where not prim), b as (select p.contig, p.chr as c1, s.chr as c2, p.at as a1, s.at as a2, p.qs as q1, s.qs as q2, greatest(0, least(p.qe, s.qe) - greatest(p.qs, s.qs) + 1) / least(p.qe - p.qs + 1, s.qe - s.qs + 1)::double as o from p join s using (contig))"


def contig_alignments(spark, sf):
    n = F.col("l_linenumber").cast("long")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contig"), (n == 1).alias("is_primary"), F.concat(F.lit("c"), F.col("l_suppkey") % 4).alias("chr"), (F.col("l_partkey") * 3).alias("start"), (n * 60).alias("q_start"), (n * 60 + F.col("l_quantity").cast("long") + 40).alias("q_end"))


@query(CONTIGS + " select distinct contig from b where c1 <> c2 and o <= 0.2")
def contigs_misassembled(spark, sf):
    """G9."""
    return pipelines.misassembled(contig_alignments(spark, sf))


@query(CONTIGS + " select distinct contig from b where o <= 0.2 and (c1 <> c2 or abs(abs(a1 - a2) - abs(q1 - q2)) >= 1000)")
def contigs_far_apart(spark, sf):
    """G10."""
    return domain.distant_misassemblies(contig_alignments(spark, sf))


@query("with a as (select l_suppkey as chr, l_orderkey as contig, sum(l_quantity)::bigint as r, sum(l_quantity * 0.9) as c from lineitem group by 1, 2), s as (select chr, r / 60.0 as rs, c / 50.0 as cs from a) select count(distinct case when rs >= 0.95 then chr end) as \"references\", count(distinct case when rs >= 0.95 and cs >= 0.95 then chr end) as by_whole_contigs from s")
def references_covered(spark, sf):
    """G11."""
    a = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("contig"), F.col("l_quantity").alias("ref_aligned"), (F.col("l_quantity") * 0.9).alias("contig_aligned"), F.lit(60.0).alias("ref_length"), F.lit(50.0).alias("contig_length"))
    return domain.covered_references(a)


@query("with r as (select o_orderkey as i, case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then 'gx' else 'g' || o_custkey end as g, case when o_orderkey % 11 = 0 then 'contradictory' else 'unique' end as k, case o_orderkey % 3 when 0 then ['t'] when 1 then ['t', 'u'] else ['u'] end as iso, 'g' || o_custkey as tg from orders) select case when g is null then 'unassigned' when k = 'contradictory' then 'contradictory' when len(iso) = 1 and list_contains(iso, 't') then 'correct' when list_contains(iso, 't') then 'ambiguous_correct' when g = tg then 'same_gene' else 'mismapped' end as kind, count(*) as n from r group by 1")
def assignments_judged(spark, sf):
    """P17, P19, P26, G13."""
    o, g = F.col("o_orderkey"), F.concat(F.lit("g"), "o_custkey")
    rows = table(spark, sf, "orders").select(F.when(o % 7 == 0, None).when(o % 7 == 1, "gx").otherwise(g).alias("gene_id"), F.when(o % 11 == 0, "contradictory").otherwise("unique").alias("assignment_type"), F.when(o % 3 == 0, F.array(F.lit("t"))).when(o % 3 == 1, F.array(F.lit("t"), F.lit("u"))).otherwise(F.array(F.lit("u"))).alias("isoforms"), F.lit("t").alias("true_isoform"), g.alias("true_gene"))
    return domain.assignment_report(rows)


@query("""with c as (select l_partkey as g, l_returnflag as s, count(*) as n from lineitem group by 1, 2), t as (select g, s, n * 1e6 / sum(n) over (partition by s) as tpm from c) select 'g' || g as gene_id, coalesce(round(sum(tpm) filter (s = 'A'), 4), 0) as "A", coalesce(round(sum(tpm) filter (s = 'R'), 4), 0) as "R", p_size as bin, p_size > 10 as spliced from t left join part on p_partkey = g group by g, p_size""")
def expression_table(spark, sf):
    """G18."""
    reads = table(spark, sf, "lineitem").select(F.concat(F.lit("g"), "l_partkey").alias("gene_id"), F.col("l_returnflag").alias("sample"))
    genes = table(spark, sf, "part").select(F.concat(F.lit("g"), "p_partkey").alias("gene_id"), F.col("p_size").alias("bin"), (F.col("p_size") > 10).alias("spliced"))
    out = domain.read_summary(reads, genes, ["A", "R"])
    return out.select("gene_id", F.round("A", 4).alias("A"), F.round("R", 4).alias("R"), "bin", "spliced")


@query(f"with {INTRONS} select 'g' || g as gene_id, count(*)::int as n_introns, sum(b - a + 1)::bigint as intronic from intr where a <= b group by g")
def introns_of_genes(spark, sf):
    """Distinct introns of each gene; its parts are split_segments."""
    f = pipelines.gene_features(transcripts(spark, sf))
    return f.filter("size(introns) > 0").select("gene_id", F.size("introns").alias("n_introns"), iv.total_length(F.col("introns")).alias("intronic"))


@query("with p as (select k % 50 as g, k, [case when k % 2 = 0 then 1 else -1 end, case when k % 3 = 0 then 1 else -1 end, case when k % 5 = 0 then 1 else 0 end] as p from (select c_custkey as k from customer)), o as (select *, list_position(p, 1) as lo, 4 - list_position(list_reverse(p), 1) as hi from p where list_contains(p, 1)) select distinct 'g' || a.g as gene_id, 't' || a.k as transcript_id from o a join p b on a.g = b.g and a.k <> b.k and a.p[a.lo:a.hi] = b.p[a.lo:a.hi]")
def isoforms_ambiguous(spark, sf):
    """Profiles that are part of another's."""
    k = F.col("c_custkey")
    p = F.array(F.when(k % 2 == 0, 1).otherwise(-1), F.when(k % 3 == 0, 1).otherwise(-1), F.when(k % 5 == 0, 1).otherwise(0))
    return pipelines.ambiguous_isoforms(table(spark, sf, "customer").select(F.concat(F.lit("g"), k % 50).alias("gene_id"), F.concat(F.lit("t"), k).alias("transcript_id"), p.alias("profile")))


READS = f"with {INTRONS}, own as (select distinct g, t, e + 1 as a, nx - 1 as b from nx where nx is not null), cov as (select g, t, min(s) as lo, max(e) as hi, count(*) as n from ex group by g, t having count(*) > 1)"


@query(READS + """, f as (select r.g, r.t as r, i.a, i.b, case when exists (select 1 from own o where o.t = r.t and o.a = i.a and o.b = i.b) then 1 when i.a >= r.lo and i.b <= r.hi then -1 else 0 end as v from cov r join (select distinct g, a, b from intr) i on i.g = r.g),
m as (select f.r, c.t as cand, sum(case when v <> 0 and v <> case when exists (select 1 from own o where o.t = c.t and o.a = f.a and o.b = f.b) then 1 else -1 end then 1 else 0 end) as d from f join (select distinct g, t from ex) c on c.g = f.g group by 1, 2), n as (select r, count(*) filter (d = 0) as fit, bool_or(d = 0 and cand = r) as own_fit from m group by r) select 'r' || r as read_id, own_fit from n""")
def isoforms_assigned(spark, sf):
    """P13, P14, section 3.4: reads that are their transcripts always fit them."""
    t = transcripts(spark, sf)
    reads = t.filter("size(exons) > 1").select(F.concat(F.lit("r"), "t").alias("read_id"), "gene_id", F.col("exons").alias("blocks"))
    own = F.array_contains("isoforms", F.concat(F.lit("t"), F.substring("read_id", 2, 20)))
    return pipelines.assign_isoforms(reads, t).select("read_id", own.alias("own_fit"))


@query(f"with {CODING}, ends as (select t, min(s) as lo, max(e) as hi from cds group by t) select 'g' || (t // 8) as gene_id, 't' || t as transcript_id, case when t // 8 % 2 = 0 then lo else hi - 2 end as start_codon, case when t // 8 % 2 = 0 then hi - 2 else lo end as stop_codon from ends")
def codons_of_transcripts(spark, sf):
    """From the coding ends."""
    return pipelines.codon_pairs(with_coding(spark, sf)).select("gene_id", "transcript_id", "start_codon", "stop_codon")


@query("with c as (select l_suppkey as g, l_linenumber as a, l_partkey % 3 as b, count(*) as n from lineitem group by 1, 2, 3) select g as gene_id, a as start_codon, b as stop_codon, n from c where g in (select g from c group by g having count(distinct a) >= 2 and count(distinct b) >= 2)")
def codon_cross_tables(spark, sf):
    """P16, P30."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("gene_id"), F.col("l_linenumber").alias("start_codon"), (F.col("l_partkey") % 3).alias("stop_codon"))
    return pipelines.codon_tables(rows)


@query(f"with {EXONS}, x as (select t, strand, sum(e - s + 1) as total, coalesce(sum(greatest(0, least(e, 149) - s + 1)) filter (s <= 149), 0) as before, coalesce(sum(e - greatest(s, 451) + 1) filter (e >= 451), 0) as after from ex group by t, strand) select t, round(case when strand = '-' then after else before end / total::double, 6) as \"left\", round(case when strand = '-' then before else after end / total::double, 6) as \"right\" from x")
def clipped_shares(spark, sf):
    """What a read from 150 to 450 leaves of its isoform."""
    r = transcripts(spark, sf).withColumn("blocks", F.array(F.struct(F.lit(150).cast("long").alias("start"), F.lit(450).cast("long").alias("end"))))
    out = domain.clipped_fractions(r)
    return out.select("t", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query("select 'n' || o_custkey as contig, 'b' || o_orderkey as barcode from orders")
def contig_barcodes(spark, sf):
    """Contig names that carry their barcodes."""
    names = table(spark, sf, "orders").groupBy("o_custkey").agg(F.concat(F.lit("n"), "o_custkey", F.lit("_barcodeIDs_"), F.array_join(F.collect_list(F.concat(F.lit("b"), "o_orderkey")), ",")).alias("id"))
    return domain.split_map(names, "id")


@query("with p as (select c_custkey as k, translate(md5(c_custkey::varchar), '0123456789abcdef', 'ACGTACGTACGTACGT') as s from customer) select k, round(8 / 8.0, 6)::double as similarity from p")
def exon_pairs_alike(spark, sf):
    """An exon that lies in the other is wholly alike."""
    s = F.translate(F.md5(F.col("c_custkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.substring(s, 9, 8).alias("seq1"), s.alias("seq2"))
    return domain.exon_similarity(rows).select("k", F.round("similarity", 6).alias("similarity"))


@query(f"with {EXONS}, c as (select distinct g, k, pos from (select g, 'start' as k, s + 5 as pos from ex where n = 1 and e - s > 10 union all select g, 'stop', s + 5 from ex where n = 5 and e - s > 10)), h as (select distinct ex.t, ex.g, c.k, c.pos from ex join c on c.g = ex.g and ex.s <= c.pos and ex.e >= c.pos + 2), p as (select t, count(*) filter (k = 'start') as a, count(*) filter (k = 'stop') as b from h group by t) select 't' || x.t as contig, case when coalesce(a, 0) = 0 and coalesce(b, 0) = 0 then 'none' when coalesce(b, 0) = 0 then 'only_start' when coalesce(a, 0) = 0 then 'only_stop' when a = 1 and b = 1 then 'pair' else 'multiple' end as kind from (select distinct t from ex) x left join p on p.t = x.t")
def contig_codons(spark, sf):
    """P31, P32, P34."""
    x = exons(spark, sf)
    codons = x.filter("n in (1, 5) and e - s > 10").select(F.concat(F.lit("g"), "g").alias("gene_id"), F.when(F.col("n") == 1, "start").otherwise("stop").alias("kind"), (F.col("s") + 5).alias("pos")).distinct()
    contigs = transcripts(spark, sf).select(F.col("transcript_id").alias("contig"), "gene_id", F.col("exons").alias("blocks"))
    return domain.covered_codons(contigs, codons).select("contig", "kind")


@query(f"with {EXONS}, l as (select g, t, 't' || t || chr(9) || string_agg(s || '-' || e, ',' order by s) as line from ex group by g, t) select 'g' || g as gene_id, string_agg(line, chr(10) order by line) as value from l group by g")
def genes_as_text(spark, sf):
    """P35, P36."""
    return domain.hierarchy_text(transcripts(spark, sf)).select("gene_id", "value")


@query("with c as (select k % 40 as g, k, [case when k % 2 = 0 then 1 else -1 end, case when k % 3 = 0 then 1 else -1 end] as p, k % 4 <> 0 as coding from (select c_custkey as k from customer)), r as (select o_orderkey as i, o_custkey % 40 as g, [case o_orderkey % 3 when 0 then 1 when 1 then -1 else 0 end, case o_orderkey % 2 when 0 then 1 else 0 end] as p from orders), m as (select i, count(*) filter (coding and (r.p[1] = 0 or r.p[1] = c.p[1]) and (r.p[2] = 0 or r.p[2] = c.p[2])) as n, count(*) filter (coding) as any_c from r join c on r.g = c.g group by i) select i as read_id, case n when 0 then 'contradictory' when 1 then 'unique' else 'ambiguous' end as assignment_type from m where any_c > 0")
def assigned_by_junctions(spark, sf):
    """P38."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    iso = table(spark, sf, "customer").select((k % 40).alias("gene_id"), F.concat(F.lit("t"), k).alias("transcript_id"), F.array(F.when(k % 2 == 0, 1).otherwise(-1), F.when(k % 3 == 0, 1).otherwise(-1)).alias("profile"), (k % 4 != 0).alias("is_coding"))
    reads = table(spark, sf, "orders").select(o.alias("read_id"), (F.col("o_custkey") % 40).alias("gene_id"), F.array(F.when(o % 3 == 0, 1).when(o % 3 == 1, -1).otherwise(0), F.when(o % 2 == 0, 1).otherwise(0)).alias("profile"))
    return domain.assign_by_junctions(reads, iso).select("read_id", "assignment_type")


@query("with r as (select c_custkey % 40 as g, c_custkey as t, c_custkey % 3 as a, c_custkey % 7 as b, c_custkey % 4 <> 0 as coding from customer), w as (select g from r where coding group by g having count(distinct a) >= 2 and count(distinct b) >= 3) select g as gene_id, t as barcode, a as start_codon, b as stop_codon, 1000::int as weight from r where coding and g in (select g from w) and (select count(distinct a) from r x where x.g = r.g and coding) >= 3")
def ideal_isoform_tables(spark, sf):
    """Genes with enough starts and enough stops."""
    k = F.col("c_custkey")
    iso = table(spark, sf, "customer").select((k % 40).alias("gene_id"), k.alias("transcript_id"), (k % 4 != 0).alias("is_coding"))
    codons = table(spark, sf, "customer").select((k % 40).alias("gene_id"), k.alias("transcript_id"), (k % 3).alias("start_codon"), (k % 7).alias("stop_codon"))
    return domain.ideal_isoforms(iso, codons, 3)


@query("with e as (select o_orderkey as r, 'g' || o_custkey % 30 as g, 'alt:' || (o_custkey % 5 * 100) || '-' || (o_custkey % 5 * 100 + 50) as ev from orders) select g as gene_id, substr(ev, 5) as intron, count(distinct r) as support from e group by 1, 2 having count(distinct r) >= 3")
def introns_supported(spark, sf):
    """P41."""
    c = F.col("o_custkey")
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("g"), c % 30).alias("gene_id"), F.concat(F.lit("alt:"), c % 5 * 100, F.lit("-"), c % 5 * 100 + 50).alias("events"))
    return domain.supported_introns(a, 3)


@query("with p as (select distinct l_returnflag as kind, l_suppkey as chr, l_linenumber * 7 + l_partkey % 20 as o, l_linenumber * 7 + l_suppkey % 15 as a from lineitem) select kind, (o - a)::bigint as shift, count(*) as n from p where abs(o - a) <= 10 group by 1, 2")
def splice_shifts(spark, sf):
    """P43."""
    n = F.col("l_linenumber").cast("long") * 7
    return domain.site_shifts(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("chr"), (n + F.col("l_partkey") % 20).alias("observed"), (n + F.col("l_suppkey") % 15).alias("annotated")))


@query("with l as (select o_orderkey as i, md5(o_orderkey::varchar) as h from orders order by h, i limit 50) select l_partkey as short_id, l_suppkey as s from lineitem where l_orderkey in (select i from l)")
def pairs_selected(spark, sf):
    """Short reads of fifty long ones."""
    long = table(spark, sf, "orders").select(F.col("o_orderkey").alias("read_id"))
    both = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("long_id"), F.col("l_partkey").alias("short_id"), F.col("l_suppkey").alias("s"))
    return domain.select_pairs(long, table(spark, sf, "part").select(F.col("p_partkey").alias("read_id")), both, 50).select("short_id", "s")


@query("with p as (select case when l_suppkey % 2 = 0 then '-' else '+' end as strand, l_partkey as s1, l_partkey + l_quantity::bigint * 10 as e2, l_partkey - l_quantity::bigint * 5 as s2 from lineitem), n as (select case when strand = '-' then s1 - s2 else e2 - s1 end - 20 as n from p) select count(*) as pairs, round(avg(n), 4) as mean, round(stddev_pop(n), 4) as sd from n where n >= 0 and n < 400")
def fragment_lengths(spark, sf):
    """P53."""
    s, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    rows = table(spark, sf, "lineitem").select(F.when(F.col("l_suppkey") % 2 == 0, "-").otherwise("+").alias("strand"), s.alias("start1"), (s + q * 10).alias("end2"), (s - q * 5).alias("start2"), F.lit(20).alias("offset"))
    out = domain.template_lengths(rows, 400)
    return out.select("pairs", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("with c as (select count(*) as k from lineitem group by l_suppkey), t as (select sum(k)::bigint as n from c) select round(sum(1 - case when n - k < 100 then 0 else exp(lgamma(n - k + 1) - lgamma(n - k - 99) - lgamma(n + 1) + lgamma(n - 99)) end), 4) as expected from c, t")
def colours_expected(spark, sf):
    """P55."""
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("k"))
    return domain.expected_distinct(c, "k", 100).select(F.round("expected", 4).alias("expected"))


# Matrices


@query("with c as (select p_partkey as k, s::int as s, case when (p_partkey + s) % 3 = 0 then null else p_size end as v from part, range(0, 4) t(s)) select k, s, v from c where k not in (select k from c group by k having count(*) filter (v is null) > 1)")
def sparse_rows_dropped(spark, sf):
    """D14."""
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s"), "p_size")
    rows = rows.select("k", "s", F.when((F.col("k") + F.col("s")) % 3 != 0, F.col("p_size")).alias("v"))
    return domain.drop_sparse_rows(rows, "k", "v", 1)


@query("select event_id, n_name as gene_name, array_to_string(list_transform(range(0, 10), lambda i: substr('ACGT', ((event_id * 7919) % 1048576 >> (18 - 2 * i))::int % 4 + 1, 1)), '') as umi from events join nation on n_nationkey = event_id % 25 where user_id in (select c_custkey from customer where c_custkey % 2 = 1)")
def molecules_named(spark, sf):
    """D18, D17."""
    i = F.col("event_id")
    m = table(spark, sf, "events").select("event_id", F.col("user_id").alias("cell"), (i % 25).cast("int").alias("gene_index"), (i * 7919 % 1048576).alias("umi_code"))
    genes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("gene_index"), F.col("n_name").alias("gene_name"))
    return domain.molecule_table(m, table(spark, sf, "customer").filter("c_custkey % 2 = 1").select(F.col("c_custkey").alias("cell")), genes).select("event_id", "gene_name", "umi")


@query("with c as (select l_partkey as g, l_returnflag as s, count(*) as n, max(l_extendedprice) as len from lineitem group by 1, 2), r as (select *, n / (greatest(1, len - 200) / 1000.0) as rate from c) select g, s, round(log2(rate) - log2(sum(rate) over (partition by s) / 1e6), 6) as log_expression from r")
def log_expression(spark, sf):
    """D23."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("g"), F.col("l_returnflag").alias("s")).agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("len"))
    return domain.log_rpkm(c, "s", "n", "len").select("g", "s", F.round("log_expression", 6).alias("log_expression"))


COUNTS = "with c as (select l_suppkey as g, l_returnflag as s, count(*) as n from lineitem group by 1, 2)"


def counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("s")).agg(F.count("*").alias("n"))


FACTORS = COUNTS + ", m as (select g, avg(ln(n)) as m from c group by g having count(distinct s) = (select count(distinct s) from c)), f as (select s, exp(quantile_cont(ln(n) - m, 0.5)) as size_factor from c join m using (g) group by s)"


@query(FACTORS + " select s, round(size_factor, 6) as size_factor from f")
def sample_size_factors(spark, sf):
    """Medians of ratios."""
    return domain.size_factors(counts(spark, sf), "g", "s", "n").select("s", F.round("size_factor", 6).alias("size_factor"))


@query(FACTORS + " select g, s, round(n / size_factor, 6) as normalised, round(log2(n / size_factor + 1), 6) as log2 from c join f using (s)")
def counts_normalised(spark, sf):
    """D7, D20."""
    out = domain.normalised_counts(counts(spark, sf), "g", "s", "n")
    return out.select("g", "s", F.round("normalised", 6).alias("normalised"), F.round("log2", 6).alias("log2"))


@query("with c as (select l_suppkey as g, l_returnflag as b, l_linenumber as k, count(*)::double as n from lineitem group by 1, 2, 3), p as (select g, b, avg(n) as m from c group by 1, 2), o as (select g, avg(m) as a from p group by 1) select g, b, k, round(n - m + a, 6) as n from c join p using (g, b) join o using (g)")
def batches_centred(spark, sf):
    """D8."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("b"), F.col("l_linenumber").alias("k")).agg(F.count("*").cast("double").alias("n"))
    return domain.centre_batches(c, "g", "b", "n").select("g", "b", "k", F.round("n", 6).alias("n"))


@query(COUNTS + ", v as (select g, s, log2(n) as v from c where g in (select s_suppkey from supplier where s_acctbal > 0)) select a.s as sample_a, b.s as sample_b, round(stddev_samp(a.v - b.v), 6) as dispersion, count(*) as genes from v a join v b on a.g = b.g and a.s < b.s group by 1, 2")
def sample_dispersion(spark, sf):
    """Of a set of genes."""
    genes = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("g"))
    return domain.pair_dispersion(counts(spark, sf), genes, "g", "s", "n").withColumn("dispersion", F.round("dispersion", 6))


USAGE = "with c as (select l_partkey as exon, count(*) filter (l_linestatus = 'O' and l_returnflag = 'A') as a, count(*) filter (l_linestatus = 'F' and l_returnflag = 'A') as b, count(*) filter (l_linestatus = 'O' and l_returnflag = 'R') as c, count(*) filter (l_linestatus = 'F' and l_returnflag = 'R') as d from lineitem group by 1)"


@query(USAGE + ", k as (select *, (a + b + c + d)::double as n from c where a + b >= 4 and c + d >= 4), t as (select exon, a / (a + b)::double - c / (c + d)::double as dpsi, n * power(greatest(0, abs(a::double * d - b::double * c) - least(n / 2, abs(a::double * d - b::double * c))), 2) / ((a + b)::double * (c + d) * (a + c) * (b + d)) as chi2 from k where greatest(a + c, b + d) / n <= 0.9 and least(a + b, c + d) * least(a + c, b + d) / n > 5) select exon, round(dpsi, 6) as dpsi, round(chi2, 6) as chi2 from t")
def exon_usage(spark, sf):
    """Two groups' exon inclusion compared."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("exon"), F.col("l_returnflag").alias("grp")).agg(F.count_if(F.col("l_linestatus") == "O").alias("include"), F.count_if(F.col("l_linestatus") == "F").alias("exclude"))
    out = stats.differential_exons(c, "grp", "A", "R", 4)
    return out.select("exon", F.round("dpsi", 6).alias("dpsi"), F.round("chi2", 6).alias("chi2"))


@query("with p as (select l_returnflag as grp, l_suppkey as k, (count(*) % 37 + 1) / 40.0 as p from lineitem group by 1, 2), r as (select *, rank() over (partition by grp order by p) + count(*) over (partition by grp, p) - 1 as rk, count(*) over (partition by grp) as n from p), h as (select grp, sum(1.0 / i) as h from (select distinct grp, n from r), range(1, 100000) t(i) where i <= n group by grp), f as (select r.*, p * n * h / rk as raw from r join h using (grp)) select grp, k, round(least(1.0, min(raw) over (partition by grp order by p desc range between unbounded preceding and current row)), 6)::double as fdr from f")
def by_adjust_groups(spark, sf):
    """BY rates within groups."""
    p = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_suppkey").alias("k")).agg(((F.count("*") % 37 + 1) / 40.0).alias("p"))
    return stats.adjust(p, "p", "fdr", "BY", ["grp"]).select("grp", "k", F.round("fdr", 6).alias("fdr"))


@query("with c as (select l_partkey as g, count(*) filter (l_returnflag = 'R') - count(*) filter (l_returnflag = 'A') as lfc, (count(*) % 10) / 100.0 as fdr from lineitem group by 1) select g, case when lfc > 0 then 'up' else 'down' end as direction from c where fdr <= 0.05 and abs(lfc) > 2")
def genes_significant(spark, sf):
    """D24-D26, F25."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("g")).agg((F.count_if(F.col("l_returnflag") == "R") - F.count_if(F.col("l_returnflag") == "A")).alias("lfc"), ((F.count("*") % 10) / 100.0).alias("fdr"))
    return aggregate.significant(c, "lfc", "fdr", 2, 0.05).select("g", "direction")


@query("select event_type as host, max(value) as max_value, max(user_id) as max_user_id from events group by 1")
def monitor_maxima(spark, sf):
    """ST5: running maxima, over what there is."""
    return streams.running_maxima(table(spark, sf, "events").withColumnRenamed("event_type", "host"), "host", "value", "user_id")


@query("select event_id from events where value > 400")
def monitor_alerts(spark, sf):
    """ST6."""
    return streams.alerts(table(spark, sf, "events"), "value", 400).select("event_id")


@query(SIMULATED + " select 'READ_' || i || '_' || t || '_' || bc || '_' || umi || '_+' as read_id, bc as barcode from x")
def barcodes_called(spark, sf):
    """M13, M14, J36, entry point 1: reads without errors are called as they were made."""
    parts = bases(spark, sf).select(F.col("p_partkey").cast("string").alias("transcript_id"), "seq", F.lit(10_000.0).alias("tpm"))
    reads = pipelines.simulate_reads(parts, 200, "10x", 50, 12, 3).repartition(16)
    return align.call_barcodes(reads, reads.select("barcode").distinct(), align.TENX).select("read_id", "barcode")


@query(SIMULATED.replace("1, 16) as bc", "1, 14) as bc").replace("1, 12) as umi", "1, 9) as umi") + " select 'READ_' || i || '_' || t || '_' || bc || '_' || umi || '_+' as read_id, bc as barcode from x")
def two_part_barcodes_called(spark, sf):
    """The double barcode around its linker."""
    parts = bases(spark, sf).select(F.col("p_partkey").cast("string").alias("transcript_id"), "seq", F.lit(10_000.0).alias("tpm"))
    reads = pipelines.simulate_reads(parts, 200, "double", 50, 9, 3).repartition(16)
    return align.call_barcodes(reads, reads.select("barcode").distinct(), align.DOUBLE).select("read_id", "barcode")
