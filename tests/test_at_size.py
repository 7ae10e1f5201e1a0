"""What only larger or odd tables show: the queries against their SQL on made tables, the operators against brute force."""

import random
import threading

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import rows_of

import __spark_entry__ as entry
from strandlake.functions import align
from strandlake.operators import domain, ordered, pipelines, relational


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Whether a query gives its SQL's rows on tables that are made by SQL; the rows."""

    def check(name, **tables):
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for t, sql in tables.items():
            con.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
            con.execute(f"create or replace view {t} as select * from '{tmp_path}/{t}.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        found = con.execute(entry.oracle_sql()[name])
        want = rows_of([c[0] for c in found.description], found.fetchall())
        assert got == want
        return got

    return check


def test_zscore_of_equal_values(same_as_sql):
    rows = "(values (1, 'A', 7.0), (1, 'R', 7.0), (2, 'A', 3.0), (3, 'A', 1.0), (3, 'N', 4.0), (3, 'R', 5.5))"
    got = same_as_sql("zscore_rows", lineitem=f"select s::bigint as l_suppkey, f as l_returnflag, q::double as l_quantity from {rows} t(s, f, q)")
    assert len(got) == 6


def in_time(spark, df, seconds=60):
    """The number of rows, or a failure when the jobs take longer."""
    found = []
    work = threading.Thread(target=lambda: found.append(df.count()), daemon=True)
    work.start()
    work.join(seconds)
    if work.is_alive():
        spark.sparkContext.cancelAllJobs()
        work.join()
        pytest.fail(f"more than {seconds} s")
    return found[0]


def test_ambiguous_isoforms_that_repeat(spark):
    rng = random.Random(5)
    rows = [(rng.choice("gh"), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([None, [rng.choice([1, -1, 0]) for _ in range(3)]])) for _ in range(40)]

    def part(x, y):
        ones = [i for i, v in enumerate(x) if v == 1]
        return bool(ones) and x[ones[0] : ones[-1] + 1] == y[ones[0] : ones[-1] + 1]

    for n in (3, 12, 40):
        d = spark.createDataFrame(rows[:n], "gene_id string, transcript_id string, profile array<int>")
        got = sorted(tuple(r) for r in pipelines.ambiguous_isoforms(d).collect())
        assert got == sorted({(g, t) for g, t, x in rows[:n] for h, u, y in rows[:n] if g == h and t and u and t != u and x and y and part(x, y)})
    many = spark.range(200_000).select(F.lit("g").alias("gene_id"), F.col("id").cast("string").alias("transcript_id"), F.array(F.lit(1), (F.col("id") % 3 - 1).cast("int")).alias("profile"))
    assert in_time(spark, pipelines.ambiguous_isoforms(many)) == 200_000


def test_reads_assigned_by_profiles_that_repeat(spark):
    iso = spark.createDataFrame([("g", "t2", [1, 1], True), ("g", "t1", [1, 1], True), ("g", "t3", [1, -1], True), ("g", "t4", [1, 1], False), ("h", "t5", None, True)], "gene_id string, transcript_id string, profile array<int>, is_coding boolean")
    reads = spark.createDataFrame([("a", "g", [1, 0]), ("b", "g", [0, 1]), ("c", "g", [1, -1]), ("d", "g", [-1, 0]), ("e", "g", None), ("f", "h", [1, 1]), ("i", "z", [1, 1]), ("c", "g", [-1, -1])], "read_id string, gene_id string, profile array<int>")
    got = {r.read_id: (r.isoforms, r.assignment_type) for r in domain.assign_by_junctions(reads, iso).collect()}
    assert got == {"a": (["t1", "t2", "t3"], "ambiguous"), "b": (["t1", "t2"], "ambiguous"), "c": (["t3"], "unique"), "d": ([], "contradictory"), "e": ([], "contradictory"), "f": ([], "contradictory")}
    many = spark.range(200_000).select(F.lit("g").alias("gene_id"), F.col("id").alias("transcript_id"), F.array((F.col("id") % 2 * 2 - 1).cast("int")).alias("profile"), F.lit(True).alias("is_coding"))
    out = domain.assign_by_junctions(many.withColumnRenamed("transcript_id", "read_id"), many).select("read_id", "assignment_type")
    assert in_time(spark, out.filter("assignment_type = 'ambiguous'")) == 200_000


def test_first_range_of_places_that_repeat(spark, same_as_sql):
    part = "select i::bigint as p_partkey, (i * 7 % {})::int as p_size from range({}) t(i)"
    events = "select i::bigint as event_id, case when i % 50 <> 7 then i % 1009 end::bigint as user_id from range({}) t(i)"
    assert len(same_as_sql("point_first_match", part=part.format(50, 400), events=events.format(3000))) > 500
    points = spark.range(2_000_000).select("id", (F.col("id") % 90).alias("at"), F.lit(1).alias("chr"))
    ranges = spark.range(100_000).select(F.col("id").alias("r"), (F.col("id") % 60).alias("lo"), (F.col("id") % 60 + 20).alias("hi"), F.lit(1).alias("chr"))
    assert in_time(spark, relational.first_range(points, ranges, "at", "lo", "hi", ["chr"], 64, "lo", "r")) > 1_700_000


def test_hamming_of_brands_that_repeat(same_as_sql, monkeypatch):
    part = "select (i * 37 % 101)::bigint as p_partkey, case when i % 9 = 4 then null else ['b#1', 'b#2', 'c#2', 'b#12'][i % 4 + 1] end as p_brand, case when i % 10 > 0 then 'T' || i % 2 end as p_type, (i % 3)::int as p_size from range(101) t(i)"
    whole = same_as_sql("hamming", part=part)
    monkeypatch.setattr(relational, "CHUNK", 2)
    assert same_as_sql("hamming", part=part) == whole and len(whole) > 500


def test_edit_distances_of_names_that_repeat(same_as_sql, monkeypatch):
    part = "select (i * 37 % 101)::bigint as p_partkey, case when i % 9 = 4 then null else ['ring', 'rings', 'bolt', ''][i % 4 + 1] end as p_name, case when i % 10 > 0 then 'T' || i % 2 end as p_type, (i % 3)::int as p_size from range(101) t(i)"
    whole = same_as_sql("edit_distance", part=part)
    monkeypatch.setattr(relational, "CHUNK", 2)
    assert same_as_sql("edit_distance", part=part) == whole and len(whole) > 500


def test_values_that_repeat_are_measured_once(spark):
    rows = spark.range(3000).select("id", F.lit(1).alias("g"), (F.col("id") % 4).cast("string").alias("s"))
    measured = spark.sparkContext.accumulator(0)

    def length(x, y):
        measured.add(1)
        return len(x) + len(y)

    udf = F.udf(length, "int")
    assert relational.compared_pairs(rows, ["g"], "id", "s", udf, "d").agg(F.count("*"), F.sum("d")).first() == (4498500, 2 * 4498500)
    assert measured.value < 100


def test_best_by_kmers_equals_the_table(spark):
    rng = random.Random(8)
    known = sorted({"".join(rng.choice(s) for _ in range(rng.choice((3, 6, 9)))) for s in ("ACGT", "AC", "ACGN") for _ in range(40)})
    pieces = known[::3] + ["".join(rng.choice(s) for _ in range(rng.choice((2, 5, 8)))) for s in ("ACGT", "AC", "ACGN") for _ in range(60)]
    for k, least in ((2, 2), (3, 1)):
        index = align.KmerTable(known, k)
        piece, name, _ = index.candidates(align._matrix(pieces)[0], least, most=1)
        want = sorted((int(i), known[j]) for i, j in zip(piece, name))
        rows, listed = spark.createDataFrame(list(enumerate(pieces)), "i long, s string"), spark.createDataFrame([(x,) for x in known * 2], "barcode string")
        got = sorted((r.i, r.barcode) for r in relational.best_by_kmers(rows, listed, "s", "barcode", k, least).collect())
        assert got == want and 40 < len(got) < len(pieces)


def test_barcodes_are_not_sent_to_the_driver(spark, same_as_sql, monkeypatch):
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: pytest.fail("a list of all barcodes is broadcast"))
    assert len(same_as_sql("barcodes_by_kmers", customer="select i::bigint as c_custkey from range(3000) t(i)")) == 3000


def test_barcodes_whose_kmers_another_holds(same_as_sql):
    assert len(same_as_sql("barcodes_by_kmers", customer="select i::bigint as c_custkey from (values (29898), (504797), (7)) t(i)")) == 3


def test_barcodes_are_not_broadcast_by_spark(spark, tmp_path):
    spark.range(3000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    df = entry.queries()["barcodes_by_kmers"](spark, str(tmp_path))
    assert len(df.collect()) == 3000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("disregard", [False, True])
def test_nearest_heads_equal_brute_force(most, disregard):
    rng = random.Random(most)
    umis = list(dict.fromkeys("".join(rng.choice("ACGT") for _ in range(rng.choice(sizes))) for sizes, n in (((9, 10, 10, 11), 400), ((0, 1, 2, 3, 5, 8, 14), 200)) for _ in range(n)))
    heads, brute = ordered._Heads(most, disregard), []
    for u in umis:
        near = min(((d, i) for i, h in enumerate(brute) if (d := ordered._distance(h, u, most, disregard)) is not None), default=None)
        got = heads.nearest(u)
        assert got == (near and brute[near[1]])
        if near is None:
            brute.append(heads.add(u))
    assert heads.names == brute and len(brute) > 10


def test_large_groups_of_umis(spark):
    rows = spark.range(12_000).select(F.lit("g").alias("k"), F.lpad((F.col("id") * 7919 % 100_000).cast("string"), 5, "0").alias("umi"), F.lit(True).alias("t"), F.lit(1).cast("long").alias("n"), F.col("id").alias("o"))
    assert in_time(spark, ordered.umi_clusters(rows, ["k"], "umi", "t", "n", "o", 1), 90) == 12_000


def test_shared_kmers_of_names_that_repeat(spark, same_as_sql, monkeypatch):
    part = "select (i * 37 % 101)::bigint as p_partkey, case when i % 9 = 4 then null else ['large ring', 'small ring', 'large rings', 'bolt', 'hot'][i % 5 + 1] end as p_name from range(101) t(i)"
    whole = same_as_sql("shared_kmer_pairs", part=part)
    monkeypatch.setattr(relational, "CHUNK", 4)
    assert same_as_sql("shared_kmer_pairs", part=part) == whole and len(whole) > 500
    rows = spark.createDataFrame([(2, "abcdefgh"), (1, "abcdefghi"), (1, "abcdefgh"), (3, "abcdefgh")], "k long, s string")
    got = sorted(tuple(r) for r in relational.shared_kmer_pairs_within(rows, "k", "s", 3, 2).collect())
    assert got == [(1, 2, 6), (1, 2, 6), (1, 3, 6), (1, 3, 6), (2, 3, 6)]


def test_range_join_of_places_that_repeat(spark, same_as_sql, monkeypatch):
    part = "select i::bigint as p_partkey, (i * 7 % 50)::int as p_size from range(400) t(i)"
    events = "select i::bigint as event_id, case when i % 50 <> 7 then i % 1009 end::bigint as user_id from range(3000) t(i)"
    whole = same_as_sql("range_join_bins", part=part, events=events)
    monkeypatch.setattr(relational, "CHUNK", 3)
    assert same_as_sql("range_join_bins", part=part, events=events) == whole
    points = spark.createDataFrame([(5, None), (5, "p"), (5, "p"), (99, "q")], "at long, name string")
    ranges = spark.createDataFrame([(1, 6, None, 2), (1, 6, 7, None), (6, 8, 7, 1)], "lo long, hi long, x int, y int")
    got = sorted((tuple(r) for r in relational.range_join(points, ranges, "at", "lo", "hi", [], 4).select("name", "x", "y").collect()), key=repr)
    assert got == sorted([(n, *r) for n in (None, "p", "p") for r in ((None, 2), (7, None))], key=repr)
    assert relational.range_join(points.select("at"), ranges, "at", "lo", "hi", [], 4).count() == 6
    plan = relational.range_join(points, ranges, "at", "lo", "hi", [], 4)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Generate explode(__y" in plan  # pairs are made in a loop over lists


def test_pairs_of_lists_are_made_in_turns(spark, same_as_sql, monkeypatch):
    part = "select i::bigint as p_partkey, (i * 7 % 50)::int as p_size from range(400) t(i)"
    events = "select i::bigint as event_id, i % 1009 as user_id from range(3000) t(i)"
    whole = same_as_sql("range_join_bins", part=part, events=events)
    for turn in (1, 5):
        monkeypatch.setattr(relational, "TURN", turn)
        assert same_as_sql("range_join_bins", part=part, events=events) == whole
    monkeypatch.undo()

    def nodes(plan):
        inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan"}.get(plan.nodeName())
        below = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan, *(n for p in below for n in nodes(p))]

    points, ranges = spark.range(2000).selectExpr("id", "5 as at"), spark.range(2000).selectExpr("id as r", "4 as lo", "6 as hi")
    first = relational.range_join(points, ranges, "at", "lo", "hi", [], 4).select("id", "r").limit(1)
    assert len(first.collect()) == 1
    made = [n.metrics().apply("numOutputRows").value() for n in nodes(first._jdf.queryExecution().executedPlan()) if n.nodeName() == "Generate"]
    assert 2000 <= max(made) <= 2 * relational.TURN  # not 4 million, before the first is read
