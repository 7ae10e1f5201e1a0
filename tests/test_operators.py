"""Operators against fixtures: joins by bins, ordered and greedy operators, tests, pipelines, alignment, streams."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import align
from strandlake.operators import aggregate, ordered, pipelines, relational, stats
from strandlake.streaming import streams


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(4)
    a = [(i, rng.randint(0, 2), s := rng.randint(0, 500), s + rng.randint(0, 90)) for i in range(120)]
    b = [(i, rng.randint(0, 2), s := rng.randint(0, 500), s + rng.randint(0, 90)) for i in range(120)]
    x = spark.createDataFrame(a, "i long, chr int, a_start long, a_end long")
    y = spark.createDataFrame(b, "j long, chr int, b_start long, b_end long")
    got = sorted((r.i, r.j) for r in relational.interval_join(x, y, ["chr"], 64).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    alone = sorted(r.i for r in relational.anti_interval_join(x, y, ["chr"], "i", 64).collect())
    assert alone == sorted({p[0] for p in a} - {i for i, _ in got})
    plan = relational.interval_join(x, y, ["chr"], 64)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_umi_clusters(spark):
    rows = [("g", "ACGT", True, 2, 1), ("g", "ACGA", True, 3, 2), ("g", "TTTT", True, 1, 3), ("g", "ACGT", True, 1, 4)]
    d = spark.createDataFrame(rows, "k string, umi string, trusted boolean, n long, o long")
    def clusters(most):
        return {r.umi: r.cluster for r in ordered.umi_clusters(d, ["k"], "umi", "trusted", "n", "o", most).collect()}
    assert clusters(1) == {"ACGT": "ACGT", "ACGA": "ACGT", "TTTT": "TTTT"}
    assert set(clusters(-1).values()) == {"ACGT"}
    short = spark.createDataFrame([("g", "ACGT", True, 1, 1), ("g", "CGT", False, 1, 2)], d.schema)
    assert {r.cluster for r in ordered.umi_clusters(short, ["k"], "umi", "trusted", "n", "o", 0).collect()} == {"ACGT"}


def test_umi_clusters_take_the_nearest_head(spark):
    rows = [("g", "AAAAAAAA", True, 1, 1), ("g", "AAAATTTT", True, 1, 2), ("g", "AAAAATTT", True, 1, 3), ("g", "AAAAAATT", True, 1, 4)]
    d = spark.createDataFrame(rows, "k string, umi string, trusted boolean, n long, o long")
    got = {r.umi: r.cluster for r in ordered.umi_clusters(d, ["k"], "umi", "trusted", "n", "o", 3).collect()}
    assert got == {"AAAAAAAA": "AAAAAAAA", "AAAATTTT": "AAAATTTT", "AAAAATTT": "AAAATTTT", "AAAAAATT": "AAAAAAAA"}
    two = spark.createDataFrame([("g", u, True, 1, i) for i, u in enumerate(["AAAAAAAA", "AAATTTAA", "AAAATTAA"])], d.schema)
    got = {r.umi: r.cluster for r in ordered.umi_clusters(two, ["k"], "umi", "trusted", "n", "o", 2).collect()}
    assert got["AAATTTAA"] == "AAATTTAA" and got["AAAATTAA"] == "AAATTTAA"  # two edits from the first head, one from the second
    whole = spark.createDataFrame([("g", u, True, 1, i) for i, u in enumerate(["ACGTACGT", "CGTAC", "CGTACG"])] + [("h", u, True, 1, i) for i, u in enumerate(["TTACGTTT", "GACGTG", "ACGT"])], d.schema)
    got = {(r.k, r.umi): r.cluster for r in ordered.umi_clusters(whole, ["k"], "umi", "trusted", "n", "o", 0).collect()}
    assert got["g", "CGTACG"] == "ACGTACGT" and got["h", "ACGT"] == "GACGTG"


def test_recall_and_umi_distances(spark):
    d = spark.createDataFrame([(16, True, "ACGTACGT", "ACGTACGT", True), (16, False, "ACGTACGA", "ACGTACGT", True), (14, True, "ACGTATTT", "ACGTACGT", False), (None, False, "A" * 20, "A" * 12, False)], "score int, ok boolean, umi string, truth string, trusted boolean")
    got = {r.score: (r.called, r.correct, r.precision, r.recall) for r in aggregate.accuracy_by_threshold(d, "score", "ok", recall=True).collect()}
    assert got == {16: (2, 1, 50.0, 25.0), 14: (3, 2, pytest.approx(200 / 3), 50.0)}
    r = aggregate.umis_within(d, "umi", "truth", "trusted").first()
    assert (r.within_1, r.within_2, r.within_3, r.trusted_within_1, r.trusted_within_3) == (3, 4, 4, 2, 2)


def test_codon_tables_are_compressed_and_gated(spark):
    cells = [("g", r, c, n) for r, row in {"A": (30, 5, 1), "B": (4, 40, 2), "C": (1, 2, 3)}.items() for c, n in zip("xyz", row)] + [("h", "A", "x", 2), ("h", "B", "y", 2), ("i", "A", "x", 50)]
    d = spark.createDataFrame(cells, "k string, r string, c string, n long")
    got = {(x.r, x.c): x.n for x in stats.compress_tables(d, ["k"], "r", "c", "n").filter("k = 'g'").collect()}
    assert got == {("B", "y"): 40, ("B", "z+x"): 6, ("C+A", "y"): 7, ("C+A", "z+x"): 35}
    out = stats.codon_dependency(d, ["k"], "r", "c", "n").collect()
    n, diff = 88, 40 * 35 - 6 * 7
    want = n * (diff - n / 2) ** 2 / (46 * 42 * 47 * 41)
    assert [x.k for x in out] == ["g"] and out[0].chi2 == pytest.approx(want) and out[0].fdr == pytest.approx(stats.chi2_p(want))


def test_guides_are_rescued_by_sequence(spark):
    reads = spark.createDataFrame([("b", "g1", "u1", True, None), ("b", "g2", "u2", False, "ACGT"), ("b", "g2", "u3", False, "ACGT"), ("b", "g2", "u4", False, "AAAA"), ("c", "g2", "u1", False, "ACGT"), ("d", "g2", "u1", True, "ACGT")], "barcode string, guide string, umi string, verified boolean, guide_seq string")
    guides = spark.createDataFrame([("g1", "ACGT"), ("g2", "TTTT")], "guide string, seq string")
    assert {(r.barcode, r.guide, r.umis) for r in pipelines.guide_calls(reads, guides=guides).collect()} == {("b", "g1", 3), ("c", "g1", 1), ("d", "g2", 1)}


def test_ranked_collapse_and_coordinates(spark):
    d = spark.createDataFrame([("g", "AAAA")] * 3 + [("g", "AAAT")] + [("g", "TTTT")], "k string, umi string")
    assert {(r.umi, r.n) for r in ordered.ranked_umi_collapse(d, ["k"], "umi", 2).collect()} == {("AAAA", 3), ("TTTT", 1)}
    c = spark.createDataFrame([("b", 1, 100, 200), ("b", 2, 105, 203), ("b", 3, 120, 220)], "k string, o long, s long, e long")
    assert [r.o for r in ordered.coordinate_dedup(c, ["k"], "s", "e", "o", 10, 10).orderBy("o").collect()] == [1, 3]


def test_thinning_dominance_saturation(spark):
    p = spark.createDataFrame([("c", x) for x in (10, 60, 115, 200, 214)], "k string, pos long")
    assert [r.pos for r in ordered.thin_positions(p, "k", "pos", 100).orderBy("pos").collect()] == [10, 115]
    g = spark.createDataFrame([("x", "g1", 5), ("x", "g2", 3), ("y", "g1", 5), ("y", "g2", 2), ("z", "g1", 1), ("z", "g2", 1)], "k string, v string, n long")
    assert {(r.k, r.v) for r in ordered.dominance(g, "k", "v", "n").collect()} == {("y", "g1")}
    s = spark.createDataFrame([(i, v) for i, v in enumerate("aabbccddee")], "o long, v string")
    assert [r.n_distinct for r in ordered.saturation(s, "o", ["v"]).orderBy("step").collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert ordered.saturation(s.limit(0), "o", ["v"]).count() == 0
    ranked = ordered.rank_all(s.select("o"), "o", 10, per_range=3)
    assert [r["rank"] for r in ranked.orderBy("o").collect()] == list(range(1, 11))


def test_segments_and_runs(spark):
    d = spark.createDataFrame([("g", 1, 10), ("g", 5, 20), ("g", 30, 31)], "k string, s long, e long")
    assert [(r.s, r.e, r.depth) for r in ordered.split_segments(d, ["k"], "s", "e").orderBy("s").collect()] == [(1, 4, 1), (5, 10, 2), (11, 20, 1), (30, 31, 1)]
    m = spark.createDataFrame([("a", ["x1", "x2"]), ("b", ["q"])], "k string, v array<string>"), spark.createDataFrame([("a", ["x2"]), ("c", ["y"])], "k string, v array<string>")
    assert {r.k: r.v for r in relational.merge_collections(*m, "k", "v").collect()} == {"a": ["x2"], "b": ["q"], "c": ["y"]}
    assert {r.k: r.v for r in relational.merge_collections(*m, "k", "v", "union").collect()} == {"a": ["x1", "x2"], "b": ["q"], "c": ["y"]}


def test_histogram_edges_and_bins(spark):
    d = spark.createDataFrame([(x,) for x in (2.0, 4.0, 4.1, 0.0, -1.0, None)], "v double")
    assert {(r.bin, r.n) for r in aggregate.histogram(d, "v", [0, 2, 4]).collect()} == {(0, 1), (1, 2)}
    b = spark.createDataFrame([(4.9,), (5.0,), (100.0,)], "v double").select(aggregate.floor_bin(F.col("v"), [0, 5, 10, 50, 100]).alias("b"))
    assert [r.b for r in b.collect()] == [0.0, 5.0, 100.0]


def test_statistics():
    assert stats.chi2_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_p(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_p(0.0, 3) == 1.0


def test_adjusted_p_values(spark):
    d = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.04, None))], "i long, p double")
    got = {r.i: r.q for r in stats.adjust(d, "p", "q").collect()}
    assert got[0] == pytest.approx(0.04) and got[2] == pytest.approx(0.04) and got[1] == pytest.approx(0.04) and got[4] is None


@pytest.mark.parametrize(("freqs", "want"), [((0.5, 0.0), "somatic"), ((0.5, 0.3), "germline"), ((0.3, 0.1), "somatic")])
def test_snp_types(spark, freqs, want):
    rows = [(f"s{i}", "1", 7, round(100 * (1 - f)), round(100 * f), 0, 0) for i, f in enumerate(freqs)]
    p = spark.createDataFrame(rows, "sample string, chr string, pos long, A long, C long, G long, T long")
    ref = spark.createDataFrame([("1", 7, "A")], "chr string, pos long, ref string")
    (r,) = pipelines.call_snps(p, ref, keep_germline=True).collect()
    assert (r.alt, r.type) == ("C", want)


def test_molecules(spark):
    ex = "array<struct<start:bigint,end:bigint>>"
    a = spark.createDataFrame([("r1", "g", [(1, 5), (9, 12)]), ("r2", "g", [(1, 5), (9, 12), (20, 30)]), ("r3", "g", [(1, 5)]), ("r4", None, [(1, 5)])], f"read_id string, gene_id string, exons {ex}")
    c = spark.createDataFrame([("r1", "B", "ACGT", True), ("r2", "B", "ACGA", True), ("r3", "B", "TTTT", True), ("r4", "B", "TTTT", True)], "read_id string, barcode string, umi string, valid_umi boolean")
    assert sorted(r.read_id for r in pipelines.molecules(a, c, 1).collect()) == ["r2", "r3"]


def test_isoforms(spark):
    ex = "array<struct<start:bigint,end:bigint>>"
    t = spark.createDataFrame([("g", "t1", [(1, 10), (20, 30), (40, 50)]), ("g", "t2", [(1, 10), (40, 50)])], f"gene_id string, transcript_id string, exons {ex}")
    r = spark.createDataFrame([("a", "g", [(1, 10), (20, 30), (40, 45)]), ("b", "g", [(5, 10), (40, 50)]), ("c", "g", [(41, 49)]), ("d", "g", [(1, 10), (25, 30), (40, 50)])], f"read_id string, gene_id string, blocks {ex}")
    got = {x.read_id: (x.assignment_type, x.isoforms) for x in pipelines.assign_isoforms(r, t).collect()}
    assert got["a"] == ("unique", ["t1"]) and got["b"] == ("unique", ["t2"])
    assert got["c"][0] == "ambiguous" and got["d"][0] == "contradictory"
    kinds = {(x.anchor, x.kind) for x in pipelines.alternative_sites(t.withColumn("strand", F.lit("+"))).collect()}
    assert kinds == {(11, "acceptor"), (39, "donor")}


def test_consensus(spark):
    d = spark.createDataFrame([("b", [1, -1, 0])] * 5 + [("b", [-1, -1, 0]), ("x", [1]), ("x", [-1])], "k string, p array<int>")
    (r,) = pipelines.consensus_profiles(d, "k", "p").collect()
    assert (r.k, r.p, r.coverage, r.support) == ("b", [1, -1, 0], 6, 6)


def brute_local(t, p):
    best = 0
    h = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(t) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if p[i - 1] == t[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_local_alignment():
    rng = random.Random(2)
    for _ in range(60):
        t, p = ("".join(rng.choice("ACGT") for _ in range(rng.randint(0, 30))) for _ in range(2))
        score, a, b, c, d = align.local_align(t, p)
        assert score == brute_local(t, p) and brute_local(t[a:b], p[c:d]) == score
    assert align.local_align("TTACGTTT", "ACG") == (3, 2, 5, 0, 3)


def test_barcode_calls(spark):
    rng = random.Random(3)
    seqs = spark.createDataFrame([(f"t{i}", "".join(rng.choice("ACGT") for _ in range(300)), 1000.0) for i in range(5)], "transcript_id string, seq string, tpm double")
    for chemistry, kind, umi in (("10x", align.TENX, 12), ("double", align.DOUBLE, 9)):
        reads = pipelines.simulate_reads(seqs, 4000, chemistry, 10, umi, 1)
        calls = align.call_barcodes(reads, reads.select("barcode"), kind).join(reads.select("read_id", F.col("barcode").alias("truth"), F.col("umi").alias("true_umi")), "read_id").collect()
        assert len(calls) == 20
        assert sum(r.barcode == r.truth for r in calls) >= 19
        until_t = [r.true_umi.startswith(r.umi) and not r.true_umi[len(r.umi) :].strip("T") for r in calls]  # a UMI that ends in T runs into the poly-T
        assert sum(until_t) >= 19
        blocks = align.call_barcodes(reads, reads.select("barcode"), kind, block=3)
        assert {(r.read_id, r.barcode) for r in blocks.collect()} == {(r.read_id, r.barcode) for r in calls}


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tmp_path / "in"
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(folder))
    stream = streams.read_events(spark, str(folder), 10).withColumn("ts", F.col("ts").cast("timestamp"))
    got = streams.run_to_table(streams.tumbling_counts(stream, late="400 days"), "hours", str(tmp_path / "c"), mode="complete")
    want = streams.tumbling_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert {(r.start, r.event_type, r.n) for r in got.collect()} == {(r.start, r.event_type, r.n) for r in want.collect()}
    s = streams.sessions(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert s.agg(F.sum("n")).first()[0] == events.count()
