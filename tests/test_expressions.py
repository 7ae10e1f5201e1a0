"""Sequence, interval and profile expressions against hand-computed fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import interval as iv
from strandlake.functions import profile as pf
from strandlake.functions import sequence as sq


def one(spark, column, **values):
    """Evaluate a column over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).collect()[0].x


def span(a, b):
    return F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"))


def spans(*pairs):
    return F.array(*[span(a, b) for a, b in pairs])


def tuples(rows):
    return [(r.start, r.end) for r in rows]


def test_reverse_complement(spark):
    assert one(spark, sq.revcomp("s"), s="AACGTN") == "NACGTT"
    assert one(spark, sq.revcomp("s"), s="") == ""
    assert one(spark, sq.revcomp_strict("s"), s="AXG") == "CNT"
    assert one(spark, sq.revcomp_chomped("s"), s="AACC\n") == "GGTT"


def test_counts_and_distances(spark):
    assert one(spark, sq.gc_percent("s"), s="GgAT") == 50.0
    assert one(spark, sq.gc_percent("s"), s="") is None
    assert one(spark, sq.hamming("a", "b"), a="ACGT", b="AGGA") == 2
    assert one(spark, sq.hamming("a", "b"), a="ACGT", b="ACG") == -1
    assert one(spark, sq.kmers("s", 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, sq.kmers("s", 3), s="AC") == []
    assert one(spark, sq.longest_run("s"), s="AACCCT") == 3
    assert one(spark, sq.trailing_run("s", "T"), s="ATTT") == 3
    assert one(spark, sq.motif_count("s", "ATTCC"), s="ATTCCATTCCA") == 2
    assert one(spark, sq.parse_ranges("s"), s="0-3,7") == [0, 1, 2, 3, 7]
    assert one(spark, sq.two_bit_decode("c", 6), c=27) == "AAACGT"
    assert one(spark, sq.human_time(F.lit(3723))) == "1:02:03"
    assert one(spark, sq.mean_phred("q"), q="!I") == 20.0
    assert one(spark, sq.id_token("s", 3), s="a_b_c_d") == "d" and one(spark, sq.id_token("s", 9), s="a_b") is None


def test_dense_window(spark):
    assert one(spark, sq.first_dense_window("s", "T"), s="T" * 10) == -1
    from strandlake.functions.align import polyt_start

    rng = random.Random(1)
    for _ in range(30):
        s = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 40))) + "T" * rng.randint(0, 30) + "".join(rng.choice("ACGT") for _ in range(20))
        assert one(spark, sq.first_dense_window("s", "T"), s=s) == polyt_start(s)


def test_slices_and_merges(spark):
    assert one(spark, sq.slice_1based("s", F.lit(2), F.lit(4), F.lit("-")), s="AACGT") == "CGT"
    f = one(spark, sq.flanks("s", F.lit(3), F.lit(4), F.lit("+"), 2), s="AACGTT")
    assert (f.left, f.right) == ("AA", "TT")
    assert one(spark, sq.trim_adapters("s", "GG", "CC"), s="TTGGAACCT") == "AA"
    assert one(spark, sq.merge_by_quality(F.col("a"), F.col("p"), F.col("b"), F.col("q")), a="AC", p="I!", b="GT", q="!I") == "AT"
    assert tuples(one(spark, sq.stretches("s", "A", 2), s="AACAAAGA")) == [(1, 2), (4, 6)]
    t = one(spark, sq.tiles(F.col("s"), 3, 5, 4), s="AACCGTTTTT")
    assert [(x.r1, x.r2) for x in t] == [("AAC", "CGG"), ("TTT", "AAA")]
    assert one(spark, sq.is_canonical(F.lit("CT"), F.lit("AC"), F.lit("-"))) is True
    assert one(spark, sq.nearest_site("s", F.lit(5), "GT"), s="AAAAAAGTAA") == 2


def test_interval_predicates(spark):
    assert one(spark, iv.overlaps(span(1, 5), span(5, 9))) is True and one(spark, iv.overlaps(span(1, 5), span(6, 9))) is False
    assert one(spark, iv.overlaps_at_least(span(1, 10), span(9, 20), 3)) is False and one(spark, iv.overlaps_at_least(span(1, 2), span(1, 9), 3)) is True
    assert one(spark, iv.contains(span(2, 5), span(1, 6), 1)) is True and one(spark, iv.equal_ranges(span(2, 5), span(1, 6), 1)) is True
    assert one(spark, iv.overlap_fraction(span(1, 10), span(6, 25))) == 0.5
    assert one(spark, iv.covers_start(span(1, 5), span(3, 9))) is True and one(spark, iv.covers_end(span(5, 9), span(3, 7))) is True


def test_interval_lists(spark):
    assert tuples(one(spark, iv.junctions(spans((1, 10), (20, 30), (31, 40))))) == [(11, 19)]
    assert one(spark, iv.junctions(spans((1, 10)))) == []
    assert one(spark, iv.total_length(spans((1, 10), (20, 30)))) == 21
    assert one(spark, iv.lists_overlap(spans((1, 2), (8, 9)), spans((3, 8)))) is True
    assert tuples(one(spark, iv.until(spans((1, 5), (8, 12)), F.lit(9).cast("long")))) == [(1, 5), (8, 9)]
    assert one(spark, iv.coverage_fraction(spans((1, 5)), spans((1, 10)))) == 0.5
    b = one(spark, iv.best_feature(span(5, 10), spans((1, 5), (7, 30), (8, 30))))
    assert (b.start, b.end) == (7, 30)
    assert one(spark, iv.best_feature(span(5, 10), spans((11, 12)))) is None
    u = one(spark, iv.trailing_unique(spans((1, 10)), spans((5, 20))))
    assert tuples(u.left) == [(1, 4)] and tuples(u.right) == [(11, 20)]
    assert tuples(one(spark, iv.utr_blocks(spans((1, 10), (20, 30)), F.lit(5).cast("long"), F.lit(25).cast("long"), F.lit("+")))) == [(6, 10), (20, 25)]
    r = one(spark, iv.parse_regions(F.lit(";%;chr_1_5_9_+;%;X_1_2_-")))
    assert [(x.chr, x.start, x.end, x.strand) for x in r] == [("chr_1", 5, 9, "+"), ("X", 1, 2, "-")]


@pytest.mark.parametrize(("cigar", "want"), [("10M", [(101, 110)]), ("5S10M5N4M2I3M1D2M", [(101, 110), (116, 125)]), ("3M2S", [(101, 103)]), ("5I", []), ("*", [])])
def test_cigar_blocks(spark, cigar, want):
    assert tuples(one(spark, iv.cigar_blocks(F.lit(100).cast("long"), F.lit(cigar)))) == want


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_profiles(spark):
    assert one(spark, pf.diff_only_present(ints(1, 0, -1, 1), ints(1, 1, -1, -1))) == 1
    assert one(spark, pf.diff_only_present(ints(1), ints(1, 1))) == -1
    assert one(spark, pf.fill_gaps(ints(0, 1, 0, 0, 1, 0))) == [0, 1, -1, -1, 1, 0] and one(spark, pf.fill_gaps(ints(0, 0))) == [0, 0]
    assert one(spark, pf.merge(ints(0, 1, -1), ints(1, 0, -1))) == [1, 1, -1] and one(spark, pf.merge(ints(1), ints(-1))) is None
    assert one(spark, pf.signed_cover_diff(ints(3, -2, 0), ints(-1, -1, 1))) == 3
    assert one(spark, pf.matching_places(ints(1, 0), ints(1, 1))) == [1, 0]
    assert one(spark, pf.is_subprofile(ints(-1, 1, -1, 1), ints(1, 1, -1, 1))) is True and one(spark, pf.is_subprofile(ints(-1, -1), ints(1, 1))) is None
    assert one(spark, pf.feature_profile(spans((1, 5), (8, 9)), spans((1, 5), (8, 20), (30, 40)))) == [1, -1, 0]
    assert one(spark, pf.is_complete(ints(0, 1, 0, 1))) is False and one(spark, pf.is_complete(ints(0, 1, -1, 0))) is True
