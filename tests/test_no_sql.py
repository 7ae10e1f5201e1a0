"""Registered queries that SQL cannot express, and operators behind them, against brute force over the tables' own rows."""

import collections
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandlake.functions import align
from strandlake.operators import ordered, stats
from strandlake.sources import readers

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in entry.queries()[name](spark, SF).collect())


def table(sql):
    return duckdb.sql(sql.replace("$", f"{SF}/")).fetchall()


def test_thin_positions(spark):
    by = collections.defaultdict(list)
    for k, p in table("select l_suppkey, l_orderkey * 3 from '$lineitem.parquet'"):
        by[k].append(p)
    want = []
    for k, ps in by.items():
        last = None
        for p in sorted(ps):
            if last is None or p - last >= 100:
                last = p
                want.append((k, p))
    assert rows(spark, "thin_positions", "l_suppkey", "pos") == sorted(want)


def near(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_greedy_cluster(spark):
    by = collections.defaultdict(dict)
    for k, u, c in table("select c_nationkey, substr(reverse(c_name), 1, 5), c_custkey from '$customer.parquet'"):
        by[k][u] = min(c, by[k].get(u, c))
    want = []
    for k, umis in by.items():
        heads = []
        for u in sorted(umis, key=lambda u: (umis[u], u)):
            found = [(near(h, u) - abs(len(h) - len(u)), i) for i, h in enumerate(heads)]
            found = [f for f in found if f[0] <= 1]
            if not found:
                heads.append(u)
            want.append((k, u, heads[min(found)[1]] if found else u))
    assert rows(spark, "greedy_cluster", "c_nationkey", "umi", "cluster") == sorted(want)


@pytest.mark.parametrize(("most", "disregard", "want"), [(2, False, "AAAATTTT"), (0, True, "AAAAATTT"), (0, False, "AAAAATTT"), (3, True, "AAAATTTT"), (-1, False, "AAAAAAAA")])
def test_umis_join_the_nearest_head(spark, most, disregard, want):
    d = spark.createDataFrame([("g", u, True, 1, i) for i, u in enumerate(("AAAAAAAA", "AAAATTTT", "AAAAATTT"))], "k string, umi string, t boolean, n long, o long")
    got = {r.umi: r.cluster for r in ordered.umi_clusters(d, ["k"], "umi", "t", "n", "o", most, disregard).collect()}
    assert got["AAAAATTT"] == want
    short = spark.createDataFrame([("g", u, True, 1, i) for i, u in enumerate(("AAAAAAAA", "AAAAA"))], "k string, umi string, t boolean, n long, o long")
    joined = {r.umi: r.cluster for r in ordered.umi_clusters(short, ["k"], "umi", "t", "n", "o", max(most, 0), disregard).collect()}["AAAAA"]
    assert joined == ("AAAAAAAA" if not disregard or most >= 3 else "AAAAA")  # the difference of lengths counts or does not


def test_ranked_collapse(spark):
    by = collections.defaultdict(collections.Counter)
    for g, u in table("select event_type, lpad((user_id % 97)::varchar, 4, '0') from '$events.parquet'"):
        by[g][u] += 1
    want = []
    for g, c in by.items():
        kept = []
        for u in sorted(c, key=lambda u: (c[u], u), reverse=True):
            if all(near(u, k) >= 2 for k in kept):
                kept.append(u)
        want += [(g, u, c[u]) for u in kept]
    assert rows(spark, "ranked_collapse", "gene", "umi", "n") == sorted(want)


def test_coord_dedup(spark):
    by = collections.defaultdict(list)
    for u, i, s, v in table("select user_id, event_id, floor(epoch(ts))::bigint, trunc(value)::bigint from '$events.parquet'"):
        by[u].append((s, i, s + v))
    want = []
    for u, ev in by.items():
        kept = []
        for s, i, e in sorted(ev):
            if not any(abs(s - a) <= 3600 and abs(e - b) <= 3600 for a, b in kept):
                kept.append((s, e))
                want.append((u, i))
    assert rows(spark, "coord_dedup", "user_id", "event_id") == sorted(want)


def test_sw_best_match(spark):
    def score(t, p):
        h = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
        for i in range(1, len(p) + 1):
            for j in range(1, len(t) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if p[i - 1] == t[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        best = max(max(r) for r in h)
        return best, min((j for r in h for j, x in enumerate(r) if x == best), default=0) if best else 0

    fold = str.maketrans("abcdefghijklmnopqrstuvwxyz ", "ACGTACGTACGTACGTACGTACGTACA")
    want = []
    for k, name in table("select p_partkey, p_name from '$part.parquet'"):
        t = name.lower().translate(fold)
        want.append((k, *score(t, t[2:10][::-1].translate(str.maketrans("ACGT", "TGCA")))))
    assert rows(spark, "sw_best_match", "p_partkey", "score", "end") == sorted(want)


def test_detector_10x(spark):
    got = entry.queries()["detector_10x"](spark, SF).collect()
    assert len(got) == 400 and all(r.barcode == r.truth and r.strand in "+-" for r in got)


def read(rng, c, barcode, umi, first=20, tail="T" * 30):
    cdna = "".join(rng.choice("ACGT") for _ in range(200))
    head = "".join(rng.choice("ACG") for _ in range(first))
    part = c.first_part
    return head + c.primer + barcode[:part] + (c.linker or "") + barcode[part:] + umi + tail + cdna


def test_detectors_second_chance(spark):
    """Without a poly-T, or with one elsewhere, the anchor is found by strict rules in the whole read."""
    rng = random.Random(5)
    for c in (align.TENX, align.DOUBLE):
        known = sorted({"".join(rng.choice("ACGT") for _ in range(c.barcode)) for _ in range(200)})
        umi = "ACG" * (c.umi // 3)
        reads, kinds = [], []
        for i in range(60):
            b = known[i]
            whole = read(rng, c, b, umi)
            none = read(rng, c, b, umi, tail="ACGACGACGA")
            early = "T" * 20 + read(rng, c, b, umi, tail="T" * 12)
            reads += [whole, none, early, align.reverse_complement(whole)]
            kinds += [(b, "+"), (b, "."), (b, "+"), (b, "-")]
        got = align.detect(reads, c, align.KmerTable(known, c.barcode_k))
        assert sum(x == b for x, (b, _) in zip(got.barcode, kinds)) >= 0.95 * len(reads)
        for i in (0, 3):  # with a poly-T where it should be: strand, UMI and its validity
            some = got.iloc[i::4]
            assert (some.umi == umi).mean() >= 0.9 and some.valid_umi.mean() >= 0.9 and set(some.strand) == {"+" if i == 0 else "-"}
        listed = align.detect(reads[::4], c, align.KmerTable(known, c.barcode_k), align.KmerTable([umi], align.UMI_K))
        assert (listed.umi == umi).mean() >= 0.9


def test_batched_kernels_equal_single_ones():
    rng = random.Random(3)
    draw = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    texts, patterns = [draw(rng.randint(1, 30)) for _ in range(200)], [draw(rng.randint(1, 16)) for _ in range(200)]
    texts, patterns = [t.replace("N", "A") for t in texts], [p.replace("N", "C") for p in patterns]
    got = align.align_batch(align._matrix(texts)[0], align._matrix(patterns)[0])
    assert [tuple(g) for g in got.tolist()] == [align.local_align(t, p) for t, p in zip(texts, patterns)]
    seqs = [draw(rng.randint(0, 80)).replace("A", "T") for _ in range(200)]
    assert align.polyt_starts(*align._matrix(seqs)).tolist() == [align.polyt_start(s) for s in seqs]
    known = sorted({draw(16).replace("N", "G") for _ in range(200)})
    pieces = [k[:5] + rng.choice("ACGT") + k[6:] + "A" for k in known[:50]]
    table_, index = align.KmerTable(known, 6), align.KmerIndex(known, 6)
    piece, name, shared = table_.candidates(align._matrix(pieces)[0])
    for i, p in enumerate(pieces):
        assert [(known[k], n) for j, k, n in zip(piece, name, shared) if j == i] == index.candidates(p, 2, 3, 10)


def test_mex_cells_that_look_like_the_size_line(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n%\n3 3 5\n1 1 2\n1 2 1\n2 2 4\n3 3 5\n3 1 9\n")
    (tmp_path / "features.tsv").write_text("a\tA\nb\tB\nc\tC\n")
    (tmp_path / "barcodes.tsv").write_text("x\ny\nz\n")
    got = sorted((r.feature_id, r.barcode, r["count"]) for r in readers.read_mex(spark, str(tmp_path)).collect())
    assert got == [("a", "x", 2.0), ("a", "y", 1.0), ("b", "y", 4.0), ("c", "x", 9.0), ("c", "z", 5.0)]


def test_harmonic_number(spark):
    for n in (1, 2, 256, 257, 1000, 100_000):
        (r,) = spark.range(1).select(stats.harmonic_number(F.lit(n)).alias("h")).collect()
        assert r.h == pytest.approx(sum(1 / i for i in range(1, n + 1)), rel=1e-13)


def test_ranked_collapse_by_barcode(spark):
    by = collections.defaultdict(collections.Counter)
    for g, b, u in table("select event_type, user_id % 3, lpad((user_id % 89)::varchar, 4, '0') from '$events.parquet'"):
        by[g, b][u] += 1
    want = []
    for (g, b), c in by.items():
        kept = []
        for u in sorted(c, key=lambda u: (c[u], u), reverse=True):
            if all(near(u, k) >= 2 for k in kept):
                kept.append(u)
        want += [(g, b, u, c[u]) for u in kept]
    assert rows(spark, "ranked_collapse_by_barcode", "gene", "barcode", "umi", "n") == sorted(want)


def test_profiles_clustered(spark):
    by = collections.defaultdict(dict)
    for u, k in table("select user_id, event_id from '$events.parquet'"):
        p = (k % 3 - 1, k // 3 % 3 - 1, k // 7 % 3 - 1)
        first, n = by[u].get(p, (k, 0))
        by[u][p] = (min(first, k), n + 1)
    want = []
    for u, ps in by.items():
        heads = []
        for p, (_, n) in sorted(ps.items(), key=lambda x: x[1][0]):
            for h in heads:
                if all(x == 0 or y == 0 or x == y for x, y in zip(h[0], p)):
                    h[0] = [x or y for x, y in zip(h[0], p)]
                    h[1] += n
                    break
            else:
                heads.append([list(p), n])
        for p, n in heads:
            at = [i for i, x in enumerate(p) if x]
            want.append((u, tuple(-1 if x == 0 and at and at[0] < i < at[-1] else x for i, x in enumerate(p)), n))
    got = sorted((r.user_id, tuple(r.profile), r.support) for r in entry.queries()["profiles_clustered"](spark, SF).collect())
    assert got == sorted(want)


def test_gamma_expression(spark):
    n = [r["count"] for r in entry.queries()["gamma_expression"](spark, "/root/testdata/sf0.01").collect()]
    mean = sum(n) / len(n)
    assert mean == pytest.approx(0.7 * 200, rel=0.12) and sum((x - mean) ** 2 for x in n) / len(n) == pytest.approx(0.7 * 200**2, rel=0.3)


def test_bam_in_splits_of_any_size(spark, tmp_path):
    """Every record once, whatever the splits; long records, long names, all kinds of tags, unmapped reads."""
    import struct

    from strandlake.sources import bam

    rng = random.Random(1)
    draw = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    made = []
    for i in range(400):
        n = rng.choice([0, 1, 30, 31, 200, 150_000 if i % 97 == 0 else 50])
        seq = draw(n) or None
        qual = "".join(chr(33 + rng.randrange(40)) for _ in range(n)) if n and i % 3 else None
        mapped = i % 5 > 0
        made.append((f"read{i}" + "x" * (i % 200), 0 if mapped else 4, rng.choice(["a", "b"]) if mapped else None, i * 7 if mapped else None, 60, f"{n}M" if mapped and n else None, seq, qual, {"CB": f"B{i}", "XX": "text with spaces"}))
    schema = "read_id string, flag int, chr string, start long, mapq int, cigar string, seq string, qual string, tags map<string,string>"
    folder = f"file://{tmp_path}/bam"
    assert bam.write_bam(spark.createDataFrame(made, schema).coalesce(1), folder, [("a", 10_000), ("b", 10_000)]) == 1
    for size in (1_000, 7_001, 50_000, 1 << 30):
        got = bam.read_bam(spark, folder, size).drop("blocks").collect()
        assert sorted((tuple(r)[:8], tuple(sorted(r.tags.items()))) for r in got) == sorted(((*m[:8],), tuple(sorted(m[8].items()))) for m in made), size
    one = next((tmp_path / "bam").glob("*.bam"))
    assert bam.read_bam(spark, f"file://{one}").count() == len(made)
    values = b"ASA!" + b"NMC\x05" + b"XIi" + struct.pack("<i", -7) + b"XFf" + struct.pack("<f", 0.5) + b"BBBs" + struct.pack("<i2h", 2, 3, -4)
    assert dict(bam._tag_map(values)) == {"AS": "!", "NM": "5", "XI": "-7", "XF": "0.5", "BB": "s,3,-4"}
    import gzip

    assert gzip.decompress(one.read_bytes())[:4] == b"BAM\x01"  # any gzip reader reads it


def test_monitors_on_a_stream(spark, tmp_path):
    from strandlake.streaming import streams

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), 1)
    top = streams.run_to_table(streams.running_maxima(stream, "event_type", "value"), "tops", str(tmp_path / "c"), mode="complete")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, streams.running_maxima(events, "event_type", "value").collect()))
    loud = streams.run_to_table(streams.alerts(stream, "value", 300.0).select("event_id"), "loud", str(tmp_path / "d"))
    assert sorted(r[0] for r in loud.collect()) == sorted(r[0] for r in events.filter("value > 300").select("event_id").collect())
