"""Domain operators and generators on small tables."""

import pytest
from pyspark.sql import functions as F

from strandlake.operators import domain as d
from strandlake.operators import simulate as sim

EX = "array<struct<start:bigint,end:bigint>>"


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_filters(spark):
    counts = frame(spark, "exon string, include long, exclude long", ("a", 5, 6), ("b", 20, 0), ("c", 1, 1))
    assert rows(d.filter_exon_counts(counts, 10), "exon") == [("a",)] and rows(d.filter_exon_counts(counts, 10, True), "exon") == [("a",), ("b",)]
    iso = frame(spark, "gene_id string, transcript_id string, tpm double", *[("g", f"t{i}", 5.0) for i in range(6)])
    assert rows(d.hold_out(iso, 1, 1.0, 1.0).filter("not held_out"), "transcript_id") == [("t0",)]
    assert rows(d.restore_versions(frame(spark, "short string", ("E1",), ("E9",)), frame(spark, "id string", ("E1.5",)), "id"), "full_id") == [("E1.5",)]
    assert rows(d.split_column(frame(spark, "k int, c string", (1, "a::b")), "c", ["x", "y"]), "k", "x", "y") == [(1, "a", "b")]
    al = frame(spark, f"read_id string, flag int, cigar string, blocks {EX}", ("r1", 0, "5M10N5M", [(1, 5), (16, 20)]), ("r2", 256, "5M", [(1, 5)]), ("r3", 0, "3M", [(1, 3)]))
    assert rows(d.filter_reads(al, spliced=True), "read_id") == [("r1",)] and rows(d.filter_reads(al, min_aligned=3), "read_id") == [("r1",), ("r3",)]


def test_joins(spark):
    a = frame(spark, "read_id string, barcode string, umi string", ("r1", "*", "*"), ("r2", "A", "ACGTACGTAC"), ("r3", "A", "ACGTACGTA"))
    b = frame(spark, "read_id string, barcode string, umi string", ("r1", "B", "AC"), ("r2", "B", "ACGTACGTA"), ("r3", "B", "ACGTACGTA"))
    assert rows(d.merge_two_calls(a, b), "read_id", "barcode") == [("r1", "B"), ("r2", "B"), ("r3", "A")]
    reads = frame(spark, "read_id string, barcode_read string", ("x", "A" * 16 + "TT"), ("y", "C" * 14 + "GG"), ("z", "G" * 20))
    cl = frame(spark, "barcode string, cluster string", ("A" * 16, "one"), ("C" * 14, "two"))
    assert rows(d.cluster_of_barcode(reads, cl), "read_id", "cluster") == [("x", "one"), ("y", "two")]
    ex = frame(spark, "gene_id string, start long, end long", ("g", 1, 10), ("g", 20, 30))
    got = {r.start: r.normal for r in d.normalise_exons(frame(spark, "gene_id string, start long, end long", ("g", 1, 10), ("g", 22, 40), ("g", 50, 60)), ex).collect()}
    assert (got[1].start, got[22].start, got[50]) == (1, 20, None)
    with pytest.raises(Exception, match="missing key"):
        d.strict_lookup(frame(spark, "k int", (1,), (2,)), frame(spark, "k int, v int", (1, 1)), "k").collect()
    snp = "chr string, pos long, ref string, alt string, cov long, reads long"
    t1, t2 = frame(spark, snp, ("1", 5, "A", "C", 10, 5), ("1", 6, "A", "C", 10, 5)), frame(spark, snp, ("1", 5, "A", "C", 30, 5))
    assert rows(d.intersect_snps([t1, t2], 5, 0.4), "pos", "freq") == [(5, 0.25)]
    merged = d.merge_cells(frame(spark, "read string, barcode_id int", ("r", 1), ("q", 2)), frame(spark, "barcode_id int, cell_id int", (1, 7), (2, 8)), frame(spark, "cell_id int, spot_type string, cell_type1 string, region string", (7, "singlet", "T", "X"), (8, "doublet", "T", "X")))
    assert rows(merged.na.fill("-"), "read", "group_id") == [("q", "-"), ("r", "T_X")]


def test_aggregations(spark):
    t = frame(spark, f"gene_id string, transcript_id string, exons {EX}", ("g", "a", [(1, 1000), (2001, 3000)]), ("g", "b", [(1, 500)]))
    assert rows(d.gene_lengths(t), "longest", "mean_length", "spliced", "bin") == [(2000, 1250, True, 2)]
    cov = frame(spark, "left double, right double", (0.0, 0.0), (0.5, 0.0))
    got = {r.bin: r.n for r in d.coverage_profile(cov).collect()}
    assert got[0] == 1 and got[99] == 2 and got[49] == 1 and got[50] == 2
    al = frame(spark, "chr string, flag int, start long, cigar string, qual string", ("1", 0, 100, "2S2M", "!!II"), ("1", 0, 100, "4M", "IIII"))
    assert rows(d.quality_by_event(al), "op", "quality", "n") == [("M", 40, 6), ("S", 0, 2)]
    assert rows(d.end_positions(al, 0, 200), "pos", "n") == [(98, 1), (100, 1)]
    two = d.length_distribution({"a": frame(spark, "l int", (1,), (3,)), "b": frame(spark, "l int", (3,))}, "l", 5)
    assert rows(two, "length", "a", "b") == [(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, 0, 0)]
    assert rows(d.arg_max(frame(spark, "k int, v string, n int", (1, "a", 2), (1, "b", 2)), "k", "v", "n"), "v") == [("b",)]
    calls = frame(spark, "barcode string, truth string", ("A", "A"), ("A", "B"), ("B", "B"))
    assert rows(d.precision_by_barcode(calls), "barcode", "bin", "poor") == [("A", 50, True), ("B", 100, False)]
    assert [r.n_distinct for r in d.shuffled_saturation(frame(spark, "i long, v string", *[(i, v) for i, v in enumerate("aabb")]), "i", ["v"], 1, 2).orderBy("step").collect()][-1] == 2
    reads = frame(spark, "read_id string, gene_id string", *[(f"r{i}", "g") for i in range(40)])
    curve = {r.tenth: r.median for r in d.subsampling_curve(reads, 10, 3).collect()}
    assert curve[9] == 1 and curve[1] == 0


def test_profiles_and_contigs(spark):
    p = frame(spark, "k string, p array<int>, o int", ("b", [1, 0, 0], 1), ("b", [0, 0, 1], 2), ("b", [-1, 0, 1], 3))
    assert sorted((tuple(r.p), r.support) for r in d.cluster_profiles(p, "k", "p", "o").collect()) == [((-1, -1, 1), 1), ((1, -1, 1), 2)]
    contigs = frame(spark, f"contig string, gene_id string, blocks {EX}", ("c1", "g", [(1, 20)]), ("c2", "g", [(1, 2)]), ("c3", "g", [(1, 20)]), ("c3", "h", [(1, 20)]))
    codons = frame(spark, "gene_id string, kind string, pos long", ("g", "start", 5), ("g", "stop", 15))
    assert rows(d.covered_codons(contigs, codons), "contig", "kind") == [("c1", "pair"), ("c2", "none")]
    assert rows(d.split_map(frame(spark, "id string", ("n1_barcodeIDs_a,b",)), "id"), "contig", "barcode") == [("n1", "a"), ("n1", "b")]
    places = [("c", "1", 0, 0, 99, True), ("c", "1", 5000, 100, 200, False), ("d", "1", 0, 0, 99, True), ("d", "1", 90, 100, 200, False)]
    places += [("e", "1", 0, 0, 99, True), ("e", "1", 1100, 100, 200, False)]  # exactly 1000 farther apart
    places += [("f", "1", 0, 0, 99, True), ("f", "1", 9000, 50, 149, False)]  # half of the contig is shared
    places += [("g", "1", 0, 0, 99, True), ("g", "2", 0, 100, 200, False), ("h", "1", 0, 0, 99, False), ("h", "1", 9000, 100, 200, False)]
    mis = frame(spark, "contig string, chr string, start long, q_start long, q_end long, is_primary boolean", *places)
    assert rows(d.distant_misassemblies(mis), "contig") == [("c",), ("e",), ("g",)]
    r = frame(spark, f"exons {EX}, blocks {EX}, strand string", ([(1, 10), (21, 30)], [(6, 10), (21, 30)], "-"))
    assert rows(d.clipped_fractions(r), "left", "right") == [(0.0, 0.25)]
    bed = frame(spark, "start long, block_sizes string, block_starts string", (0, "10,5,", "0,20,"))
    b = d.bed12_exons(bed).collect()[0]
    assert [(e.start, e.end) for e in b.exons] == [(1, 10), (21, 25)] and [(e.start, e.end) for e in b.introns] == [(11, 20)]
    e = d.expected_distinct(frame(spark, "c string, n long", ("x", 1), ("y", 1), ("z", 2)), "n", 2).first().expected
    assert e == pytest.approx(0.5 + 0.5 + (1 - 1 / 6))


def test_sequence_work(spark):
    assert d.good_adapter("ACGTACGT", ["TTACGTACGTTT"]) and not d.good_adapter("ACGTACGT", ["TTTTTT"])
    seq = "GG" + "ACGTACGTACGTACGT" + "CCCCCCCCCC" + "T" * 9
    known = frame(spark, "barcode string", ("ACGTACGTACGTACGT",))
    assert rows(d.barcode_before_t9(frame(spark, "read_id string, seq string", ("r", seq)), known), "barcode") == [("ACGTACGTACGTACGT",)]
    flank = d.tag_flanks(frame(spark, "seq string, cr string, ur string", ("AACCGGTTACGT", "CCGG", "ACG")), "cr", "ur", 2)
    assert rows(flank, "left", "middle", "right") == [("AA", "TT", "TT")]
    halves = d.linker_halves(frame(spark, "seq string", ("AAAAAAAALINKCCCCCC",), ("GG",)), frame(spark, "part string", ("AAAAAAAA",)), frame(spark, "part string", ("GGGGGG",)), "LINK")
    assert rows(halves, "status") == [("left",), ("no linker",)]
    guides = frame(spark, "seq string, guide_seq string", ("TTACGTACGTTT", "ACGTACGT"), ("TTACTTACGTTT", "ACGTACGT"))
    assert d.verify_guides(guides, 8, 0, 0).count() == 1


def test_generators(spark):
    s = sim.random_sequences(spark, 50, 12, 1, tail=3)
    got = [r.seq for r in s.collect()]
    assert all(len(x) == 12 and set(x) <= set("ACGT") and "T" not in x[9:] for x in got) and got == [r.seq for r in sim.random_sequences(spark, 50, 12, 1, 3).collect()]
    assert sim.edit_distance_sample(spark, 40, 9, 1).agg(F.sum("n")).first()[0] == 40
    f = frame(spark, "id string, a double", *[(f"t{i}", float(i)) for i in range(5)])
    assert sim.ideal_counts(f).agg(F.sum("tpm")).first()[0] == pytest.approx(1e6)
    assert rows(sim.read_counts(f, "a", 100), "id", "reads") == [("t0", 0), ("t1", 10), ("t2", 20), ("t3", 30), ("t4", 40)]
    assert sim.gamma_counts(f, "id", 1).filter("count >= 0").count() == 5
    t = frame(spark, f"transcript_id string, chr string, strand string, exons {EX}", *[(f"t{i}", "1", "+-"[i % 2], [(1000, 1500), (3000, 3600)]) for i in range(20)])
    for r in sim.perturb_ends(t, 1, 1.0).collect():
        assert (r.exons[0].start, r.exons[1].end) != (1000, 3600) and all(e.start < e.end for e in r.exons)
        assert (r.exons[1].end == 3600) == (r.strand == "-")
    assert sim.cage_peaks(t, 1, 0.0).count() == 20
    reads = frame(spark, "read_id string, seq string, same_strand boolean, umi string", ("r", "A" * 100 + "C" * 100, True, "GG"))
    assert set(sim.truncate_reads(reads, 1, 50, 5).first().seq) == {"C"}
    assert rows(sim.fake_umis(reads, 3, 1, 2).filter("copy = 0"), "umi") == [("GG",)] and sim.fake_umis(reads, 3, 1).count() == 4
    assert sim.guide_reference(frame(spark, "id string, seq string", ("g", "AC")), "TT", "GG").count() == 3


def test_matrices(spark):
    c = frame(spark, "f string, s string, n long", *[(f"g{i}", s, (i + 1) * k) for i in range(5) for s, k in (("a", 1), ("b", 4))])
    factors = dict(rows(d.size_factors(c, "f", "s", "n"), "s", "size_factor"))
    assert factors["a"] == pytest.approx(0.5) and factors["b"] == pytest.approx(2)
    by = {(r.f, r.s): r.normalised for r in d.normalised_counts(c, "f", "s", "n").collect()}
    assert by["g2", "a"] == pytest.approx(by["g2", "b"])
    b = frame(spark, "f string, b string, v double", ("g", "x", 1.0), ("g", "x", 3.0), ("g", "y", 10.0))
    assert [r[0] for r in rows(d.centre_batches(b, "f", "b", "v"), "v")] == [5.0, 6.0, 7.0]
    p = d.pair_dispersion(c, frame(spark, "f string", ("g0",), ("g1",), ("g2",)), "f", "s", "n").first()
    assert (p.sample_a, p.genes) == ("a", 3) and p.dispersion == pytest.approx(0)
    places = frame(spark, "chr string, start long, end long", ("1", 5, 9), ("2", 1, 2))
    one = frame(spark, "chr string, start long, end long, include long", ("1", 5, 9, 3), ("1", 5, 9, 4))
    assert rows(d.counts_by_chromosome([one, one.limit(0)], places, ["a", "b"]), "chr", "a", "b") == [("1", 7, 0), ("2", 0, 0)]


def test_legacy_assignment(spark):
    iso = frame(spark, "gene_id string, transcript_id string, profile array<int>, is_coding boolean", ("g", "t1", [1, -1], True), ("g", "t2", [1, 1], True), ("g", "t3", [-1, 1], False))
    reads = frame(spark, "read_id string, gene_id string, profile array<int>", ("a", "g", [1, 0]), ("b", "g", [1, 1]), ("c", "g", [-1, -1]))
    got = d.assign_by_junctions(reads, iso)
    assert rows(got, "read_id", "assignment_type") == [("a", "ambiguous"), ("b", "unique"), ("c", "contradictory")]
    again = d.resolve_ambiguous(got.join(reads, ["read_id", "gene_id"]).filter("read_id = 'a'"), iso).first()
    assert again.isoforms == ["t1"]
    pairs = frame(spark, "seq1 string, seq2 string", ("ACGT", "TTACGTTT"))
    assert d.exon_similarity(pairs).first().similarity == 1.0
    codons = frame(spark, "gene_id string, transcript_id string, start_codon long, stop_codon long", ("g", "t1", 1, 9), ("g", "t2", 1, 12))
    assert d.ideal_isoforms(iso, codons).count() == 0  # two pairs, but one start only
    codons = frame(spark, "gene_id string, transcript_id string, start_codon long, stop_codon long", ("g", "t1", 1, 9), ("g", "t2", 4, 12))
    assert d.ideal_isoforms(iso, codons).count() == 2
    s = d.read_summary(frame(spark, "gene_id string, sample string", ("g", "x"), ("g", "x"), ("h", "x")), frame(spark, "gene_id string, bin int, spliced boolean", ("g", 1, True)), ["x", "y"])
    assert rows(s.na.fill(0), "gene_id", "y") == [("g", 0.0), ("h", 0.0)]
