"""Readers and writers over small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandlake.sources import readers, writers


def put(path, text, zipped=False):
    data = text.encode()
    path.write_bytes(gzip.compress(data) if zipped else data)
    return str(path)


def test_fasta_fastq(spark, tmp_path):
    p = put(tmp_path / "a.fa", ">s1 first one\nACG\nTT\n>s2\nGG\n>s3\n\n")
    assert [(r.id, r.description, r.seq) for r in readers.read_fasta(spark, p).orderBy("id").collect()] == [("s1", "s1 first one", "ACGTT"), ("s2", "s2", "GG"), ("s3", "s3", "")]
    for zipped in (False, True):
        q = put(tmp_path / f"a.fq{'.gz' if zipped else ''}", "@r1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n@r3\nAC\n", zipped)
        rows = readers.read_fastq(spark, q).orderBy("read_id").collect()
        assert [(r.read_id, r.seq, r.qual) for r in rows] == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]
    back = writers.fastq_lines(readers.read_fastq(spark, q)).orderBy("value").collect()
    assert back[0].value == "@r1\nACGT\n+\n@III"
    bad = put(tmp_path / "b.fq", "r1\nA\n+\nI\n")
    assert readers.read_fastq(spark, bad, "DROPMALFORMED").count() == 0
    with pytest.raises(Exception, match="malformed"):
        readers.read_fastq(spark, bad).collect()
    assert readers.detect_format("x.fastq.gz") == "fastq" and readers.detect_format("x.fa") == "fasta"
    with pytest.raises(ValueError):
        readers.detect_format("x.txt")


SAM = "@SQ\tSN:1\tLN:1000\nr1\t0\t1\t11\t60\t5M10N5M\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tCB:Z:AAA-1\tUB:Z:CC\nr2\t256\t1\t21\t0\t2S4M1D2M\t*\t0\t0\tTTACGTAC\t*\n"


def test_sam(spark, tmp_path):
    a = readers.read_sam(spark, put(tmp_path / "a.sam", SAM))
    rows = {r.read_id: r for r in a.collect()}
    assert [(b.start, b.end) for b in rows["r1"].blocks] == [(11, 15), (26, 30)] and rows["r1"].tags == {"CB": "AAA-1", "UB": "CC"}
    assert [(b.start, b.end) for b in rows["r2"].blocks] == [(21, 27)]
    assert {r.read_id for r in readers.region(a, "1", 28, 40).collect()} == {"r1"}
    pile = {r.pos: (r.A, r.C, r.G, r["T"]) for r in readers.pileup(a).collect()}
    assert pile[11] == (1, 0, 0, 0) and 25 not in pile and pile[26] == (1, 1, 0, 0)
    calls = spark.createDataFrame([("r1", "ACGT", "GG")], "read_id string, barcode string, umi string")
    (t,) = writers.tag_reads(a, calls).collect()
    assert t.tags["CB"] == "ACGT-1" and t.tags["UB"] == "GG" and t.tags["SP"] == "1"


def test_tables(spark, tmp_path):
    c = put(tmp_path / "c.tsv", "#read_id\tbarcode\n@r1\tACGT\tGG\t14\tTrue\t+\nr2\t*\t*\t-1\tFalse\t.\n")
    (r,) = readers.read_calls(spark, c).collect()
    assert (r.read_id, r.barcode, r.bc_score, r.valid_umi) == ("r1", "ACGT", 14, True)
    a = put(tmp_path / "a.tsv", "#x\nr1\t1\t+\tt\tg\tunique\tev\t1-5,9-12\tPolyA=True;\nr2\t1\t+\tt\tg\tambiguous\tev\t1-5\tPolyA=True;\n")
    (r,) = readers.read_assignments(spark, a, unique_polya=True).collect()
    assert [(e.start, e.end) for e in r.exons] == [(1, 5), (9, 12)]
    i = put(tmp_path / "i.tsv", "r1\tg\tNone\tB\tU\t;%;1_6_8_+\tNoTSS\tNoPolyA\t;%;1_1_5_+;%;1_9_12_+\tknown\t1\nr1\tg2\tNone\tB\tU\t\tNoTSS\tNoPolyA\t;%;1_1_5_+\tknown\t0\n")
    (r,) = readers.read_allinfo(spark, i).collect()
    assert r.gene_id == "g2" and r.introns == [] and r.exons[0].end == 5


GTF = '1\tx\tgene\t1\t50\t.\t+\t.\tgene_id "g"; gene_name "N";\n1\tx\ttranscript\t1\t50\t.\t+\t.\tgene_id "g"; transcript_id "t";\n1\tx\texon\t20\t30\t.\t+\t.\tgene_id "g"; transcript_id "t";\n1\tx\texon\t1\t10\t.\t+\t.\tgene_id "g"; transcript_id "t";\n'


def test_gtf(spark, tmp_path):
    f = readers.read_gtf(spark, put(tmp_path / "a.gtf", "#c\n" + GTF))
    assert [(r.transcript_id, r.gene_id) for r in readers.transcript_genes(f).collect()] == [("t", "g")]
    t = readers.transcripts(f)
    assert [(e.start, e.end) for e in t.collect()[0].exons] == [(1, 10), (20, 30)]
    assert writers.bed12_lines(t).collect()[0].value == "1\t0\t30\tt\t1000\t+\t0\t30\t0,0,0\t2\t10,11\t0,19"
    (b,) = writers.bed6(f).collect()
    assert (b.start, b.name, b.score) == (0, "N", "0")
    assert [r.value.split("\t")[2] for r in writers.gtf_lines(f).collect()] == ["gene", "transcript", "exon", "exon"]
    twice = readers.repair_gtf(f.unionByName(f.filter("feature = 'transcript'")))
    assert {r.transcript_id for r in twice.filter("feature = 'transcript'").collect()} == {"t", "t.2"}


def test_variants_and_matrices(spark, tmp_path):
    v = put(tmp_path / "a.vcf", "##x\n#CHROM\nchr1\t5\trs1\tA\tC\t.\t.\t.\tGT:AD:DP\t0/1:7,3:10\t./.\n1\t6\t.\tA\tCC\t.\t.\t.\tGT:AD\t0:1,1\t0:1,1\n")
    rows = sorted((r.sample, r.chr, r.ref_reads, r.alt_reads) for r in readers.read_vcf(spark, v, ["a", "b"]).collect())
    assert rows == [("a", "1", 7, 3), ("b", "1", 0, 0)]
    folder = tmp_path / "mex"
    folder.mkdir()
    put(folder / "matrix.mtx", "%%MatrixMarket\n%\n2 2 2\n1 2 5\n2 1 7\n")
    put(folder / "features.tsv", "g1\tN1\tx\ng2\tN2\tx\n")
    put(folder / "barcodes.tsv", "AA-1\nCC-1\n")
    assert {(r.feature_id, r.barcode, r["count"]) for r in readers.read_mex(spark, str(folder)).collect()} == {("g1", "CC-1", 5.0), ("g2", "AA-1", 7.0)}
    m = put(tmp_path / "m.tsv", "CHR\tPOS\tREF\tALT\tTYPE\ta.T\ta.R\ta.F\tb.T\tb.R\tb.F\n1\t5\tA\tC\tsomatic\t10\t3\t0.3\t0\t0\t0\n")
    long = readers.read_snp_matrix(spark, m, ["a", "b"])
    assert {(r["sample"], r.cov, r.reads) for r in long.collect()} == {("a", 10, 3), ("b", 0, 0)}
    wide = writers.wide_samples(long, ["CHR", "POS"], "sample", ["a", "b"]).collect()[0]
    assert (wide.a_FREQ, wide.b_FREQ) == (0.3, 0.0)


def test_small_readers(spark, tmp_path):
    log = put(tmp_path / "x.log", "start\nTotal reads: 17\nAssigned 5 of them\n")
    (r,) = readers.read_log(spark, log, {"total": r"Total reads: (\d+)", "assigned": r"Assigned (\d+)", "none": r"zzz(\d)"}).collect()
    assert (r.total, r.assigned, r.none) == ("17", "5", None)
    s = put(tmp_path / "s.tsv", "a\tx.fq\nb\ty1.fq\ty2.fq\n\n")
    assert {(r["sample"], r.layout) for r in readers.read_samplesheet(spark, s).collect()} == {("a", "single"), ("b", "paired")}
    j = spark.createDataFrame([('{"data":[{"id":"g","homologies":[{"type":"p","source":{"id":"g"},"target":{"id":"h","perc_id":3.5}}]}]}',)], "j string")
    (r,) = readers.parse_homologies(j, "j").collect()
    assert (r.type, r.target_id, r.species, r.perc_id) == ("p", "h", "", 3.5)
    c = put(tmp_path / "c.txt", "1\tG\t+\n1\t5\n9\t12\n1\t9\n")
    (r,) = readers.codon_structures(spark, c).collect()
    assert (r.gene, r.starts, r.stops, r.pairs) == ("G", [1, 5], [9, 12], [1, 9])
    names = spark.createDataFrame([("MT",), ("1",), ("GL0.1",), ("chr2",)], "n string").select(writers.rename_reference(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["chrM", "chr1", "GL0.1", "chr2"]
    writers.write_by_key(spark.range(10).withColumn("k", F.when(F.col("id") < 8, "a").otherwise("b")), str(tmp_path / "out"), "k", min_rows=5)
    assert {r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a"}


def test_fastq_in_many_splits(spark, tmp_path):
    want = {f"r{i}": ("ACGT" * (1 + i % 7), "@+I!" * (1 + i % 7)) for i in range(1500)}
    text = "".join(f"@{k}\n{s}\n+\n{q}\n" for k, (s, q) in want.items())
    p = put(tmp_path / "big.fq", text)
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        reads = readers.read_fastq(spark, p)
        assert spark.read.text(p).rdd.getNumPartitions() > 5
        assert {r.read_id: (r.seq, r.qual) for r in reads.collect()} == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
