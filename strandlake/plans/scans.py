"""Queries over readers and writers: the tables are written in each format and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import interval as iv
from strandlake.functions import sequence as sq
from strandlake.operators import aggregate, domain, pipelines, simulate
from strandlake.plans.catalog import query, table
from strandlake.plans.sequences import BASES, bases
from strandlake.sources import readers, writers
from strandlake.sources.scratch import shared_dir

#: Exons n of transcripts t of genes g, apart from each other and in order.
EXONS = """ex as (select l_orderkey as t, l_orderkey // 8 as g, l_linenumber::bigint as n, l_linenumber * 100 + min(l_partkey) % 30 as s,
l_linenumber * 100 + min(l_partkey) % 30 + max(l_quantity)::bigint as e, case when (l_orderkey // 8) % 2 = 0 then '+' else '-' end as strand from lineitem group by l_orderkey, l_linenumber)"""


def exons(spark, sf) -> DataFrame:
    """EXONS."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_partkey").alias("p"), F.max("l_quantity").cast("long").alias("q"))
    start = F.col("n") * 100 + F.col("p") % 30
    gene = F.floor(F.col("t") / 8)
    return rows.select("t", gene.alias("g"), "n", start.alias("s"), (start + F.col("q")).alias("e"), F.when(gene % 2 == 0, "+").otherwise("-").alias("strand"))


def transcripts(spark, sf) -> DataFrame:
    """gene_id, transcript_id, chr, strand and sorted exons."""
    lists = exons(spark, sf).groupBy("g", "t", "strand").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("exons"))
    return lists.select(F.concat(F.lit("g"), "g").alias("gene_id"), F.concat(F.lit("t"), "t").alias("transcript_id"), F.concat(F.lit("chr"), F.col("g") % 3).alias("chr"), "strand", "exons", "g", "t")


def features(spark, sf) -> DataFrame:
    """Genes, transcripts and exons as annotation lines."""
    t = transcripts(spark, sf)
    span = iv.span(F.col("exons"))
    rows = t.select("chr", F.lit("exon").alias("feature"), F.inline("exons"), "strand", "gene_id", "transcript_id")
    rows = rows.unionByName(t.select("chr", F.lit("transcript").alias("feature"), span["start"].alias("start"), span["end"].alias("end"), "strand", "gene_id", "transcript_id"))
    genes = t.groupBy("chr", "strand", "gene_id").agg(F.min(span["start"]).alias("start"), F.max(span["end"]).alias("end"))
    rows = rows.unionByName(genes.select("chr", F.lit("gene").alias("feature"), "start", "end", "strand", "gene_id", F.lit(None).cast("string").alias("transcript_id")))
    attributes = F.concat(F.lit('gene_id "'), "gene_id", F.lit('";'), F.coalesce(F.concat(F.lit(' transcript_id "'), "transcript_id", F.lit('";')), F.lit("")), F.lit(' gene_name "N'), F.substring("gene_id", 2, 20), F.lit('";'))
    return rows.select("chr", F.lit("model").alias("source"), "feature", "start", "end", F.lit(".").alias("score"), "strand", F.lit(".").alias("frame"), attributes.alias("attributes"), "gene_id", "transcript_id")


def put(rows: DataFrame, name: str, *, one: bool = False) -> str:
    """Write the text column value and return the folder; one: as a single file, by the column at."""
    path = shared_dir(rows.sparkSession, name)
    rows = rows.repartition(1).sortWithinPartitions("at").select("value") if one else rows.select("value")
    rows.write.text(path)
    return path


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("value")


@query(f"select 'p' || p_partkey as id, s as seq, length(s)::int as length from (select p_partkey, {BASES} as s from part)")
def scan_fasta(spark, sf):
    """Sequences over several lines."""
    reads = bases(spark, sf).select(F.concat(F.lit("p"), "p_partkey").alias("read_id"), F.regexp_replace("seq", "(.{5})", "$1\n").alias("seq"))
    return readers.read_fasta(spark, put(writers.fasta_lines(reads), "fasta")).select("id", "seq", F.length("seq").alias("length"))


@query(f"select 'p' || p_partkey as id, length(s)::int as length from (select p_partkey, {BASES} as s from part)")
def scan_sequence_lengths(spark, sf):
    """S46, S45."""
    reads = bases(spark, sf).select(F.concat(F.lit("p"), "p_partkey").alias("read_id"), "seq")
    return readers.sequence_lengths(spark, put(writers.fasta_lines(reads), "fasta"))


@query(f"select length(s)::int as length, count(*) as n from (select {BASES} as s from part) group by 1")
def scan_read_lengths(spark, sf):
    """Lengths of a file's reads, counted."""
    reads = bases(spark, sf).select(F.concat(F.lit("p"), "p_partkey").alias("read_id"), "seq")
    return readers.read_lengths(readers.read_fasta(spark, put(writers.fasta_lines(reads), "fasta"))).groupBy("length").agg(F.count("*").alias("n"))


@query("""select 'c' || c_custkey as read_id, translate(lower(c_mktsegment), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as seq, repeat(chr((33 + c_custkey % 40)::int), length(c_mktsegment)) as qual, (c_custkey % 40)::double as phred from customer""")
def scan_fastq(spark, sf):
    """Qualities that begin with '@' included."""
    c = table(spark, sf, "customer")
    seq = F.translate(F.lower("c_mktsegment"), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    reads = c.select(F.concat(F.lit("c"), "c_custkey").alias("read_id"), seq.alias("seq"), F.repeat(F.char(33 + F.col("c_custkey") % 40), F.length("c_mktsegment")).alias("qual"))
    return readers.read_fastq(spark, put(writers.fastq_lines(reads), "fastq")).select("read_id", "seq", "qual", sq.mean_phred("qual").cast("double").alias("phred"))


FLAG, CIGAR = "[0, 16, 256, 2048, 4][(o_orderkey % 5 + 1)::int]", "['5S20M', '10M100N15M', '8M2D7M3I5M'][(o_orderkey % 3 + 1)::int]"


def alignments(spark, sf) -> DataFrame:
    """Reads of orders, written as SAM and read."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))
    o = F.col("o_orderkey")
    line = tabbed(F.concat(F.lit("r"), o), pick([0, 16, 256, 2048, 4], o % 5), F.concat(F.lit("chr"), F.col("o_custkey") % 3), F.col("o_custkey") + 1, F.lit(60), pick(["5S20M", "10M100N15M", "8M2D7M3I5M"], o % 3), F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.concat(F.lit("CB:Z:B"), F.col("o_custkey") % 7))
    return readers.read_sam(spark, put(table(spark, sf, "orders").select(line), "sam"))


@query(f"""with a as (select o_orderkey, {FLAG} as flag, {CIGAR} as cigar, o_custkey from orders) select 'r' || o_orderkey as read_id, flag in (0, 16) as is_primary, cigar like '%N%' as spliced, o_custkey as start,
case when cigar like '%N%' then 2 else 1 end::int as n_blocks, case cigar when '5S20M' then 20 when '10M100N15M' then 25 else 22 end::bigint as aligned, 'B' || o_custkey % 7 as cb from a""")
def scan_sam(spark, sf):
    """S7, S42, F4, F5, X24."""
    a = alignments(spark, sf)
    return a.select("read_id", iv.is_primary(F.col("flag")).alias("is_primary"), iv.is_spliced(F.col("cigar")).alias("spliced"), "start", F.size("blocks").alias("n_blocks"), iv.total_length(F.col("blocks")).alias("aligned"), F.col("tags")["CB"].alias("cb"))


@query(f"""with a as (select o_orderkey, {CIGAR} as cigar, o_custkey from orders) select 'r' || o_orderkey as read_id from a where o_custkey % 3 = 1 and o_custkey < 400 and o_custkey + case cigar when '5S20M' then 20 when '10M100N15M' then 125 else 22 end >= 100""")
def scan_sam_region(spark, sf):
    """S8."""
    return readers.region(alignments(spark, sf), "chr1", 100, 400).select("read_id")


@query(f"""with a as (select o_orderkey, {FLAG} as flag, {CIGAR} as cigar from orders) select 'r' || o_orderkey as read_id from a where flag in (0, 16) and cigar = '10M100N15M' and o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)""")
def filter_alignments(spark, sf):
    """primary, spliced, long enough and listed."""
    ids = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("r"), "l_orderkey").alias("read_id"))
    return domain.filter_reads(alignments(spark, sf), ids, True, 25).select("read_id")


@query(f"""with a as (select o_orderkey, {FLAG} as flag, {CIGAR} as cigar, o_custkey from orders) select 'r' || o_orderkey as read_id, 'ACGT' || o_custkey || '-1' as cb, repeat('I', length('ACGT' || o_custkey)) as cy, 'U' || o_orderkey % 9 as ub, case when cigar like '%N%' then '1' else '0' end as sp from a where o_orderkey % 2 = 0""")
def tag_alignments(spark, sf):
    """Barcode tags replaced by those of the calls."""
    calls = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.concat(F.lit("r"), "o_orderkey").alias("read_id"), F.concat(F.lit("ACGT"), "o_custkey").alias("barcode"), F.concat(F.lit("U"), F.col("o_orderkey") % 9).alias("umi"))
    t = F.col("tags")
    return writers.tag_reads(alignments(spark, sf), calls).select("read_id", t["CB"].alias("cb"), t["CY"].alias("cy"), t["UB"].alias("ub"), t["SP"].alias("sp"))


@query("""with a as (select 'chr' || o_custkey % 3 as chr, o_custkey + 1 as pos, (5 + o_orderkey % 4)::bigint as m from orders),
b as (select chr, pos + i as pos, substr('ACGTTACGTTACGTTACGTT', i::int + 1, 1) as base from a, range(0, 8) t(i) where i < m union all select chr, pos + m + 3 + i, substr('ACGTTACGTTACGTTACGTT', (m + i)::int + 1, 1) from a, range(0, 6) t(i))
select chr, pos, count(*) filter (base = 'A') as "A", count(*) filter (base = 'C') as "C", count(*) filter (base = 'G') as "G", count(*) filter (base = 'T') as "T" from b group by 1, 2""")
def scan_pileup(spark, sf):
    """Bases by place, deletions left out."""
    m = 5 + F.col("o_orderkey") % 4
    o = table(spark, sf, "orders").select(F.concat(F.lit("chr"), F.col("o_custkey") % 3).alias("chr"), F.col("o_custkey").alias("start"), F.concat(m, F.lit("M3D6M")).alias("cigar"), F.substring(F.repeat(F.lit("ACGTT"), F.lit(4)), F.lit(1), (m + 6).cast("int")).alias("seq"))
    return readers.pileup(o)


CALLS = "with c as (select event_id as i, case when event_id % 4 = 0 then '*' else 'B' || user_id end as barcode, 'U' || event_id % 10 as umi, (event_id % 17)::int as score, event_id % 3 = 0 as ok from events)"


def calls(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf, "events").select(F.concat(F.lit("e"), i).alias("read_id"), F.when(i % 4 == 0, "*").otherwise(F.concat(F.lit("B"), "user_id")).alias("barcode"), F.concat(F.lit("U"), i % 10).alias("umi"), (i % 17).cast("int").alias("bc_score"), (i % 3 == 0).alias("valid_umi"), F.lit("+").alias("strand"))


@query(CALLS + " select 'e' || i as read_id, barcode, umi, score as bc_score, ok as valid_umi from c where barcode <> '*'")
def scan_calls(spark, sf):
    """Ids with a leading '@'."""
    path = shared_dir(spark, "calls")
    writers.write_tsv(calls(spark, sf).withColumn("read_id", F.concat(F.lit("@"), "read_id")), path, header=False)
    return readers.read_calls(spark, path).select("read_id", "barcode", "umi", "bc_score", "valid_umi")


@query(CALLS + " select 'e' || i as read_id, barcode, umi, score as bc_score, ok as umi_good, (i % 100)::int as polyt from c where barcode <> '*'")
def scan_legacy_calls(spark, sf):
    """K1b."""
    path = shared_dir(spark, "calls")
    c = calls(spark, sf)
    c.select("read_id", (F.substring("read_id", 2, 20).cast("long") % 100).cast("int").alias("polyt"), *[F.lit(-1).alias(x) for x in ("primer", "linker_start", "linker_end")], "strand", "barcode", "umi", "bc_score", "valid_umi").write.csv(path, sep="\t")
    return readers.read_calls(spark, path, legacy=True).select("read_id", "barcode", "umi", "bc_score", "umi_good", "polyt")


@query(CALLS + " select 'e' || i as read_id from c where barcode <> '*' and score >= 9 and ok and barcode in (select 'B' || c_custkey from customer where c_custkey % 2 = 0)")
def filter_barcode_calls(spark, sf):
    """F1."""
    white = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("B"), "c_custkey").alias("barcode"))
    from strandlake.operators import relational

    return relational.filter_calls(calls(spark, sf), 9, True, white).select("read_id")


KIND = "case when t % 3 = 0 then 'unique' when t % 3 = 1 then 'unique_minor_difference' else 'ambiguous' end"
EVENTS = "case when t % 2 = 0 then 'tss_match,correct_polya_site' else 'alt_donor_site:100-200' end"


def assignments(spark, sf) -> DataFrame:
    """One read for each transcript, as a table of assignments."""
    t = F.col("t")
    kind = F.when(t % 3 == 0, "unique").when(t % 3 == 1, "unique_minor_difference").otherwise("ambiguous")
    events = F.when(t % 2 == 0, "tss_match,correct_polya_site").otherwise("alt_donor_site:100-200")
    text = F.array_join(F.transform("exons", lambda e: F.concat_ws("-", e["start"], e["end"])), ",")
    return transcripts(spark, sf).select(F.concat(F.lit("r"), t).alias("read_id"), "chr", "strand", F.col("transcript_id").alias("isoform_id"), "gene_id", kind.alias("assignment_type"), events.alias("events"), text.alias("exons"), F.concat(F.lit("PolyA="), F.when(t % 4 < 2, "True").otherwise("False")).alias("attributes"), "t")


@query(f"with {EXONS} select 'r' || t as read_id, {KIND} as assignment_type, count(*)::int as n_exons, sum(e - s + 1)::bigint as total from ex group by t")
def scan_assignments(spark, sf):
    """S11."""
    path = shared_dir(spark, "assignments")
    writers.write_tsv(assignments(spark, sf).drop("t"), path, header=False)
    return readers.read_assignments(spark, path).select("read_id", "assignment_type", F.size("exons").alias("n_exons"), iv.total_length(F.col("exons")).alias("total"))


@query(f"with {EXONS} select distinct 'r' || t as read_id from ex where t % 3 < 2 and t % 4 < 2")
def scan_unique_assignments(spark, sf):
    """S13."""
    path = shared_dir(spark, "assignments")
    writers.write_tsv(assignments(spark, sf).drop("t"), path, header=False)
    return readers.read_assignments(spark, path, unique_polya=True).select("read_id")


ALLINFO = f"""with {EXONS}, x as (select t, g, strand, list(struct_pack(s := s, e := e) order by s) as b, min(s) as lo, max(e) as hi, count(*) as n from ex group by t, g, strand)
select 'r' || t as read_id, 'g' || g as gene_id, case when t % 3 < 2 then 'known' else 'novel' end as read_type, (n - 1)::int as n_introns, array_to_string(list_transform(b, lambda v: ';%;chr' || g % 3 || '_' || v.s || '_' || v.e || '_' || strand), '') as exons,
case when t % 2 = 0 then 'chr' || g % 3 || '_' || case when strand = '-' then hi else lo end || '_' || case when strand = '-' then hi else lo end || '_' || strand else 'NoTSS' end as tss,
case when t % 2 = 0 then 'chr' || g % 3 || '_' || case when strand = '-' then lo else hi end || '_' || case when strand = '-' then lo else hi end || '_' || strand else 'NoPolyA' end as polya from x"""


def allinfo(spark, sf) -> DataFrame:
    a = assignments(spark, sf).withColumns({"exons": iv.parse_blocks(F.col("exons")), "barcode": F.concat(F.lit("B"), F.col("t") % 5), "umi": F.concat(F.lit("U"), F.col("t") % 11)})
    return pipelines.to_allinfo(a)


@query(ALLINFO)
def allinfo_table(spark, sf):
    """G15, F26."""
    return allinfo(spark, sf).select("read_id", "gene_id", "read_type", "n_introns", "exons", "tss", "polya")


@query(f"""with {EXONS} select 'r' || t as read_id, (count(*) - 1)::int as n_introns, sum(e - s + 1)::bigint as exonic, (max(e) - min(s) + 1 - sum(e - s + 1))::bigint as intronic from ex group by t""")
def scan_allinfo(spark, sf):
    """A read's first line gives way to its last."""
    rows = allinfo(spark, sf)
    line = tabbed(*rows.columns)
    stale = tabbed("read_id", *[F.lit("x")] * 9, F.lit(0))
    lines = rows.select(F.concat(stale, F.lit("\n"), line).alias("value"))
    back = readers.read_allinfo(spark, put(lines, "allinfo"))
    return back.select("read_id", "n_introns", iv.total_length(F.col("exons")).alias("exonic"), iv.total_length(F.col("introns")).alias("intronic"))


@query("""select (s_suppkey % 4)::varchar as chr, s_suppkey * 10 as pos, 'A' as ref, 'G' as alt, sample, case when sample = 'one' then s_suppkey % 7 else 0 end::bigint as ref_reads, case when sample = 'one' then s_nationkey else 0 end::bigint as alt_reads from supplier, (select unnest(['one', 'two']) as sample) where s_suppkey % 5 <> 0""")
def scan_vcf(spark, sf):
    """Reads from AD, where it is and where it is not; insertions left out."""
    k = F.col("s_suppkey")
    alt = F.when(k % 5 == 0, "GTT").otherwise("G")
    line = tabbed(F.concat(F.lit("chr"), k % 4), k * 10, F.lit("."), F.lit("A"), alt, F.lit(60), F.lit("PASS"), F.lit("."), F.lit("GT:AD:DP"), F.concat(F.lit("0/1:"), k % 7, F.lit(","), "s_nationkey", F.lit(":99")), F.lit("./.:.:."))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("##fileformat\n#CHROM\n"), line).alias("value"))
    return readers.read_vcf(spark, put(rows, "vcf"), ["one", "two"]).select("chr", "pos", "ref", "alt", "sample", "ref_reads", "alt_reads")


@query("""select 'chr' || s_suppkey % 4 as chr, s_suppkey * 10 as pos, sample, case when sample = 'one' then s_suppkey % 7 else 0 end::bigint as ref_reads, case when sample = 'one' then s_nationkey else 3 end::bigint as alt_reads from supplier, (select unnest(['one', 'two']) as sample)""")
def scan_varscan(spark, sf):
    """S15: '-' is no reads."""
    k = F.col("s_suppkey")
    line = tabbed(F.concat(F.lit("chr"), k % 4), k * 10, F.lit("A"), F.lit("G"), *[F.lit("x")] * 6, F.concat(F.lit("R:20:"), k % 7, F.lit(":"), "s_nationkey", F.lit(":1%")), F.lit("A:9:-:3:-"))
    return readers.read_varscan(spark, put(table(spark, sf, "supplier").select(line), "varscan"), ["one", "two"]).select("chr", "pos", "sample", "ref_reads", "alt_reads")


@query(f"""with {EXONS} select 'g' || g as gene_id, 't' || t as transcript_id, strand, count(*)::int as n_exons, min(s) as start, max(e) as "end" from ex group by g, t, strand""")
def scan_gtf(spark, sf):
    """Annotation written in order, read, and its hierarchy put together."""
    got = readers.read_gtf(spark, put(writers.gtf_lines(features(spark, sf)), "gtf"))
    span = iv.span(F.col("exons"))
    return readers.transcripts(got).select("gene_id", "transcript_id", "strand", F.size("exons").alias("n_exons"), span["start"].alias("start"), span["end"].alias("end"))


@query(f"with {EXONS} select distinct 't' || t as transcript_id, 'g' || g as gene_id from ex")
def scan_transcript_genes(spark, sf):
    """S20, S21, S44."""
    return readers.transcript_genes(readers.read_gtf(spark, put(writers.gtf_lines(features(spark, sf)), "gtf")))


@query(f"""with {EXONS} select 'chr' || g % 3 as chr, min(s) - 1 as start, max(e) as "end", 'N' || g as name, '0' as score, strand from ex group by g, strand""")
def genes_as_bed(spark, sf):
    """K16."""
    return writers.bed6(readers.read_gtf(spark, put(writers.gtf_lines(features(spark, sf)), "gtf")))


@query("""with f as (select o_orderkey as i, case when o_orderkey % 7 = 0 then null else 'g' || o_custkey % 50 end as gene, case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then 'g' || o_custkey % 50 else 't' || o_custkey % 100 end as tr from orders),
k as (select i, gene, case when tr = gene then tr || '.t' else tr end as tr, tr as raw from f where gene is not null and tr is not null), n as (select *, row_number() over (partition by raw order by i) as n from k) select i as start, gene as gene_id, case when n > 1 then tr || '.' || n else tr end as transcript_id from n""")
def gtf_repair(spark, sf):
    """S23."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    gene = F.concat(F.lit("g"), c % 50)
    rows = table(spark, sf, "orders").select(F.lit("transcript").alias("feature"), F.lit("chr1").alias("chr"), o.alias("start"), (o + 10).alias("end"), F.lit("").alias("attributes"), F.when(o % 7 != 0, gene).alias("gene_id"), F.when(o % 11 == 0, None).when(o % 13 == 0, gene).otherwise(F.concat(F.lit("t"), c % 100)).alias("transcript_id"))
    return readers.repair_gtf(rows).select("start", "gene_id", "transcript_id")


@query("""select 'S' || l_suppkey as feature_id, 'N' || l_suppkey as feature_name, 'cell' || l_partkey % 25 as barcode, count(*)::double as count from lineitem group by 1, 2, 3""")
def scan_mex(spark, sf):
    """A sparse matrix in three files."""
    folder = shared_dir(spark, "mex")
    one = lambda rows, name: rows.repartition(1).sortWithinPartitions("at").select("value").write.text(f"{folder}/{name}")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("at"), F.concat(F.lit("S"), "s_suppkey", F.lit("\tN"), "s_suppkey").alias("value"))
    one(s, "features.tsv")
    one(spark.range(25).select(F.col("id").alias("at"), F.concat(F.lit("cell"), "id").alias("value")), "barcodes.tsv")
    cells = table(spark, sf, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 25).alias("b")).agg(F.count("*").alias("n"))
    head = cells.agg(F.lit(-1).cast("long").alias("at"), F.concat(F.lit("%%MatrixMarket matrix coordinate integer general\n%\n"), F.lit(s.count()), F.lit(" 25 "), F.count("*")).alias("value"))
    one(head.unionByName(cells.select((F.col("l_suppkey") * 25 + F.col("b")).alias("at"), F.concat_ws(" ", F.col("l_suppkey") + 1, F.col("b") + 1, "n").alias("value"))), "matrix.mtx")
    return readers.read_mex(spark, folder)


@query("select r_regionkey % 2 as part, n_name, n_nationkey from nation join region on n_regionkey = r_regionkey")
def scan_many_tables(spark, sf):
    """Two headerless tables as one, with the file of each row."""
    n = table(spark, sf, "nation").select("n_name", "n_nationkey", (F.col("n_regionkey") % 2).alias("part"))
    folder = shared_dir(spark, "tables")
    for p in (0, 1):
        n.filter(F.col("part") == p).drop("part").write.csv(f"{folder}/part{p}", sep="\t")
    rows = domain.concat_tables(spark, [f"{folder}/part0", f"{folder}/part1"], "n_name string, n_nationkey int")
    return rows.select(F.regexp_extract("file", r"/part(\d)/", 1).cast("int").alias("part"), "n_name", "n_nationkey")


@query("select least(count(*), 1000)::bigint as n from orders")
def scan_first_rows(spark, sf):
    """S43, T7."""
    return domain.first_rows(table(spark, sf, "orders"), 1000).agg(F.count("*").alias("n"))


@query("select (select count(*) from orders)::varchar as reads, (select max(s_suppkey) from supplier)::varchar as barcodes, null::varchar as missing")
def scan_log(spark, sf):
    """S29, S30, S32."""
    lines = table(spark, sf, "orders").agg(F.concat(F.lit("INFO start\nTotal reads: "), F.count("*")).alias("value"))
    lines = lines.unionByName(table(spark, sf, "supplier").agg(F.concat(F.lit("barcodes\t"), F.max("s_suppkey"), F.lit(" found")).alias("value")))
    return readers.read_log(spark, put(lines, "log"), {"reads": r"Total reads: (\d+)", "barcodes": r"^barcodes\t(\d+)", "missing": r"nothing (\d+)"})


@query("select (count(*) * 2)::bigint as lines from customer")
def scan_line_count(spark, sf):
    """S31."""
    path = put(table(spark, sf, "customer").select(F.concat("c_name", F.lit("\nx")).alias("value")), "lines")
    return spark.range(1).select(F.lit(readers.line_count(spark, path)).cast("long").alias("lines"))


@query("""select ['=', 'j', 'k', 'x', 'u'][(o_orderkey % 5 + 1)::int] as class_code, 'T' || o_custkey as ref_id, 'q' || o_orderkey as query_id, case o_orderkey % 5 when 0 then 'known' when 1 then 'novel' when 2 then 'novel' else 'undefined' end as kind from orders""")
def scan_tracking(spark, sf):
    """Matches by class code, known, novel or undefined."""
    o = F.col("o_orderkey")
    code = F.element_at(F.array(*[F.lit(x) for x in "=jkxu"]), (o % 5 + 1).cast("int"))
    line = tabbed(F.concat(F.lit("TC_"), o), F.lit("XL"), F.concat(F.lit("G|T"), "o_custkey"), code, F.concat(F.lit("q1:g|q"), o, F.lit("|3|0")))
    return pipelines.classify_codes(readers.read_tracking(spark, put(table(spark, sf, "orders").select(line), "tracking")))


@query("""with r as (select s_suppkey as pos, ['AG', 'TC', '-'][(s_suppkey % 3 + 1)::int] as subs, case when s_suppkey % 2 = 0 then 'AG' else '-' end as g_subs, s_nationkey::double as g_cov, (s_suppkey % 10) / 10.0 as f, (s_suppkey % 4) / 10.0 as gf from supplier)
select pos, subs, case when subs = 'TC' then '-' else '+' end as strand, f as frequency from r where g_cov >= 5 and (subs <> g_subs or f > gf)""")
def scan_edited_positions(spark, sf):
    """Positions where RNA differs from DNA."""
    k = F.col("s_suppkey")
    subs = F.element_at(F.array(F.lit("AG"), F.lit("TC"), F.lit("-")), (k % 3 + 1).cast("int"))
    line = tabbed(F.lit("chr1"), k, F.lit("A"), F.lit("+"), F.lit("n/a"), F.lit(30), F.lit("[]"), subs, (k % 10) / 10, F.col("s_nationkey"), F.lit(30), F.lit("[]"), F.when(k % 2 == 0, "AG").otherwise("-"), (k % 4) / 10)
    rows = readers.read_reditools(spark, put(table(spark, sf, "supplier").select(line), "sites"))
    return pipelines.edited_positions(rows, 5.0).select("pos", "subs", "strand", "frequency")


@query("""select 'g' || s_suppkey as gene, case when s_suppkey % 2 = 0 then '+' else '-' end as strand, (s_suppkey * 3)::bigint as first_start, 2::int as n_stops, s_nationkey::bigint as first_pair from supplier""")
def scan_codon_structures(spark, sf):
    """Four lines for each gene."""
    k = F.col("s_suppkey")
    value = F.concat(F.lit("chr1\tg"), k, F.lit("\t"), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("\n"), k * 3, F.lit("\t7\n"), k * 5, F.lit("\t9\n"), "s_nationkey", F.lit("\t1\t2"))
    path = put(table(spark, sf, "supplier").select(k.alias("at"), value.alias("value")), "codons", one=True)
    return readers.codon_structures(spark, path).select("gene", "strand", F.col("starts")[0].alias("first_start"), F.size("stops").alias("n_stops"), F.col("pairs")[0].alias("first_pair"))


@query("""select n_name as sample, n_name || '_1.fq' as reads1, case when n_nationkey % 2 = 0 then n_name || '_2.fq' end as reads2, case when n_nationkey % 2 = 0 then 'paired' else 'single' end as layout from nation""")
def scan_samplesheet(spark, sf):
    """S40."""
    two = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("\t"), "n_name", F.lit("_2.fq"))).otherwise("")
    return readers.read_samplesheet(spark, put(table(spark, sf, "nation").select(F.concat("n_name", F.lit("\t"), "n_name", F.lit("_1.fq"), two).alias("value")), "samples"))


@query("""select translate(substr(md5(o_orderkey::varchar), 1, 16), '0123456789abcdef', 'ACGTACGTACGTACGT') as barcode, 'U' || o_custkey as umi, 'READ_' || o_orderkey || '_T_B' || o_custkey as read_id, 'B' || o_custkey as truth from orders""")
def scan_blaze_ids(spark, sf):
    """Barcode, UMI and the simulator's truth from read names."""
    mer = F.translate(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 16), "0123456789abcdef", "ACGT" * 4)
    reads = table(spark, sf, "orders").select(F.concat(mer, F.lit("_U"), "o_custkey", F.lit("#READ_"), "o_orderkey", F.lit("_T_B"), "o_custkey").alias("read_id"), F.lit("ACGT").alias("seq"))
    return readers.blaze_ids(readers.read_fasta(spark, put(writers.fasta_lines(reads), "fasta")))


@query("select s_suppkey, unnest(list_concat(range(s_suppkey, s_suppkey + 3), [s_nationkey + 100]))::int as sample from supplier")
def sample_ranges(spark, sf):
    """S17."""
    text = F.concat("s_suppkey", F.lit("-"), F.col("s_suppkey") + 2, F.lit(","), F.col("s_nationkey") + 100)
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(sq.parse_ranges(text)).alias("sample"))


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_partkey)::bigint as parts from lineitem group by 1, 2 having count(*) >= 10")
def sink_by_key(spark, sf):
    """A folder for each key of enough rows, read back."""
    path = shared_dir(spark, "keys")
    writers.write_by_key(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey"), path, "l_returnflag", "l_linestatus", min_rows=10)
    return spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("select l_returnflag as grp, l_linenumber::int as bin, count(*) as n, round(count(*) / sum(count(*)) over (partition by l_returnflag), 9)::double as share from lineitem group by 1, 2")
def sink_histogram(spark, sf):
    """Counts raw and as shares of their group."""
    h = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("bin")).agg(F.count("*").alias("n"))
    return aggregate.share_by_group(h, "grp").withColumn("share", F.round("share", 9))


@query("select case when s_acctbal >= 0 then 'somatic' else 'germline' end as kind, count(*) as n, sum(s_suppkey)::bigint as keys from supplier group by 1")
def sink_split_tables(spark, sf):
    """A table for each kind and one of all, read back and added."""
    path = shared_dir(spark, "split")
    s = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, "somatic").otherwise("germline").alias("kind"))
    for k in ("somatic", "germline"):
        writers.write_tsv(s.filter(F.col("kind") == k), f"{path}/{k}")
    back = spark.read.csv([f"{path}/somatic", f"{path}/germline"], sep="\t", header=True)
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("s_suppkey").cast("long")).alias("keys"))


@query("""with c as (select l_partkey as pos, l_returnflag as f, count(*) as cov, count(*) filter (l_linestatus = 'O') as reads from lineitem group by 1, 2)
select pos, coalesce(sum(cov) filter (f = 'A'), 0)::bigint as "A_TOTAL", coalesce(sum(reads) filter (f = 'A'), 0)::bigint as "A_READS", coalesce(round(sum(reads) filter (f = 'A') / sum(cov) filter (f = 'A') + 1e-12, 2), 0)::double as "A_FREQ",
coalesce(sum(cov) filter (f = 'R'), 0)::bigint as "R_TOTAL", coalesce(sum(reads) filter (f = 'R'), 0)::bigint as "R_READS", coalesce(round(sum(reads) filter (f = 'R') / sum(cov) filter (f = 'R') + 1e-12, 2), 0)::double as "R_FREQ" from c group by pos""")
def sink_wide_samples(spark, sf):
    """Three columns for each sample."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("f")).agg(F.count("*").alias("cov"), F.count_if(F.col("l_linestatus") == "O").alias("reads"))
    return writers.wide_samples(c, ["pos"], "f", ["A", "R"])


@query(f"""with {EXONS}, x as (select t, g, strand, min(s) - 1 as lo, max(e) as hi, count(*) as n, string_agg((e - s + 1)::varchar, ',' order by s) as sizes, list(s order by s) as st from ex group by t, g, strand)
select 'chr' || g % 3 || chr(9) || lo || chr(9) || hi || chr(9) || 't' || t || chr(9) || '1000' || chr(9) || strand || chr(9) || lo || chr(9) || hi || chr(9) || '0,0,0' || chr(9) || n || chr(9) || sizes || chr(9) || array_to_string(list_transform(st, lambda v: v - 1 - lo), ',') as value from x""")
def sink_bed12(spark, sf):
    """K15."""
    return writers.bed12_lines(transcripts(spark, sf))


@query(f"""with {EXONS}, x as (select t, min(s) as lo, max(e) as hi, sum(e - s + 1)::bigint as exonic, count(*)::int as n from ex group by t) select 't' || t as transcript_id, n as n_exons, exonic, (hi - lo + 1 - exonic)::bigint as intronic from x""")
def bed12_to_exons(spark, sf):
    """BED12 lines, read and turned into exon chains."""
    f = F.split("value", "\t")
    rows = spark.read.text(put(writers.bed12_lines(transcripts(spark, sf)), "bed")).select(f[3].alias("transcript_id"), f[1].cast("long").alias("start"), f[10].alias("block_sizes"), f[11].alias("block_starts"))
    b = domain.bed12_exons(rows)
    return b.select("transcript_id", F.size("exons").alias("n_exons"), iv.total_length(F.col("exons")).alias("exonic"), iv.total_length(F.col("introns")).alias("intronic"))


def number(text: str) -> str:
    """SQL of operators.ordered.uniform() for the text 'seed|key|...'."""
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / 4503599627370496.0)"


@query(f"""select c_custkey as read_id, copy::int as copy, case when copy = 0 then 'own' else array_to_string(list_transform(range(1, 13), lambda i: substr('ACGT', floor({number("'5|' || c_custkey || '|' || copy || '|' || i")} * 4)::int + 1, 1)), '') end as umi from customer, range(0, 4) t(copy)""")
def fake_umis(spark, sf):
    """Each read's own UMI and three random ones."""
    return simulate.fake_umis(table(spark, sf, "customer").select(F.col("c_custkey").alias("read_id"), F.lit("own").alias("umi")), 3, 5)


@query(f"select c_custkey, floor({number("'9|' || c_custkey")} * 8)::int as rg from customer")
def read_groups(spark, sf):
    """K20."""
    return writers.read_groups(table(spark, sf, "customer").select("c_custkey"), 8, 9, "c_custkey")


@query("""with n as (select n_nationkey as k, ['MT', 'chrMT', '1', 'chr2', 'GL000.1'][(n_nationkey % 5 + 1)::int] as name, ['+', '-', '?'][(n_nationkey % 3 + 1)::int] as ts, case when n_nationkey % 2 = 0 then 16 else 0 end as flag from nation)
select k, ['chrM', 'chrM', 'chr1', 'chr2', 'GL000.1'][(k % 5 + 1)::int] as renamed, case when ts = '?' then '?' when flag = 0 then ts when ts = '+' then '-' else '+' end as xs from n""")
def rename_references(spark, sf):
    """Reference names and strand tags."""
    k = F.col("n_nationkey")
    name = F.element_at(F.array(*[F.lit(x) for x in ("MT", "chrMT", "1", "chr2", "GL000.1")]), (k % 5 + 1).cast("int"))
    ts = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("?")), (k % 3 + 1).cast("int"))
    return table(spark, sf, "nation").select(k.alias("k"), writers.rename_reference(name).alias("renamed"), writers.strand_tag(ts, F.when(k % 2 == 0, 16).otherwise(0)).alias("xs"))


@query("select p_partkey::varchar as key, p_size::bigint as value from part")
def sink_json(spark, sf):
    """A map in parts, read back."""
    parts = writers.json_map(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("k"), F.col("p_size").cast("long").alias("v")), "k", "v")
    return parts.select(F.explode(F.from_json("value", "map<string,bigint>")))
