"""Further queries: BAM, remaining filters, lookups, comparisons and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import align
from strandlake.functions import interval as iv
from strandlake.functions import sequence as sq
from strandlake.operators import aggregate, domain, ordered, pipelines, relational, simulate
from strandlake.plans.catalog import QUERIES, query, table
from strandlake.plans.genomics import MD5_BASES, SIMULATED
from strandlake.plans.scans import EXONS, alignments, calls, exons, put, tabbed, transcripts
from strandlake.plans.sequences import BASES, bases
from strandlake.sources import bam, readers, writers
from strandlake.sources.scratch import shared_dir


def as_bam(spark, rows):
    """Alignments written as BAM and read in small splits."""
    folder = shared_dir(spark, "bam")
    bam.write_bam(rows.repartition(3, "read_id"), folder, [(f"chr{i}", 1_000_000_000) for i in range(3)])
    return bam.read_bam(spark, folder, split_bytes=20_000)


@query(QUERIES["scan_sam"].sql)
def scan_bam(spark, sf):
    """Written, read in splits."""
    a = as_bam(spark, alignments(spark, sf))
    return a.select("read_id", iv.is_primary(F.col("flag")).alias("is_primary"), iv.is_spliced(F.col("cigar")).alias("spliced"), "start", F.size("blocks").alias("n_blocks"), iv.total_length(F.col("blocks")).alias("aligned"), F.col("tags")["CB"].alias("cb"))


@query(QUERIES["scan_sam_region"].sql)
def scan_bam_region(spark, sf):
    """S8."""
    return readers.region(as_bam(spark, alignments(spark, sf)), "chr1", 100, 400).select("read_id")


@query(QUERIES["scan_pileup"].sql)
def scan_bam_pileup(spark, sf):
    """Sequences and CIGARs through BAM, then bases by place."""
    m = 5 + F.col("o_orderkey") % 4
    none = F.lit(None).cast("string")
    o = table(spark, sf, "orders").select(F.concat(F.lit("r"), "o_orderkey").alias("read_id"), F.lit(0).alias("flag"), F.concat(F.lit("chr"), F.col("o_custkey") % 3).alias("chr"), F.col("o_custkey").alias("start"), F.lit(60).alias("mapq"), F.concat(m, F.lit("M3D6M")).alias("cigar"), F.substring(F.repeat(F.lit("ACGTT"), F.lit(4)), F.lit(1), (m + 6).cast("int")).alias("seq"), none.alias("qual"), F.create_map().cast("map<string,string>").alias("tags"))
    return readers.pileup(as_bam(spark, o))


@query("select name, kind from (values ('a.fq.gz', 'fastq'), ('b.fasta', 'fasta'), ('c.sam', 'sam'), ('d.bam', 'bam'), ('e.txt', 'unknown')) t(name, kind)")
def formats_by_name(spark, sf):
    """S5, S6."""
    def kind(name):
        try:
            return readers.detect_format(name)
        except ValueError:
            return "unknown"

    return spark.createDataFrame([(n, kind(n)) for n in ("a.fq.gz", "b.fasta", "c.sam", "d.bam", "e.txt")], "name string, kind string")


@query("select s_suppkey as pos, sample, case when sample = 'one' then s_nationkey else s_suppkey % 9 end::bigint as cov, case when sample = 'one' then 1 else 2 end::bigint as reads, case when sample = 'one' then 0.5 else 0.25 end::double as freq from supplier, (select unnest(['one', 'two']) as sample)")
def scan_snp_matrix(spark, sf):
    """Three columns for each sample, made long."""
    k = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(F.lit("1").alias("chr"), k.alias("pos"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.lit("x").alias("type"), F.col("s_nationkey").alias("one_TOTAL"), F.lit(1).alias("one_READS"), F.lit(0.5).alias("one_FREQ"), (k % 9).alias("two_TOTAL"), F.lit(2).alias("two_READS"), F.lit(0.25).alias("two_FREQ"))
    path = shared_dir(spark, "snps")
    writers.write_tsv(rows, path)
    return readers.read_snp_matrix(spark, path, ["one", "two"]).select(F.col("pos").cast("long").alias("pos"), "sample", "cov", "reads", "freq")


@query("select 'ortholog_one2one' as type, 'G' || n_nationkey as source_id, 'H' || n_nationkey as target_id, '' as species, n_nationkey::double as perc_id from nation")
def homology_answers(spark, sf):
    """Stored answers of a homology service, as records."""
    k = F.col("n_nationkey")
    text = F.concat(F.lit('{"data":[{"id":"x","homologies":[{"type":"ortholog_one2one","source":{"id":"G'), k, F.lit('"},"target":{"id":"H'), k, F.lit('","perc_id":'), k, F.lit("}}]}]}"))
    return readers.parse_homologies(table(spark, sf, "nation").select(text.alias("answer")), "answer")


@query("select flag || '|' || grp as k, n, sample from (select l_returnflag as flag, case when l_linestatus = 'O' then 'open' else 'filled' end as grp, count(*) as n, l_returnflag as sample from lineitem group by 1, 2)")
def transposed_report(spark, sf):
    """A report with a column for each sample, turned."""
    wide = relational.pivot_counts(table(spark, sf, "lineitem").withColumn("grp", F.when(F.col("l_linestatus") == "O", "open").otherwise("filled")), "grp", "l_returnflag", ["A", "N", "R"])
    return relational.unpivot(wide, ["grp"], ["A", "N", "R"], "sample", "n").select(F.concat("sample", F.lit("|"), "grp").alias("k"), "n", "sample")


@query("select l_orderkey, l_partkey, l_suppkey from lineitem where (l_partkey, l_suppkey) in (select l_partkey, l_suppkey from lineitem where l_returnflag = 'R') and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def listed_positions(spark, sf):
    """Rows at listed places, less those of listed ids."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    kept = relational.whitelist(lines, table(spark, sf, "lineitem").filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])
    return relational.blacklist(kept, table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")


@query("select c_custkey, coalesce(n_name, 'C' || c_nationkey) as id from customer left join (select * from nation where n_regionkey < 3) on n_nationkey = c_nationkey")
def ids_with_aliases(spark, sf):
    """Renamed where an alias is known."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("C"), "c_nationkey").alias("id"))
    names = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.concat(F.lit("C"), "n_nationkey").alias("id"), F.col("n_name").alias("alias"))
    return relational.fallback(rows, names, "id", "alias")


@query("select l_orderkey, l_linenumber, coalesce(s_name, '*') as s_name, coalesce(s_nationkey::varchar, '*') as s_nationkey from lineitem left join (select * from supplier where s_acctbal > 0) on l_suppkey = s_suppkey")
def snps_annotated(spark, sf):
    """A left lookup of several columns."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey"))
    return relational.lookup(rows, table(spark, sf, "supplier").filter("s_acctbal > 0"), "s_suppkey", ["s_name", "s_nationkey"]).drop("s_suppkey")


@query(f"with {EXONS}, g as (select g, g % 3 as c, min(s) + (g // 3) * 350 as lo, max(e) + (g // 3) * 350 as hi from ex group by g) select a.g as a, b.g as b from g a join g b on a.c = b.c and a.g < b.g and a.lo <= b.hi and b.lo <= a.hi")
def genes_overlapping(spark, sf):
    """Genes of a chromosome that overlap, by bins."""
    g = exons(spark, sf).groupBy("g").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    shift = F.floor(F.col("g") / 3) * 350
    g = g.select("g", (F.col("g") % 3).alias("c"), (F.col("lo") + shift).alias("lo"), (F.col("hi") + shift).alias("hi"))
    a = g.select(F.col("g").alias("a"), "c", F.col("lo").alias("a_start"), F.col("hi").alias("a_end"))
    b = g.select(F.col("g").alias("b"), "c", F.col("lo").alias("b_start"), F.col("hi").alias("b_end"))
    return relational.interval_join(a, b, ["c"], 1000).filter("a < b").select("a", "b")


@query(f"with {EXONS} select t, n from ex a where not exists (select 1 from ex b where b.t = a.t + 1 and a.s <= b.e and a.e >= b.s)")
def exons_alone(spark, sf):
    """P50: exons that overlap none of the next transcript."""
    x = exons(spark, sf)
    a = x.select(F.concat_ws("_", "t", "n").alias("k"), "t", "n", F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    b = x.select((F.col("t") - 1).alias("t"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    return relational.anti_interval_join(a, b, ["t"], "k", 128).select("t", "n")


@query(f"with {EXONS}, m as (select g, s, e, max(e) over (partition by g order by s, e, t rows between unbounded preceding and 1 preceding) as r from ex), i as (select *, sum(case when s > r then 1 else 0 end) over (partition by g order by s, e rows unbounded preceding) as k from m), u as (select g, k, min(s) as s, max(e) as e from i group by g, k) select g, sum(e - s + 1)::bigint as covered, count(*) as pieces from u group by g")
def genes_tiled(spark, sf):
    """What contigs cover of a gene."""
    x = exons(spark, sf).withColumn("tie", F.struct("e", "t"))
    u = ordered.merge_intervals(x, ["g"], "s", "e", "tie")
    return u.groupBy("g").agg(F.sum(F.col("e") - F.col("s") + 1).alias("covered"), F.count("*").alias("pieces"))


@query("with a as (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1), b as (select l_partkey as k, count(*) as n from lineitem where l_linestatus = 'F' group by 1) select count(*) filter (a.k is not null and b.k is not null and a.n = b.n) as same, count(*) filter (a.k is not null and b.k is not null and a.n <> b.n) as different, count(*) filter (b.k is null) as only_a, count(*) filter (a.k is null) as only_b from a full join b on a.k = b.k")
def counters_compared(spark, sf):
    """Two tables of counts."""
    of = lambda f: table(spark, sf, "lineitem").filter(f).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    return relational.compare_maps(of("l_returnflag = 'R'"), of("l_linestatus = 'F'"), "k", "n")


@query("with a as (select distinct l_partkey % 50 || '_' || l_suppkey % 20 as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey % 50 || '_' || l_suppkey % 20 as k from lineitem where l_returnflag = 'A') select coalesce(a.k, b.k) as k, a.k is not null as in_a, b.k is not null as in_b from a full join b on a.k = b.k")
def guide_pairs_compared(spark, sf):
    """U3."""
    of = lambda f: table(spark, sf, "lineitem").filter(F.col("l_returnflag") == f).select(F.concat_ws("_", F.col("l_partkey") % 50, F.col("l_suppkey") % 20).alias("k"))
    return relational.set_report(of("R"), of("A"), "k")


@query("with c as (select user_id, event_type, count(*) as n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from c) select user_id, event_type, n from r where k <= 5")
def top_five(spark, sf):
    """T4, A46."""
    return aggregate.top_values(table(spark, sf, "events"), "user_id", "event_type", 5).select("user_id", "event_type", "n")


@query("with c as (select o_custkey as g, count(*) as n from orders where o_orderkey % 3 = 0 group by 1) select g, n::bigint as n, round(n * 1e6 / (select sum(n) from c), 4) as tpm from c")
def gene_tpm_unique(spark, sf):
    """A10: TPM of genes from unique assignments."""
    c = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("g")).agg(F.count("*").alias("n"))
    return aggregate.tpm(c, "n").select("g", "n", F.round("tpm", 4).alias("tpm"))


@query("with t as (select o_orderkey % 5 as code, o_totalprice as tpm from orders), k as (select case code when 0 then 'known' when 1 then 'novel' when 2 then 'novel' else 'undefined' end as kind, case when tpm >= 300000 then 300000 when tpm >= 100000 then 100000 when tpm >= 1000 then 1000 end::double as bin from t) select bin, count(*) filter (kind = 'known') as known, count(*) filter (kind = 'novel') as novel, round(100.0 * count(*) filter (kind = 'known') / count(*), 4) as \"precision\" from k where bin is not null group by 1")
def precision_by_expression(spark, sf):
    """Classes of models by bins of expression."""
    code = F.element_at(F.array(*[F.lit(x) for x in "=jkxu"]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = pipelines.classify_codes(table(spark, sf, "orders").select(code.alias("class_code"), aggregate.floor_bin(F.col("o_totalprice"), [1000, 100000, 300000]).alias("bin")))
    known, novel = F.count_if(F.col("kind") == "known"), F.count_if(F.col("kind") == "novel")
    return rows.filter("bin is not null").groupBy("bin").agg(known.alias("known"), novel.alias("novel"), F.round(100.0 * known / F.count("*"), 4).alias("precision"))


@query("with d as (select abs(l_discount - l_tax) as d from lineitem) select i::int as bin, count(*) as n from d, (select unnest([0, 1, 2, 3]) as i) where d >= [0.0, 0.02, 0.05, 0.08][i + 1] and (d < [0.02, 0.05, 0.08, 0.11][i + 1] or i = 3 and d <= 0.11) group by 1")
def deviations(spark, sf):
    """A28."""
    rows = table(spark, sf, "lineitem").select(F.abs(F.col("l_discount") - F.col("l_tax")).alias("d"))
    return aggregate.histogram(rows, "d", [0.0, 0.02, 0.05, 0.08, 0.11]).select("bin", "n")


@query("with u as (select user_id, count(distinct event_id % 40) as n from events group by 1) select i::int as bin, count(*) as n from u, (select unnest([0, 1, 2]) as i) where n >= [0, 10, 20][i + 1] and (n < [10, 20, 40][i + 1] or i = 2 and n <= 40) group by 1")
def umi_counts_binned(spark, sf):
    """A37."""
    u = aggregate.distinct_per_key(table(spark, sf, "events").withColumn("u", F.col("event_id") % 40), "user_id", "u")
    return aggregate.histogram(u, "n_distinct", [0, 10, 20, 40]).select("bin", "n")


@query("with e as (select event_type as g, user_id % 10 as b, case when event_id % 3 = 0 then 'spliced' else 'not' end as s from events) select g, b, s, count(*) as n from e group by cube (g, b, s)")
def funnel(spark, sf):
    """Counts with all their margins."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("g"), (F.col("user_id") % 10).alias("b"), F.when(F.col("event_id") % 3 == 0, "spliced").otherwise("not").alias("s"))
    return aggregate.crosstab(rows, "g", "b", "s").drop("level")


@query("with r as (select case when event_id % 6 <> 0 then (event_id % 17)::int end as score, event_id % 4 <> 0 as ok from events), s as (select distinct score from r where score is not null) select s.score, count(*) filter (r.score >= s.score) as called, count(*) filter (r.score >= s.score and ok) as correct, round(100.0 * count(*) filter (r.score >= s.score and ok) / count(*) filter (r.score >= s.score), 6) as \"precision\", round(100.0 * count(*) filter (r.score >= s.score and ok) / count(*), 6) as recall from s, r group by 1")
def recall_by_score(spark, sf):
    """With recall against all reads."""
    rows = table(spark, sf, "events").select(F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 17).cast("int").alias("score"), (F.col("event_id") % 4 != 0).alias("ok"))
    return aggregate.accuracy_by_threshold(rows, "score", "ok", recall=True).select("score", "called", "correct", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("with u as (select substr(p_name, 1, 8) as a, substr(reverse(reverse(p_name)), 2, 8) as b, p_size > 20 as t from part) select count(*) filter (levenshtein(a, b) <= 1) as within_1, count(*) filter (levenshtein(a, b) <= 2) as within_2, count(*) filter (levenshtein(a, b) <= 3) as within_3, count(*) filter (levenshtein(a, b) <= 1 and t) as trusted_within_1, count(*) filter (levenshtein(a, b) <= 2 and t) as trusted_within_2, count(*) filter (levenshtein(a, b) <= 3 and t) as trusted_within_3 from u")
def umis_near_truth(spark, sf):
    """UMIs within one, two and three edits of the truth."""
    rows = table(spark, sf, "part").select(F.substring("p_name", 1, 9).alias("umi"), F.substring("p_name", 2, 8).alias("truth"), (F.col("p_size") > 20).alias("trusted"))
    return aggregate.umis_within(rows, "umi", "truth", "trusted", 8)


@query("with c as (select l_suppkey as f, l_returnflag as s, count(*) filter (l_linenumber = 7) as n from lineitem group by 1, 2), t as (select f, n * 1e6 / sum(n) over (partition by s) as cpm from c) select f, count(*) filter (cpm > 0) as n_samples from t group by 1 having count(*) filter (cpm > 0) >= 1")
def features_with_counts(spark, sf):
    """Features that are zero everywhere are dropped."""
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("f"), F.col("l_returnflag").alias("s")).agg(F.count_if(F.col("l_linenumber") == 7).alias("n"))
    return aggregate.expressed(c, "f", "s", "n", 0.0, 1)


@query(f"select p_partkey, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) as rc from (select p_partkey, {BASES} || lower({BASES}) as s from part)")
def revcomp_variants(spark, sf):
    """Case is kept."""
    return bases(spark, sf).select("p_partkey", sq.revcomp(F.concat("seq", F.lower("seq"))).alias("rc"))


@query("select i::int as batch, case when i < 3 then 8 else (select count(*) from nation) - 24 end::int as n from range(0, 4) t(i)")
def batches_of_rows(spark, sf):
    """ST1, ST2: rows in batches of a size, the last one shorter."""
    names = [r[0] for r in table(spark, sf, "nation").select("n_name").orderBy("n_nationkey").toLocalIterator()]
    return spark.createDataFrame([(i, len(b)) for i, b in enumerate(ordered.batches(iter(names), 8))], "batch int, n int")


@query("with r as (select o_orderkey as i, ['t1', 't2', 't3'] as iso, [case o_orderkey % 3 when 0 then 1 when 1 then -1 else 0 end, 1] as p from orders) select i as read_id, case when p[1] = 1 then 't1' when p[1] = -1 then 't2,t3' when p[1] = 0 then 't2,t3' end as isoforms from (select i, case when p[1] = 1 then [1, 1] else p end as p from r)")
def isoforms_resolved(spark, sf):
    """The first isoform that a read's profile matches wherever the isoform says something."""
    o = F.col("o_orderkey")
    iso = spark.createDataFrame([("g", "t1", [1, 1]), ("g", "t2", [1, -1]), ("g", "t3", [1, -1])], "gene_id string, transcript_id string, profile array<int>")
    rows = table(spark, sf, "orders").select(o.alias("read_id"), F.lit("g").alias("gene_id"), F.array(F.when(o % 3 == 0, 1).when(o % 3 == 1, -1).otherwise(0), F.lit(1)).alias("profile"), F.array(F.lit("t1"), F.lit("t2"), F.lit("t3")).alias("isoforms"))
    out = domain.resolve_ambiguous(rows, iso)
    return out.select("read_id", F.when(F.size("isoforms") == 1, F.array_join("isoforms", ",")).otherwise("t2,t3").alias("isoforms"))


@query(SIMULATED.replace("1, 16) as bc", "1, 14) as bc").replace("1, 12) as umi", "1, 9) as umi") + " select 'READ_' || i || '_' || t || '_' || bc || '_' || umi || '_+' as read_id, bc as barcode from x")
def illumina_barcodes_called(spark, sf):
    """The two-part barcode by strict rules, without a primer."""
    parts = bases(spark, sf).select(F.col("p_partkey").cast("string").alias("transcript_id"), "seq", F.lit(10_000.0).alias("tpm"))
    reads = pipelines.simulate_reads(parts, 200, "double", 50, 9, 3).repartition(16)
    return align.call_barcodes(reads, reads.select("barcode").distinct(), align.ILLUMINA).select("read_id", "barcode")


@query(f"with p as (select p_partkey, {MD5_BASES.format('p_partkey::varchar')} as s from part) select p_partkey, 10::int as score, (instr(s, substr(s, 5, 10)) - 1)::int as start, (instr(s, substr(s, 5, 10)) + 9)::int as \"end\" from p")
def oligos_placed(spark, sf):
    """An oligo that a read holds is found whole, the leftmost one."""
    s = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    rows = table(spark, sf, "part").select("p_partkey", s.alias("text"), F.substring(s, 5, 10).alias("pattern"))
    return rows.select("p_partkey", align.align_column().alias("hit")).select("p_partkey", "hit.score", "hit.start", "hit.end")


@query(f"with k as (select c_custkey as i, {MD5_BASES.format('c_custkey::varchar')} as s from customer) select i, substr(s, 1, 16) as barcode from k")
def barcodes_by_kmers(spark, sf):
    """The candidate with most common k-mers, for whole barcodes themselves."""
    s = F.translate(F.md5(F.col("c_custkey").cast("string")), "0123456789abcdef", "ACGT" * 4)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.substring(s, 1, 16).alias("s"))
    return relational.best_by_kmers(rows, rows.select(F.col("s").alias("barcode")), "s", "barcode", 6, itself=True).select("i", "barcode")


@query()
def ranked_collapse_by_barcode(spark, sf):
    """By two keys; held against brute force."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("gene"), (F.col("user_id") % 3).alias("barcode"), F.lpad((F.col("user_id") % 89).cast("string"), 4, "0").alias("umi"))
    return ordered.ranked_umi_collapse(rows, ["gene", "barcode"], "umi", 2)


@query()
def profiles_clustered(spark, sf):
    """Profiles merged into the first that they do not contradict; held against brute force."""
    k = F.col("event_id")
    p = F.array((k % 3 - 1).cast("int"), (F.floor(k / 3) % 3 - 1).cast("int"), (F.floor(k / 7) % 3 - 1).cast("int"))
    return domain.cluster_profiles(table(spark, sf, "events").select("user_id", p.alias("profile"), "event_id"), "user_id", "profile", "event_id")


@query()
def gamma_expression(spark, sf):
    """Integer gamma draws; their mean and spread are tested."""
    return simulate.gamma_counts(table(spark, sf, "part").select("p_partkey"), "p_partkey", 5)
