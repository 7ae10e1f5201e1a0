"""Closed-interval expressions (inventory 2.4). An interval is a struct with start and end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps(a: Column, b: Column) -> Column:
    """Sharing an end point is an overlap."""
    return (a["start"] <= b["end"]) & (a["end"] >= b["start"])


def left_of(a: Column, b: Column) -> Column:
    """I2."""
    return a["end"] < b["start"]


def right_of(a: Column, b: Column) -> Column:
    """I2."""
    return a["start"] > b["end"]


def contains(a: Column, b: Column, delta: int = 0) -> Column:
    """B in a, up to delta beyond."""
    return (a["start"] - delta <= b["start"]) & (a["end"] + delta >= b["end"])


def equal_ranges(a: Column, b: Column, delta: int = 0) -> Column:
    """I5."""
    return (F.abs(a["start"] - b["start"]) <= delta) & (F.abs(a["end"] - b["end"]) <= delta)


def covers_start(a: Column, b: Column) -> Column:
    """A reaches over b's start and ends in it."""
    return (a["start"] <= b["start"]) & (a["end"] >= b["start"]) & (a["end"] < b["end"])


def covers_end(a: Column, b: Column) -> Column:
    """A begins in b and reaches over its end."""
    return (a["start"] > b["start"]) & (a["start"] <= b["end"]) & (a["end"] >= b["end"])


def length(a: Column) -> Column:
    """I10."""
    return a["end"] - a["start"] + 1


def total_length(intervals: Column) -> Column:
    """Sum over an array."""
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda s, x: s + length(x))


def intersection(a: Column, b: Column) -> Column:
    """I8: struct, with end before start where there is none."""
    return F.struct(F.greatest(a["start"], b["start"]).alias("start"), F.least(a["end"], b["end"]).alias("end"))


def intersection_length(a: Column, b: Column) -> Column:
    """I8."""
    return F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1)


def overlaps_at_least(a: Column, b: Column, delta: int) -> Column:
    """By delta, or by a whole interval where that is shorter."""
    return F.least(a["end"], b["end"]) + 1 - F.greatest(a["start"], b["start"]) >= F.least(F.lit(delta), length(a), length(b))


def overlap_fraction(a: Column, b: Column) -> Column:
    """Of the shorter one."""
    return intersection_length(a, b) / F.least(length(a), length(b))


def junctions(blocks: Column) -> Column:
    """The gaps between consecutive sorted blocks; adjacent blocks have none."""
    n = F.size(blocks)
    gaps = F.zip_with(F.slice(blocks, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(blocks, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.struct((x["end"] + 1).alias("start"), (y["start"] - 1).alias("end")))
    return F.filter(gaps, lambda j: j["start"] <= j["end"])


def lists_overlap(a: Column, b: Column) -> Column:
    """Any pair overlaps."""
    return F.exists(a, lambda x: F.exists(b, lambda y: overlaps(x, y)))


def until(intervals: Column, pos: Column) -> Column:
    """What lies at or before pos, clipped."""
    return F.transform(F.filter(intervals, lambda x: x["start"] <= pos), lambda x: F.struct(x["start"].alias("start"), F.least(x["end"], pos).alias("end")))


def starting_from(intervals: Column, pos: Column) -> Column:
    """What lies at or after pos, clipped."""
    return F.transform(F.filter(intervals, lambda x: x["end"] >= pos), lambda x: F.struct(F.greatest(x["start"], pos).alias("start"), x["end"].alias("end")))


def span(intervals: Column) -> Column:
    return F.struct(F.array_min(F.transform(intervals, lambda x: x["start"])).alias("start"), F.array_max(F.transform(intervals, lambda x: x["end"])).alias("end"))


def trailing_unique(a: Column, b: Column) -> Column:
    """Struct of left and right: the parts of both lists beyond the other's span, the longer one's where one holds both."""
    x, y = span(a), span(b)
    both = F.concat(a, b)
    left = until(both, F.greatest(x["start"], y["start"]) - 1)
    right = starting_from(both, F.least(x["end"], y["end"]) + 1)
    return F.struct(left.alias("left"), right.alias("right"))


def shared_length(a: Column, b: Column) -> Column:
    """Summed overlaps of two lists."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.aggregate(b, F.lit(0).cast("long"), lambda t, y: t + intersection_length(x, y)))


def coverage_fraction(reads: Column, isoform: Column) -> Column:
    """Of the isoform's length."""
    return shared_length(isoform, reads) / total_length(isoform)


def contains_any(exon: Column, features: Column, delta: int = 0) -> Column:
    """I16."""
    return F.exists(features, lambda f: contains(exon, f, delta))


def equals_any(exon: Column, features: Column, delta: int = 0) -> Column:
    """I16."""
    return F.exists(features, lambda f: equal_ranges(exon, f, delta))


def best_fraction(exon: Column, features: Column) -> Column:
    """I16: largest share of the exon that a feature covers, 0 at least."""
    return F.coalesce(F.array_max(F.transform(features, lambda f: intersection_length(exon, f) / length(exon))), F.lit(0.0))


def best_feature(exon: Column, features: Column) -> Column:
    """The feature with the largest overlap; the first by start on ties, null if none overlaps."""
    scored = F.transform(F.filter(features, lambda f: overlaps(exon, f)), lambda f: F.struct((-intersection_length(exon, f)).alias("less"), f["start"].alias("start"), f["end"].alias("end")))
    best = F.array_min(scored)
    return F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["end"].alias("end")))


def range_in(small: Column, large: Column) -> Column:
    """Strictly inside."""
    return (small["start"] > large["start"]) & (small["end"] < large["end"])


def range_at_start(small: Column, large: Column) -> Column:
    """I18."""
    return (small["start"] == large["start"]) & (small["end"] < large["end"])


def range_at_end(small: Column, large: Column) -> Column:
    """I18."""
    return (small["end"] == large["end"]) & (small["start"] > large["start"])


def utr_blocks(exons: Column, cds_end: Column, polya: Column, strand: Column) -> Column:
    """Exon parts between the coding end and the poly-A site; empty without a coding end."""
    plus = until(starting_from(exons, cds_end + 1), polya)
    minus = starting_from(until(exons, cds_end - 1), polya)
    return F.when(cds_end.isNull(), F.slice(exons, 1, 0)).when(strand == "-", minus).otherwise(plus)


def parse_regions(text: Column) -> Column:
    """I21: ';%;chr_start_end_strand...' as structs; the chromosome may hold underscores."""
    parts = F.filter(F.split(text, ";%;"), lambda x: x != "")
    field = r"^(.*)_(\d+)_(\d+)_([+.-])$"
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, field, 1).alias("chr"), F.regexp_extract(x, field, 2).cast("long").alias("start"), F.regexp_extract(x, field, 3).cast("long").alias("end"), F.regexp_extract(x, field, 4).alias("strand")))


def format_regions(chrom: Column, intervals: Column, strand: Column) -> Column:
    """I21."""
    return F.array_join(F.transform(intervals, lambda x: F.concat(F.lit(";%;"), chrom, F.lit("_"), x["start"].cast("string"), F.lit("_"), x["end"].cast("string"), F.lit("_"), strand)), "")


def parse_blocks(text: Column) -> Column:
    """S11: 's-e,s-e' as structs."""
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: F.struct(F.split(x, "-")[0].cast("long").alias("start"), F.split(x, "-")[1].cast("long").alias("end")))


def cigar_blocks(start0: Column, cigar: Column) -> Column:
    """1-based exon blocks of a CIGAR string: M, I, D, = and X stay in a block, N and S end it; blocks without a
    match are left out."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("long").alias("n"), F.right(x, F.lit(1)).alias("op")))
    zero = F.struct((start0 + 1).cast("long").alias("pos"), (start0 + 1).cast("long").alias("from"), F.lit(False).alias("seen"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        moves = x["op"].isin("M", "D", "=", "X", "N")
        pos = s["pos"] + F.when(moves, x["n"]).otherwise(F.lit(0).cast("long"))
        cut = x["op"].isin("N", "S")
        closed = F.when(cut & s["seen"], F.concat(s["out"], F.array(F.struct(s["from"].alias("start"), (s["pos"] - 1).alias("end"))))).otherwise(s["out"])
        return F.struct(pos.alias("pos"), F.when(cut, pos).otherwise(s["from"]).alias("from"), (~cut & (s["seen"] | x["op"].isin("M", "=", "X"))).alias("seen"), closed.alias("out"))

    return F.aggregate(ops, zero, step, lambda s: F.when(s["seen"], F.concat(s["out"], F.array(F.struct(s["from"].alias("start"), (s["pos"] - 1).alias("end"))))).otherwise(s["out"]))


def is_spliced(cigar: Column) -> Column:
    """F4."""
    return F.contains(cigar, F.lit("N"))


def is_primary(flag: Column) -> Column:
    """mapped, neither secondary nor supplementary."""
    return flag.bitwiseAND(0x904) == 0
