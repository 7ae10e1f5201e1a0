"""Sequence expressions (inventory 2.10): Column -> Column, all JVM-side unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    """Reverse complement; case is kept, other characters stay."""
    return F.reverse(F.translate(_c(seq), "ACGTacgt", "TGCAtgca"))


def revcomp_strict(seq: Column | str) -> Column:
    """Reverse complement with every unknown base as N."""
    return revcomp(F.regexp_replace(_c(seq), "[^ACGTN]", "N"))


def revcomp_chomped(seq: Column | str) -> Column:
    """The last character (a line end) is dropped before reversing."""
    s = _c(seq)
    return revcomp(F.substring(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0))))


def count_chars(seq: Column | str, chars: str) -> Column:
    """How many characters of seq are among chars."""
    s = _c(seq)
    return F.length(s) - F.length(F.translate(s, chars, ""))


def gc_percent(seq: Column | str) -> Column:
    """Percentage of G and C in any case; null for an empty sequence."""
    s = _c(seq)
    return 100.0 * count_chars(s, "GCgc") / F.nullif(F.length(s), F.lit(0))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing places; -1 if the lengths differ."""
    a, b = _c(a), _c(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), -1).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance."""
    return F.levenshtein(_c(a), _c(b))


def kmers(seq: Column | str, k: int) -> Column:
    """All k-mers in order; none if the sequence is shorter."""
    s = _c(seq)
    return F.when(F.length(s) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k))))


def longest_run(seq: Column | str, alphabet: str = "ACGTN") -> Column:
    """Length of the longest run of one character of the alphabet; 0 if there is none."""
    s = _c(seq)
    runs = F.regexp_extract_all(s, F.lit("(" + "|".join(f"{c}+" for c in alphabet) + ")"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def trailing_run(seq: Column | str, char: str) -> Column:
    """length of the run of char at the end."""
    return F.length(F.regexp_extract(_c(seq), f"({char}*)$", 1))


def motif_count(seq: Column | str, motif: str) -> Column:
    """non-overlapping occurrences of a literal motif."""
    s = _c(seq)
    return ((F.length(s) - F.length(F.replace(s, F.lit(motif), F.lit("")))) / len(motif)).cast("int")


def motif_dense(seq: Column | str, forward: str, percent: float, longest: int) -> Column:
    """whether a sequence is short enough and either strand's motif covers percent of it."""
    s = _c(seq)
    most = F.greatest(motif_count(s, forward), motif_count(s, _revcomp_text(forward)))
    return (F.length(s) <= longest) & (most * len(forward) * 100 >= percent * F.length(s))


def _revcomp_text(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def first_dense_window(seq: Column | str, base: str, window: int = 16, fraction: float = 0.75, anchor: str = "TTT") -> Column:
    """0-based start of the first window with int(window * fraction) of base, moved to the first anchor from there;
    -1 if there is none. The window at the very end is not looked at."""
    s = _c(seq)
    need = int(window * fraction)
    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - window - 1, F.lit(0)))
    dense = F.filter(starts, lambda i: count_chars(F.substring(s, i + 1, F.lit(window)), base) >= need)
    first = F.get(dense, 0)
    moved = first + F.greatest(F.locate(anchor, F.substring(s, first + 1, F.length(s))) - 1, F.lit(0))
    return F.when((F.length(s) <= window) | first.isNull(), -1).otherwise(moved)


def slice_1based(seq: Column | str, start: Column, end: Column, strand: Column | None = None) -> Column:
    """X11: the closed 1-based range, reverse-complemented on '-'."""
    s = F.substring(_c(seq), start.cast("int"), (end - start + 1).cast("int"))
    return s if strand is None else F.when(strand == "-", revcomp(s)).otherwise(s)


def flanks(seq: Column | str, start: Column, end: Column, strand: Column, size: int = 300) -> Column:
    """struct<left, right> of size bases around a closed 1-based range; swapped and complemented on '-'."""
    s = _c(seq)
    low = F.greatest(start - size, F.lit(1))
    left = F.substring(s, low.cast("int"), (start - low).cast("int"))
    right = F.substring(s, (end + 1).cast("int"), F.lit(size))
    minus = strand == "-"
    return F.struct(F.when(minus, revcomp(right)).otherwise(left).alias("left"), F.when(minus, revcomp(left)).otherwise(right).alias("right"))


def concat_ranges(seq: Column | str, ranges: Column, strand: Column) -> Column:
    """The ranges (structs of start, end) one after another, each complemented on its own on '-'."""
    return F.array_join(F.transform(ranges, lambda r: slice_1based(seq, r["start"], r["end"], strand)), "")


def id_token(read_id: Column | str, place: int, sep: str = "_") -> Column:
    """The token at a 0-based place of a read id; null beyond the last."""
    return F.get(F.split(_c(read_id), f"\\Q{sep}\\E"), place)


def without_version(feature_id: Column | str) -> Column:
    """The id up to its first dot."""
    return F.substring_index(_c(feature_id), ".", 1)


def is_canonical(donor: Column, acceptor: Column, strand: Column) -> Column:
    """GT-AG on '+', CT-AC on '-' (as read on the reference strand)."""
    return F.when(strand == "-", (donor == "CT") & (acceptor == "AC")).otherwise((donor == "GT") & (acceptor == "AG"))


def nearest_site(seq: Column | str, at: Column, motif: str, reach: int = 6) -> Column:
    """Signed distance from 1-based `at` to the nearest occurrence of motif within reach; 0 if there, null if none."""
    s = _c(seq)
    offsets = F.filter(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.substring(s, (at + d).cast("int"), F.lit(len(motif))) == motif)
    return F.array_min(F.transform(offsets, lambda d: F.struct(F.abs(d).alias("far"), d.alias("d"))))["d"]


def trim_adapters(seq: Column | str, left: str, right: str) -> Column:
    """Cut at the first right adapter, then everything up to the first left one."""
    s = _c(seq)
    s = F.when(F.instr(s, right) > 0, F.substring(s, F.lit(1), F.locate(right, s) - 1)).otherwise(s)
    return F.when(F.instr(s, left) > 0, F.substring(s, F.locate(left, s) + len(left), F.length(s))).otherwise(s)


def merge_by_quality(seq1: Column, qual1: Column, seq2: Column, qual2: Column) -> Column:
    """The shorter read if lengths differ, else per base that with the higher quality (the first on ties)."""
    bases = F.transform(F.arrays_zip(F.split(seq1, "").alias("a"), F.split(qual1, "").alias("p"), F.split(seq2, "").alias("b"), F.split(qual2, "").alias("q")), lambda x: F.when(x["p"] >= x["q"], x["a"]).otherwise(x["b"]))
    return F.when(F.length(seq1) < F.length(seq2), seq1).when(F.length(seq1) > F.length(seq2), seq2).otherwise(F.array_join(bases, ""))


def append_polya(seq: Column | str, n: int) -> Column:
    """X22."""
    return F.concat(_c(seq), F.lit("A" * n))


#: Chemistries as (primer, linker after the barcode's first part, first part's length, tail); fixed values.
CHEMISTRIES = {
    "double": ("TACACGACGCTCTTCCGATCT", "TCTTCAGCGTTCCCGAGA", 8, "CCCATGTACTCTGCGTTGATACCACTGCTT"),
    "10x": ("CTACACGACGCTCTTCCGATCT", "", None, "CCCATGTACTCTGCGTTGATACCACTGCTT"),
}


def template(seq: Column, barcode: Column, umi: Column, chemistry: str, t_run: int = 30) -> Column:
    """Reverse complement of primer + barcode (around the linker) + UMI + T run + complemented cDNA + tail."""
    primer, linker, cut, tail = CHEMISTRIES[chemistry]
    parts = [barcode] if cut is None else [F.substring(barcode, 1, cut), F.lit(linker), F.substring(barcode, F.lit(cut + 1), F.length(barcode))]
    return revcomp(F.concat(F.lit(primer), *parts, umi, F.lit("T" * t_run), revcomp(seq), F.lit(tail)))


def mean_phred(qual: Column | str, offset: int = 33) -> Column:
    """Arithmetic mean of the qualities; null for an empty string."""
    codes = F.transform(F.filter(F.split(_c(qual), ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)
    return F.aggregate(codes, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(codes), F.lit(0))


def two_bit_decode(code: Column | str, length: int) -> Column:
    """An integer as bases, two bits each, A on the left where digits are missing."""
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), length, "0"), "0123", "ACGT")


def stretches(seq: Column | str, base: str, least: int) -> Column:
    """Maximal runs of base of at least `least`, as structs of 1-based start and end."""
    s = _c(seq)
    at = F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)))
    starts = F.filter(at, lambda i: (F.substring(s, i, F.lit(1)) == base) & ((i == 1) | (F.substring(s, i - 1, F.lit(1)) != base)))
    runs = F.transform(starts, lambda i: F.struct(i.alias("start"), (i - 1 + F.length(F.regexp_extract(F.substring(s, i, F.length(s)), f"^({base}+)", 1))).alias("end")))
    return F.filter(runs, lambda r: r["end"] - r["start"] + 1 >= least)


def tiles(seq: Column, read_length: int, insert: int, least: int) -> Column:
    """Structs of r1 (the tile's head) and r2 (the complement of its tail) of the tiles of a long read."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(seq), F.lit(1)), F.lit(insert))
    cut = F.filter(F.transform(starts, lambda i: F.substring(seq, i, F.lit(insert))), lambda t: F.length(t) >= least)
    return F.transform(cut, lambda t: F.struct(F.substring(t, 1, read_length).alias("r1"), F.substring(revcomp(t), 1, read_length).alias("r2")))


def format_spot(x: Column, y: Column, micron: int = 2) -> Column:
    """X25."""
    return F.format_string(f"s_{micron:03d}um_%s_%s", x.cast("string"), y.cast("string"))


def human_time(seconds: Column) -> Column:
    """H:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def parse_ranges(text: Column | str) -> Column:
    """S17: '0-3,7' as [0, 1, 2, 3, 7]."""
    return F.flatten(F.transform(F.split(_c(text), ","), lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int"))))
