"""Local alignment and barcode detection (inventory 2.11): NumPy kernels behind Arrow-backed pandas functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def reverse_complement(s: str) -> str:
    return s.translate(_COMPLEMENT)[::-1]


def local_align(text: str, pattern: str, match: int = 1, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int, int, int]:
    """M1, M2: (score, text start, text end, pattern start, pattern end), ends exclusive; the leftmost of the best.

    Row by row over the pattern; the run of gaps within a row is a running maximum, so each row is a few array operations.
    """
    n = len(text)
    if not n or not pattern:
        return 0, 0, 0, 0, 0
    t = np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)
    h = np.zeros((len(pattern) + 1, n + 1), dtype=np.int32)
    ramp = np.arange(n + 1) * gap
    for i, c in enumerate(pattern.encode("latin-1", "replace"), 1):
        diag = h[i - 1, :-1] + np.where(t == c, match, mismatch)
        row = np.zeros(n + 1, dtype=np.int32)
        row[1:] = np.maximum(np.maximum(diag, h[i - 1, 1:] + gap), 0)
        h[i] = np.maximum(row, np.maximum.accumulate(row - ramp) + ramp)
    best = int(h.max())
    if best <= 0:
        return 0, 0, 0, 0, 0
    j = int(np.flatnonzero((h == best).any(0))[0])
    i = int(np.flatnonzero(h[:, j] == best)[0])
    end_t, end_p = j, i
    while i and j and h[i, j] > 0:
        s = match if text[j - 1] == pattern[i - 1] else mismatch
        if h[i, j] == h[i - 1, j - 1] + s:
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return best, j, end_t, i, end_p


def find_pattern(text: str, start: int, end: int, pattern: str, min_score: int, overhang: int = 2) -> tuple[int, int] | None:
    """M5: where the pattern lies in text[start:end], ends inclusive; None if it scores less, or a side misses more."""
    score, a, b, p, q = local_align(text[max(0, start) : end], pattern)
    if score < min_score or p > overhang or len(pattern) - q > overhang:
        return None
    return max(0, start) + a, max(0, start) + b - 1


def polyt_start(seq: str, window: int = 16, fraction: float = 0.75) -> int:
    """As functions.sequence.first_dense_window."""
    need = int(window * fraction)
    if len(seq) <= window:
        return -1
    sums = np.concatenate([[0], np.cumsum(np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8) == ord("T"))])
    found = np.flatnonzero(sums[window:-1] - sums[: len(seq) - window] >= need)
    return -1 if not len(found) else int(found[0]) + max(0, seq[int(found[0]) :].find("TTT"))


class KmerIndex:
    """M6-M9: which known strings share k-mers with a sequence."""

    def __init__(self, known: list[str], k: int):
        self.known, self.k = known, k
        self.places: dict[str, list[int]] = {}
        for i, s in enumerate(known):
            for x in dict.fromkeys(s[j : j + k] for j in range(len(s) - k + 1)):
                self.places.setdefault(x, []).append(i)

    def candidates(self, seq: str, least: int, delta: int, most: int = 0) -> list[tuple[str, int]]:
        """T5: (string, shared) with shared at least `least` and within delta of the best, best first, then by string."""
        counts: dict[int, int] = {}
        for j in range(len(seq) - self.k + 1):
            for i in self.places.get(seq[j : j + self.k], ()):
                counts[i] = counts.get(i, 0) + 1
        top = max(counts.values(), default=0)
        out = sorted(((self.known[i], n) for i, n in counts.items() if n >= least and n >= top - delta), key=lambda x: (-x[1], x[0]))
        return out[:most] if most else out


def best_candidate(candidates: list[str], text: str, min_score: int, score_diff: int = 0) -> tuple[str, int, int, int] | None:
    """M3, M4: (string, score, start, end) by score, then leftmost, then string; None if the next best is too near."""
    scored = sorted(((-s, a, c, b) for c in candidates for s, a, b, _, _ in [local_align(text, c)] if s >= min_score))
    if not scored or (len(scored) > 1 and -scored[0][0] + scored[1][0] < score_diff):
        return None
    return scored[0][2], -scored[0][0], scored[0][1], scored[0][3]


@dataclass(frozen=True)
class Chemistry:
    """What stands where in a read, and how sure one must be.

    The anchor is the linker between the barcode's parts, or the primer before a whole barcode.  It is looked for before the
    poly-T by relaxed rules, and where there is none, or none of both, in the whole read by strict ones: (least score, most
    places of the anchor's start and end that may be missing, None for any number).
    """

    primer: str
    linker: str | None
    barcode: int
    first_part: int
    umi: int
    min_score: int | None  # None: one less than what is looked at
    relaxed: tuple[int, int | None, int | None] | None
    strict: tuple[int, int | None, int | None]
    anchor_k: int
    barcode_k: int
    score_diff: int = 0
    primer_rule: tuple[int, int | None, int | None] | None = None
    last_not_t: int = 0  # last bases of a valid UMI that are not T
    fixed_umi: bool = False  # with a poly-T, too, the UMI has its full length


#: Fixed values of the chemistries.
TENX = Chemistry("CTACACGACGCTCTTCCGATCT", None, 16, 16, 12, 14, (11, None, 2), (18, 1, 1), 7, 6)
DOUBLE = Chemistry("TACACGACGCTCTTCCGATCT", "TCTTCAGCGTTCCCGAGA", 14, 8, 9, 12, (11, 2, 2), (14, 1, 1), 5, 5, 0, (5, None, 2), 2)
ILLUMINA = Chemistry("TACACGACGCTCTTCCGATCT", "TCTTCAGCGTTCCCGAGA", 14, 8, 9, None, None, (14, 1, 1), 5, 5, 1, None, 2, True)
#: From so many barcodes on, a single-part barcode must match in full.
MANY_BARCODES = 100_000
#: A UMI's length may be off by so much; a known UMI must score so much; a second poly-T is looked for so far around its place.
UMI_DELTA, UMI_SCORE, UMI_K, AROUND = 2, 7, 5, (4, 10)
_CODE = np.full(256, 4, dtype=np.uint8)
_CODE[list(b"ACGT")] = range(4)
_PAD = 5
#: Windows that are aligned at once.
WINDOWS = 8_192


def _matrix(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bases of the sequences as 0 to 3 (4: another, 5: beyond the end), and their lengths."""
    n = np.array([len(s) for s in seqs], dtype=np.int64)
    out = np.full((len(seqs), int(n.max(initial=0)) + 1), _PAD, dtype=np.uint8)
    out[np.arange(out.shape[1]) < n[:, None]] = _CODE[np.frombuffer("".join(seqs).encode("latin-1", "replace"), dtype=np.uint8)]
    return out, n


def _flip(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Reverse complements."""
    at = n[:, None] - 1 - np.arange(codes.shape[1])
    turned = np.take_along_axis(codes, np.maximum(at, 0), 1)
    return np.where(at >= 0, np.where(turned < 4, 3 - turned, turned), _PAD).astype(np.uint8)


def _cut(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Pieces [start, end) of the rows, each padded to width."""
    at = starts[:, None] + np.arange(width)
    piece = np.take_along_axis(codes, np.clip(at, 0, codes.shape[1] - 1), 1)
    return np.where((at >= 0) & (at < ends[:, None]), piece, _PAD).astype(np.uint8)


def _kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mer at each place as a number, -1 where it holds another character or the end."""
    n = codes.shape[1] - k + 1
    if n <= 0:
        return np.zeros((len(codes), 0), dtype=np.int64)
    out, good = np.zeros((len(codes), n), dtype=np.int64), np.ones((len(codes), n), dtype=bool)
    for j in range(k):
        out = out * 4 + codes[:, j : j + n]
        good &= codes[:, j : j + n] < 4
    return np.where(good, out, -1)


def polyt_starts(codes: np.ndarray, n: np.ndarray, window: int = 16, fraction: float = 0.75) -> np.ndarray:
    """polyt_start() of every row."""
    t = codes == 3
    width = codes.shape[1]
    if width <= window:
        return np.full(len(codes), -1)
    sums = np.concatenate([np.zeros((len(codes), 1), dtype=np.int32), np.cumsum(t, axis=1, dtype=np.int32)], axis=1)
    dense = (sums[:, window:-1] - sums[:, : width - window] >= int(window * fraction)) & (np.arange(width - window) < (n - window)[:, None])
    first = dense.argmax(1)
    three = np.full((len(codes), width), width)
    if width > 2:
        at = t[:, :-2] & t[:, 1:-1] & t[:, 2:]
        three[:, :-2] = np.where(at, np.arange(width - 2), width)
    following = np.minimum.accumulate(three[:, ::-1], axis=1)[:, ::-1]
    anchor = following[np.arange(len(codes)), first]
    return np.where(dense.any(1), np.where(anchor < width, anchor, first), -1)


def align_batch(texts: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """local_align() of each row of texts with its row of patterns (padded with _PAD): columns score, text start and end, pattern
    start and end, ends exclusive."""
    if len(texts) > WINDOWS:
        return np.concatenate([align_batch(texts[i : i + WINDOWS], patterns[i : i + WINDOWS]) for i in range(0, len(texts), WINDOWS)])
    rows, n, m = len(texts), texts.shape[1], patterns.shape[1]
    h = np.zeros((m + 1, rows, n + 1), dtype=np.int16)
    ramp = np.arange(n + 1, dtype=np.int16)
    step = np.zeros((m + 1, rows, n + 1), dtype=np.int16)  # match or mismatch at each cell
    for i in range(1, m + 1):
        p = patterns[:, i - 1 : i]
        score = np.where((texts == p) & (texts < 4), 1, -1).astype(np.int16)
        step[i, :, 1:] = score
        row = np.zeros((rows, n + 1), dtype=np.int16)
        row[:, 1:] = np.maximum(np.maximum(h[i - 1, :, :-1] + score, h[i - 1, :, 1:] - 1), 0)
        row = np.maximum(np.maximum.accumulate(row + ramp, axis=1) - ramp, 0)
        h[i] = np.where((p < _PAD) & (np.concatenate([np.zeros((rows, 1), dtype=np.uint8), texts], axis=1) < _PAD), row, 0)
    best = h.max((0, 2)) if rows else np.zeros(0, dtype=np.int16)
    top = (h == best[None, :, None]).any(0)
    j = top.argmax(1)
    r = np.arange(rows)
    i = (h[:, r, j] == best[None, :]).argmax(0)
    out = np.zeros((rows, 5), dtype=np.int64)
    out[:, 0], out[:, 2], out[:, 4] = best, j, i
    active = (i > 0) & (j > 0) & (best > 0)
    while active.any():
        a = np.flatnonzero(active)
        x, y = i[a], j[a]
        here = h[x, a, y]
        across = here == h[x - 1, a, y - 1] + step[x, a, y]
        down = ~across & (here == h[x - 1, a, y] - 1)
        i[a] = x - (across | down)
        j[a] = y - (across | ~(across | down))
        active[a] = (i[a] > 0) & (j[a] > 0) & (h[i[a], a, j[a]] > 0)
    out[:, 1], out[:, 3] = np.where(best > 0, j, 0), np.where(best > 0, i, 0)
    out[best <= 0] = 0
    return out


def _find(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, pattern: str, k: int, rule: tuple[int, int | None, int | None]) -> tuple[np.ndarray, np.ndarray]:
    """M5: first and last place of the pattern in [start, end) of each row, -1 where the rule is not met: windows around every
    common k-mer are aligned, the best one, the leftmost of equals, counts."""
    own, size = _matrix([pattern])[0][:, :-1], len(pattern)
    seeds = np.zeros(4**k + 1, dtype=bool)
    seeds[_kmers(own, k)[0]] = True
    seeds[-1] = False  # where -1 looks
    row, at = np.nonzero(seeds[_kmers(codes, k)])
    keep = (at >= starts[row]) & (at + k <= ends[row])
    row, at = row[keep], at[keep]
    low, high = np.maximum(starts[row], at - size + k), np.minimum(ends[row], at + size + 1)
    low, high, row = np.unique(np.column_stack([row, low, high]), axis=0).T[[1, 2, 0]] if len(row) else (low, high, row)
    got = align_batch(_cut(codes[row], low, high, 2 * size - k + 1), np.broadcast_to(own[0], (len(row), size)))
    first, last = np.full(len(codes), -1), np.full(len(codes), -1)
    order = np.lexsort((low + got[:, 1], -got[:, 0], row))
    order = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
    least, left, right = rule
    g = got[order]
    good = (g[:, 0] >= least) & (True if left is None else g[:, 3] <= left) & (True if right is None else size - g[:, 4] <= right)
    first[row[order][good]] = (low[order] + g[:, 1])[good]
    last[row[order][good]] = (low[order] + g[:, 2])[good] - 1
    return first, last


class KmerTable:
    """M6-M9: known strings by k-mer, as sorted numbers; candidates and best matches of many pieces at once."""

    def __init__(self, known: list[str], k: int):
        self.known, self.k = known, k
        self.codes, self.n = _matrix(known)
        kmers = _kmers(self.codes, k)
        owner = np.repeat(np.arange(len(known)), kmers.shape[1])
        pairs = np.unique(np.column_stack([kmers.ravel(), owner])[kmers.ravel() >= 0], axis=0)
        self.kmers, self.owner = pairs[:, 0], pairs[:, 1]

    def candidates(self, pieces: np.ndarray, least: int = 2, delta: int = 3, most: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """T5: (piece, known string, shared k-mers), as KmerIndex.candidates() of each piece."""
        kmers = _kmers(pieces, self.k)
        piece, kmer = np.repeat(np.arange(len(pieces)), kmers.shape[1]), kmers.ravel()
        low, high = np.searchsorted(self.kmers, kmer), np.searchsorted(self.kmers, kmer, side="right")
        n = np.where(kmer >= 0, high - low, 0)
        entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, shared = np.unique(np.repeat(piece, n) * max(len(self.known), 1) + self.owner[entry], return_counts=True)
        piece, known = pair // max(len(self.known), 1), pair % max(len(self.known), 1)
        top = np.zeros(len(pieces), dtype=np.int64)
        np.maximum.at(top, piece, shared)
        good = (shared >= least) & (shared >= top[piece] - delta)
        piece, known, shared = piece[good], known[good], shared[good]
        order = np.lexsort((known, -shared, piece))
        piece, known, shared = piece[order], known[order], shared[order]
        first = np.searchsorted(piece, np.arange(len(pieces)))
        few = np.arange(len(piece)) - first[piece] < most
        return piece[few], known[few], shared[few]

    def best(self, pieces: np.ndarray, min_score: np.ndarray, score_diff: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """M3, M4: of each piece the known string (-1: none) with the best local score, the leftmost of equals, its score and
        the last place of the match; none if the next best is too near."""
        piece, known, _ = self.candidates(pieces)
        got = align_batch(pieces[piece], self.codes[known])
        good = (got[:, 0] >= min_score[piece]) & (got[:, 0] > 0)
        piece, known, got = piece[good], known[good], got[good]
        order = np.lexsort((known, got[:, 1], -got[:, 0], piece))
        piece, known, got = piece[order], known[order], got[order]
        name, score, last = np.full(len(pieces), -1), np.full(len(pieces), -1), np.full(len(pieces), -1)
        if len(piece):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            second = np.minimum(first + 1, len(piece) - 1)
            rival = np.where((piece[second] == piece[first]) & (second != first), got[second, 0], 0)
            sure = got[first, 0] - rival >= score_diff
            first = first[sure]
            name[piece[first]], score[piece[first]], last[piece[first]] = known[first], got[first, 0], got[first, 2] - 1
        return name, score, last


def _letters(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    text = np.frombuffer(b"ACGTN", dtype=np.uint8)
    return [text[row[max(a, 0) : max(b, 0)]].tobytes().decode() if b > a else "" for row, a, b in zip(np.minimum(codes, 4), starts.tolist(), ends.tolist())]


def detect_forward(codes: np.ndarray, n: np.ndarray, c: Chemistry, barcodes: KmerTable, umis: KmerTable | None = None) -> dict[str, np.ndarray]:
    """Poly-T, anchor before it or anywhere, primer, the barcode among the candidates, then the UMI up to the poly-T."""
    rows = len(codes)
    zero = np.zeros(rows, dtype=np.int64)
    polyt = polyt_starts(codes, n) if c.relaxed else np.full(rows, -1)
    pattern = c.linker or c.primer
    first, last = _find(codes, zero, np.where(polyt >= 0, polyt + 1, 0), pattern, c.anchor_k, c.relaxed) if c.relaxed else (zero - 1, zero - 1)
    again = np.flatnonzero(first < 0)
    first[again], last[again] = _find(codes[again], zero[again], n[again], pattern, c.anchor_k, c.strict)
    found = first >= 0
    after = c.barcode - c.first_part if c.linker else c.barcode
    # A poly-T that was not found, or is too far away, is looked for where it should be: five T in a row.
    second = np.flatnonzero(found & ((polyt < 0) | (polyt - last > after + c.umi + 10)))
    if len(second):
        low = last[second] + after + c.umi - AROUND[0]
        high = np.minimum(n[second], low + sum(AROUND))
        low = np.maximum(low, 0)
        near = polyt_starts(_cut(codes[second], low, high, sum(AROUND) + 1), np.maximum(high - low, 0), 5, 1.0)
        polyt[second] = np.where(near >= 0, near + low, -1)
    primer_end = np.full(rows, -1)
    if c.linker is None:
        primer_end = last.copy()
        pieces, begins = _cut(codes, last + 1, np.minimum(n, last + c.barcode + 2), c.barcode + 1), last + 1
    else:
        if c.primer_rule:
            primer_end = _find(codes, zero, np.where(found, first, 0), c.primer, 6, c.primer_rule)[1]
        begins = np.where(primer_end >= 0, primer_end + 1, np.maximum(first - c.first_part, 0))
        width = int(np.maximum(first - begins, 0).max(initial=0))
        left, n_left = _cut(codes, begins, first, max(width, 1)), np.maximum(first - begins, 0)
        right = _cut(codes, last + 1, np.minimum(n, last + after + (1 if c.fixed_umi else 2)), after + 1)
        both = np.concatenate([left, right], axis=1)
        order = np.argsort(both == _PAD, axis=1, kind="stable")  # the parts close up
        pieces = np.take_along_axis(both, order, 1)
    size = (pieces < _PAD).sum(1)
    pieces[~found] = _PAD
    least = np.full(rows, c.min_score) if c.min_score is not None else np.maximum(size - 1, 1)
    if c.linker is None and len(barcodes.known) > MANY_BARCODES:
        least[:] = c.barcode
    if c.fixed_umi:
        pieces[size < c.barcode - 4] = _PAD
    name, score, end = barcodes.best(pieces, least, c.score_diff)
    # The barcode's end in the read: what the match leaves of the piece is taken off.
    barcode_end = last + after + 1 - (size - end - 1)
    start = barcode_end + 1
    until = polyt - 1
    full = (until - start <= 5) | ((polyt >= 0) if c.fixed_umi else False)
    until = np.minimum(np.where(full, start + c.umi - 1, until), n - 1)
    called = name >= 0
    umi = np.array(_letters(codes, np.where(called, start, 0), np.where(called, until + 1, 0)), dtype=object)
    valid = np.array([abs(len(u) - c.umi) <= UMI_DELTA and "T" not in (u[-c.last_not_t :] if c.last_not_t else "") for u in umi], dtype=bool) & called
    if umis is not None and called.any():
        at = np.flatnonzero(called)
        known, _, _ = umis.best(_cut(codes[at], start[at], until[at] + 1, int(np.maximum(until[at] + 1 - start[at], 1).max())), np.full(len(at), UMI_SCORE))
        for i, u in zip(at[known >= 0], known[known >= 0]):
            umi[i], valid[i] = umis.known[u], False
    umi[umi == ""] = "*"
    return {"barcode": name, "score": score, "umi": umi, "valid_umi": valid, "polyt": polyt, "primer_end": primer_end, "linker_start": first if c.linker else zero - 1, "linker_end": last if c.linker else zero - 1}


def detect(seqs: list[str], c: Chemistry, barcodes: KmerTable, umis: KmerTable | None = None) -> pd.DataFrame:
    """The forward strand if it has a barcode, else the reverse if that has one, else whichever says more (poly-T, then
    primer, then linker, then score); the strand is known where there is a poly-T."""
    codes, n = _matrix(seqs)
    out = detect_forward(codes, n, c, barcodes, umis)
    strand = np.where(out["polyt"] >= 0, "+", ".").astype(object)
    rest = np.flatnonzero(out["barcode"] < 0)
    if len(rest):
        back = detect_forward(_flip(codes[rest], n[rest]), n[rest], c, barcodes, umis)

        def said(x: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
            return (x["polyt"][at] >= 0) * 8 + (x["primer_end"][at] >= 0) * 4 + (x["linker_start"][at] >= 0) * 2

        every = np.arange(len(rest))
        turn = (back["barcode"] >= 0) | (said(back, every) > said(out, rest))
        for k in out:
            out[k][rest[turn]] = back[k][turn]
        strand[rest[turn]] = np.where(back["polyt"][turn] >= 0, "-", ".")
    names = np.array([*barcodes.known, "*"], dtype=object)
    return pd.DataFrame({"barcode": names[out["barcode"]], "umi": np.where(out["barcode"] >= 0, out["umi"], "*"), "bc_score": out["score"], "valid_umi": out["valid_umi"], "strand": strand, **{x: out[x] for x in ("polyt", "primer_end", "linker_start", "linker_end")}})


#: Barcodes of a table; a larger whitelist is called in several, and a read's best call counts.
BLOCK = 2_000_000
#: Bases that are looked at together.
BASES = 2_000_000
_CALLS = "read_id string, barcode string, umi string, bc_score int, valid_umi boolean, strand string, polyt int, primer_end int, linker_start int, linker_end int"


def call_barcodes(reads: DataFrame, barcodes: DataFrame, chemistry: Chemistry = TENX, umis: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """M10-M15, entry point 1: a call for each read (read_id, seq), by batches of array operations. The whitelist goes to all
    tasks in tables of `block` barcodes, one after another; umis, a list of known UMIs, is a kit's and of one table."""
    context = reads.sparkSession.sparkContext
    blocks = max(1, -(-barcodes.select("barcode").distinct().count() // block))
    part = F.pmod(F.xxhash64("barcode"), F.lit(blocks))
    sent = [context.broadcast(sorted(r[0] for r in barcodes.select("barcode").distinct().filter(part == i).collect() if r[0])) for i in range(blocks)]
    known_umis = context.broadcast(sorted({r[0] for r in umis.limit(block).collect()})) if umis is not None else None
    held: dict[int, KmerTable] = {}

    def table(i: int) -> KmerTable:
        if i not in held:
            for old in [x for x in held if x >= 0 and i >= 0]:
                del held[old]
            held[i] = KmerTable(sent[i].value, chemistry.barcode_k) if i >= 0 else KmerTable(known_umis.value, UMI_K)
        return held[i]

    def call(batches):
        for b in batches:
            seqs = [(s or "").upper() for s in b["seq"]]
            order = np.argsort([len(s) for s in seqs], kind="stable")
            cuts, size = [0], 0
            for i, j in enumerate(order):  # reads of like length together, so little is padding
                size = max(len(seqs[j]), 1) * (i + 1 - cuts[-1])
                if size > BASES and i > cuts[-1]:
                    cuts.append(i)
            for first, end in zip(cuts, [*cuts[1:], len(order)]):
                some = order[first:end]
                if not len(some):
                    continue
                best = None
                for i in range(blocks):
                    got = detect([seqs[j] for j in some], chemistry, table(i), table(-1) if known_umis is not None else None)
                    if best is None:
                        best = got
                    else:
                        better = got["bc_score"] > best["bc_score"]
                        best = best.where(~better, got)
                best.insert(0, "read_id", b["read_id"].to_numpy()[some])
                yield best

    return reads.select("read_id", "seq").mapInPandas(call, _CALLS)


def align_column(text: str = "text", pattern: str = "pattern"):
    """struct<score, start, end> of the local alignment of two string columns."""

    @F.pandas_udf("score int, start int, end int")
    def align(t: pd.Series, p: pd.Series) -> pd.DataFrame:
        found = [local_align(a or "", b or "")[:3] for a, b in zip(t, p)]
        return pd.DataFrame(found, columns=["score", "start", "end"])

    return align(F.col(text), F.col(pattern))
