"""Best-fit packing by a linear grouping scheme.

The plan is made on the histogram of lengths (at most `capacity` numbers): lengths above capacity / LARGE are rounded up
within groups of equal cardinality (not at all if there are no more lengths than groups).  For these few sizes a linear
programme finds the configurations that need the fewest sequences, each used as often as the programme says, its fractions
dropped; what they leave goes into the fullest sequences that can be made of it.  Actual lengths take the places of rounded
ones, which frees room; then the small lengths go, largest first, where they fit best, and open new sequences where none
has room.  Rounding costs most where it reaches far down, so the plan is made for several limits and the best one taken.
Pieces then find their places by their rank among the pieces of their length.  The plan's lines are bounded by the capacity
and the groups, not by the documents, as every line stands for any number of sequences alike.

Ids are those of the vocabulary file's own tokenizer, special strings in a text included.

Defined cases: null text is empty and has the end id alone; longer documents are cut, the last piece keeping the rest;
equal lengths are ranked by the hash of a number that each piece is given; repeated rows are packed each; an empty table gives an empty result; extra columns are not read by tokenize(), and pass
through pack_pieces(), where sequence_id and offset are replaced.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import _tokens as tk
from strandlake.llm._runtime import stored

CAPACITY = 4096
END_ID = 1
#: Lengths above capacity / LARGE are grouped, in GROUPS groups; of several such limits the best one is taken.
LARGE, GROUPS = (6, 4, 3, 2), 64
#: Pieces for a task when they are ranked.
PIECES_PER_BUCKET = 50_000
Line = tuple[int, tuple[tuple[int, int], ...]]  # how many sequences, and (length, how many) in each


def _best_column(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The configuration (places of each size) of most worth that fits: exact, by number of items, as few large ones fit."""
    value, picks = np.zeros(capacity + 1), []
    best, at = 0.0, (0, capacity)
    for _ in range(capacity // int(sizes.min())):
        new, pick = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, dtype=np.int64)
        for g, (n, y) in enumerate(zip(sizes.tolist(), worth.tolist())):
            if y > 0:
                got = value[: capacity + 1 - n] + y
                better = got > new[n:]
                new[n:][better], pick[n:][better] = got[better], g
        value = new
        picks.append(pick)
        if value.max() > best:
            best, at = float(value.max()), (len(picks), int(value.argmax()))
    out, (items, room) = [0] * len(sizes), at
    for pick in reversed(picks[:items]):
        out[pick[room]] += 1
        room -= int(sizes[pick[room]])
    return best, out


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 2_000) -> list[tuple[int, list[int]]]:
    """(how often, places of each size) of few configurations, as many as there are sizes at most, that hold nearly all counts.

    The linear programme of fewest sequences, by the simplex method: configurations come in one by one, each the one of most
    worth at the current prices, until none is worth more than a sequence.  Parts of a sequence are left out here.
    """
    n, c, d = len(sizes), np.array(sizes), np.array(counts, dtype=float)
    columns = np.diag(capacity // c).astype(float)  # at first each size by itself
    inverse = np.diag(1.0 / np.diag(columns))
    for _ in range(rounds):
        prices = inverse.sum(0)
        worth, column = _best_column(c, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ np.array(column, dtype=float)
        x = inverse @ d
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    x = np.floor(inverse @ d + 1e-6).astype(int)
    left, used = np.array(counts), []
    for j in np.argsort(-x, kind="stable"):
        column = columns[:, j].astype(int)
        places = column > 0
        times = int(min(x[j], (left[places] // column[places]).min()))
        if times > 0:
            left = left - times * column
            used.append((times, column.tolist()))
    return used


def _fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """Groups of the fullest sequence that starts with group `first`, each at most as often as it is left."""
    room = capacity - sizes[first]
    sums, steps = 1, []  # bit i: groups can fill i of the room; exact, and a matter of capacity bits for each place
    for g in range(len(sizes) - 1, first - 1, -1):
        for _ in range(min(left[g] - (g == first), room // sizes[g])):
            steps.append((g, sums))
            sums |= (sums << sizes[g]) & ((2 << room) - 1)
    fill, used = sums.bit_length() - 1, [first]
    for g, before in reversed(steps):  # longest first
        if fill >= sizes[g] and before >> (fill - sizes[g]) & 1:
            used.append(g)
            fill -= sizes[g]
    return used


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, large: tuple[int, ...] = LARGE, groups: int = GROUPS) -> list[Line]:
    """Lines that together hold every length as often as the histogram has it; of the limits for large lengths the one that
    needs the fewest sequences is taken."""
    return min((_plan(histogram, capacity, x, groups) for x in large), key=lambda lines: sum(times for times, _ in lines))


def _plan(histogram: dict[int, int], capacity: int, large: int, groups: int) -> list[Line]:
    big = sorted((n for n in histogram if n > capacity // large), reverse=True)
    total = sum(histogram[n] for n in big)
    runs: list[list[list[int]]] = []  # of each group: [length, count], longest first
    if total:
        per, rounded = -(-total // groups), len(big) > groups
        room = 0
        for n in big:
            count = histogram[n]
            while count:
                if not room:
                    runs.append([])
                    room = per if rounded else count
                take = min(room, count)
                runs[-1].append([n, take])
                room -= take
                count -= take
    sizes, left = [r[0][0] for r in runs], [sum(c for _, c in r) for r in runs]
    lines: list[Line] = []

    def place(use: list[int], times: int) -> None:
        for g in use:
            left[g] -= times
        while times:  # actual lengths for rounded ones, cut where a run ends
            heads = [runs[g][0] for g in use]  # all places of a group in a sequence take from the same run
            m = min(times, *(h[1] // use.count(g) for g, h in zip(use, heads)))
            if m == 0:  # a run with fewer left than places in one sequence: deal that sequence by hand
                m, heads = 1, []
                for g in use:
                    heads.append([runs[g][0][0], 1])
                    runs[g][0][1] -= 1
                    if not runs[g][0][1]:
                        runs[g].pop(0)
            else:
                for g in use:
                    runs[g][0][1] -= m
                for g in set(use):
                    if not runs[g][0][1]:
                        runs[g].pop(0)
            items: dict[int, int] = {}
            for h in heads:
                items[h[0]] = items.get(h[0], 0) + 1
            lines.append((m, tuple(items.items())))
            times -= m

    for times, column in configurations(sizes, left, capacity) if sizes else []:
        place([g for g, k in enumerate(column) for _ in range(k)], times)
    for first in range(len(sizes)):  # what the programme's parts of sequences leave
        while left[first]:
            use = _fullest(sizes, left, first, capacity)
            place(use, min(left[g] // use.count(g) for g in set(use)))
    # Best fit of the small ones, longest first: by room left, whole lines at a time.
    by_room: dict[int, list[Line]] = {}
    rooms: list[int] = []

    def put(line: Line) -> None:
        room = capacity - sum(n * k for n, k in line[1])
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(line)

    for line in lines:
        put(line)
    for n in sorted((n for n in histogram if n <= capacity // large), reverse=True):
        count = histogram[n]
        while count:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                if count // each:
                    put((count // each, ((n, each),)))
                if count % each:
                    put((1, ((n, count % each),)))
                break
            room = rooms[at]
            times, items = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = room // n
            full = min(times, count // each)
            if full:
                put((full, (*items, (n, each))))
                times, count = times - full, count - full * each
            if times and count:  # fewer than a full set left
                put((1, (*items, (n, count))))
                times, count = times - 1, 0
            if times:
                put((times, items))
    return [line for part in by_room.values() for line in part]


#: A normalizer and pre-tokenizers under which the ids of a text are those of its words, one after another.
_WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Bytes of words whose pre-tokens need no more than lower case, one character for one: printable ASCII without the apostrophe,
#: and Latin letters of two bytes but those in _NOT_PLAIN; one that any other byte is in is odd.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KINDS = np.full(256, _ODD, dtype=np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_KINDS[tk.SPACES] = _SPACE
_KINDS[39] = _ODD
_NOT_PLAIN = [int.from_bytes(c.encode(), "big") for c in "\u00d7\u00f7\u0130\u0131\u0149"]
_FOLD = tk.fold_az().astype(np.uint8)


def _byte_characters() -> dict[int, str]:
    """Byte -> the character that stands for it in byte-level vocabularies: printable ones for themselves, the rest are numbered
    from 256 on; the space stays as our separator."""
    own = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)} | {b: chr(b) for b in own} | {32: " "}


def wordwise(path: str) -> bool:
    """Whether the file's tokenizer takes words apart from each other, so that a word's ids do not depend on the text around
    it: its rules are those of _WORDWISE, it neither cuts nor pads, and its special strings hold no white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = all(not t["single_word"] and not t["lstrip"] and not t["rstrip"] and not t["normalized"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return plain and spec["truncation"] is None and spec["padding"] is None and all(spec[k] == v for k, v in _WORDWISE.items())


class _Ids:
    """Ids of whole texts, as the file's tokenizer gives them, special strings included."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], dtype=np.uint32), np.array([len(ids) for ids in got], dtype=np.int64)

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each document's begin, with the end) of a slice of documents."""
        raw = data.tobytes()
        ids, n = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist())])
        return ids, np.concatenate([[0], np.cumsum(n)])


class _WordIds(_Ids):
    """The same, for files that are wordwise(): the tokenizer is asked once for each unit, by 64-bit hash.

    Units are the pre-tokens of plain words, whatever the case of their ASCII letters, and other words whole.  A table of open
    addresses holds the units seen; when it is half full it is emptied.
    """

    BITS = 21

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, pre_tokenizers

        # For plain pre-tokens the file's model alone gives the ids, in a third of the time.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a pre-token
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.characters = _byte_characters()
        self.marks = np.zeros(256, dtype=bool)  # bytes that special strings begin with
        self.marks[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()]] = True
        self.kinds = _KINDS.copy()
        self.kinds[self.marks] = _ODD
        self.clear()

    def pretokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of plain pre-tokens."""
        line = " ".join(units).lower()
        if not line.isascii():
            line = line.encode().decode("latin-1").translate(self.characters)
        ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(units) else self.encode(units)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes at which units start and end, whether they are plain, and their hashes."""
        n = len(data)
        kind = self.kinds[data]
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
        lead = lead[~np.isin(data[lead].astype(np.int64) << 8 | data[lead + 1], _NOT_PLAIN)]
        kind[lead] = kind[lead + 1] = _LETTER
        first = np.zeros(n, dtype=bool)  # words
        first[1:] = kind[:-1] == _SPACE
        first[offsets[:-1][offsets[:-1] < n]] = True
        inside = kind != _SPACE
        first &= inside
        word = np.cumsum(first, dtype=np.int32) - 1
        odd = np.zeros(int(first.sum()) + 1, dtype=bool)
        odd[word[kind == _ODD]] = True
        begins = np.zeros(n, dtype=bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins = inside & (first | ((begins | (kind == _DIGIT)) & ~odd[word]))
        starts = np.flatnonzero(begins)
        last = np.ones(n, dtype=bool)  # bytes that end a unit: what follows begins one, or is a space or another document
        last[:-1] = begins[1:] | ~inside[1:]
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        ends = np.flatnonzero(last & inside) + 1
        low = _FOLD[data]
        if self.marks[data].any():  # special strings are of one case
            raw = np.zeros(len(odd), dtype=bool)
            raw[word[self.marks[data]]] = True
            low = np.where(raw[word], data, low)
        sums, inv = tk.prefix(low)
        return starts, ends, ~odd[word[starts]], np.maximum(tk.span_hashes(sums, inv, starts, ends), np.uint64(1))

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(1 << self.BITS, dtype=np.uint64), np.zeros(1 << self.BITS, dtype=np.uint32), np.zeros(1 << self.BITS, dtype=np.uint32)
        self.ids, self.used, self.known = np.zeros(1 << 16, dtype=np.uint32), 0, 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or the empty one where it would go."""
        slot = (keys >> np.uint64(64 - self.BITS)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
        return slot

    def _learn(self, keys: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.known += len(keys)
        rest = np.arange(len(keys))
        while len(rest):  # of keys that meet in one empty place the last one gets it, the others look again
            slot = self._slots(keys[rest])
            self.keys[slot] = keys[rest]
            won = self.keys[slot] == keys[rest]
            self.at[slot[won]], self.n[slot[won]] = at[rest[won]], n[rest[won]]
            rest = rest[~won]

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, plain, keys = self.units(data, offsets)
        slot = self._slots(keys)
        new = np.flatnonzero(self.keys[slot] == 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            new = new[first]
            if self.known + len(fresh) > 1 << (self.BITS - 1):
                self.clear()
                fresh, new = np.unique(keys, return_index=True)
            raw = data.tobytes()
            for how, some in ((self.pretokens, plain[new]), (self.encode, ~plain[new])):
                at = np.flatnonzero(some)
                for i in range(0, len(at), 1 << (self.BITS - 2)):
                    part = at[i : i + (1 << (self.BITS - 2))]
                    self._learn(fresh[part], *how([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new[part]].tolist(), ends[new[part]].tolist())]))
            slot = self._slots(keys)
        n = self.n[slot].astype(np.int64)
        sums = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[slot] - (sums - n), n) + np.arange(int(n.sum()))] if len(n) else self.ids[:0]
        return ids, np.concatenate([[0], sums])[np.searchsorted(starts, offsets)]


_known: dict[str, _Ids] = {}


def tokenize(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers, the end id last.

    vocabulary: path of a tokenizers file; ids are those of its encode() without added special tokens.  Under a file that is
    wordwise() a word's ids are remembered; under any other whole texts are encoded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _known:
            _known[vocabulary] = (_WordIds if wordwise(vocabulary) else _Ids)(vocabulary)
        known = _known[vocabulary]
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(1)):
                flat, cuts = known.slice(data, offsets)
                doc, piece, start, length, ids = [], [], [], [], []
                for d, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    own = np.append(flat[x:y], np.uint32(end_id)).astype("<u4")
                    for p in range(0, len(own), capacity):
                        cut = own[p : p + capacity]
                        doc.append(first + d)
                        piece.append(p // capacity)
                        start.append(p)
                        length.append(len(cut))
                        ids.append(cut.tobytes())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).cast(pa.int64()).take(pa.array(doc, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids": pa.array(ids, pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length up to capacity, ...) with sequence_id and offset (the place in it).

    pieces is read twice: a column __sl_row that names each row, as stored_pieces() has it, keeps ranks the same whichever
    task is run again; without it pieces is stored once more.  It is not in the result.
    """
    pieces = pieces.drop("sequence_id", "offset")
    if "__sl_row" not in pieces.columns:
        pieces = stored(pieces.withColumn("__sl_row", F.monotonically_increasing_id()), "pieces")
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if any(n > capacity or n < 1 for n in lengths):
        raise ValueError("a piece is longer than a sequence, or empty")
    used: dict[int, int] = {}
    table, base = [], 0
    for times, items in plan_sequences(lengths, capacity):
        offset = 0
        for n, k in items:
            table.append((n, used.get(n, 0), k, base, offset))
            used[n] = used.get(n, 0) + times * k
            offset += n * k
        base += times
    plan = np.array(table, dtype=np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = (plan[:, 0].astype(np.uint64) << np.uint64(48)) + plan[:, 1].astype(np.uint64)
    sent = pieces.sparkSession.sparkContext.broadcast((keys, plan))  # bounded by the capacity, see above

    total = sum(lengths.values())
    buckets = 1 << max(4, (total // PIECES_PER_BUCKET).bit_length())
    dealt = pieces.withColumn("__sl_bucket", F.pmod(F.xxhash64("__sl_row"), F.lit(buckets)))
    counts = dealt.groupBy("length", "__sl_bucket").agg(F.count("*").alias("__sl_n"))
    before = F.coalesce(F.sum("__sl_n").over(Window.partitionBy("length").orderBy("__sl_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("length", "__sl_bucket").orderBy("__sl_row")
    ranked = dealt.withColumn("__sl_rank", F.row_number().over(inside) - 1).join(counts.select("length", "__sl_bucket", before.alias("__sl_before")), ["length", "__sl_bucket"])
    columns = [c for c in pieces.columns if c != "__sl_row"]
    ranked = ranked.select(*columns, (F.col("__sl_before") + F.col("__sl_rank")).cast("long").alias("__sl_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, plan = sent.value
        for b in batches:
            n, rank = b.column("length").to_numpy().astype(np.int64), b.column("__sl_rank").to_numpy()
            at = plan[np.searchsorted(keys, (n.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64), side="right") - 1] if len(n) else plan[:0]
            i = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(at[:, 3] + i // at[:, 2] if len(n) else n), pa.array(at[:, 4] + i % at[:, 2] * n if len(n) else n)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*columns).schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def stored_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """tokenize(), written to the shared folder: the texts are tokenized once, and each piece has a name, __sl_row."""
    return stored(tokenize(docs, vocabulary, capacity, end_id).withColumn("__sl_row", F.monotonically_increasing_id()), "pieces")
