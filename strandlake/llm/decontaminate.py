"""Benchmark decontamination by spaced seeds.

Fixed masks pick some of the words of a window and leave out others, so a window still hashes alike when a left-out word was
substituted.  The seed hashes of documents are joined with those of benchmark items; for each document and item that meet,
the two texts are laid side by side on every diagonal that a common seed names, and the run with most equal words, of those
with few enough substitutions, is measured; only that verified overlap counts.

The masks lose nothing: an overlap of 26 equal words and more that keeps the rule has a part of 13 to 25 that keeps it, and
every such part, whatever its substitutions, holds one of MASKS; the same goes for items of 5 to 15 words and SHORT_MASKS.
missed() proves it.  Items of fewer words admit no substitution and are one seed each.

Documents are read once, whatever the benchmark's size: a bit table of its seeds (32 MB at most) goes to all tasks, and only
seeds that it knows are joined, each with its places as one list, so a word that repeats a thousand times is one row.  Places
are multiplied out in blocks, into one bit for each diagonal, and diagonals that look alike are measured once.

Defined cases: null or empty text is clean; null or empty items match nothing; items without an id are searched like others,
their item_id is null; repeated items count once each; a document is judged by its text alone, so repeated rows and rows of
one id with other texts each have their own verdict; an empty benchmark leaves everything clean; an empty table gives an
empty result; extra columns are not read by find_overlaps() and pass through drop_contaminated().
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import _tokens as tk
from strandlake.llm._runtime import lookup_rows, split_by_ids, stored

#: 1: the word counts, 0: it may differ.
MASKS = ("1101000111", "10110111", "11111001", "11001111", "1111101", "11010111")
#: For items of 5 words and more that are too short for min_match.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: Bits of the seed table for each seed, most bits (as a power of two), and bits that a seed sets.
BITS_PER_SEED, MOST_BITS, PROBES, TABLE_SLICES = 64, 28, 5, 16
#: Cells of places multiplied out, or of words compared, at once.
CELLS = 1 << 20
#: Items whose words a task remembers.
ITEMS_HELD = 4_096


@dataclass(frozen=True)
class Overlap:
    """An overlap counts with min_match equal words (or min_share of a shorter item) and at most max_subst of it substituted.

    The masks are lossless for these values; others want missed() to be asked.
    """

    min_match: int = 13
    min_share: float = 0.8
    max_subst: float = 0.25
    masks: tuple[str, ...] = MASKS
    short_masks: tuple[str, ...] = SHORT_MASKS

    def need(self, words: int) -> int:
        """Equal words wanted of an item."""
        return min(self.min_match, ceil(Fraction(self.min_share).limit_denominator(10_000) * words))

    def masks_for(self, words: int) -> tuple[str, ...]:
        whole = self.need(words) == words or words < 5
        return () if not words else ("1" * words,) if whole else self.short_masks if self.need(words) < self.min_match else self.masks


def missed(masks: tuple[str, ...], least: int, most: int, share: float, length: int | None = None) -> str | None:
    """An overlap (1: equal, 0: substituted) of least to most equal words, substituted by `share` at most and of `length` at
    most, that holds none of the masks; None if there is none.  Walks all overlaps by their last words."""
    bits = [(len(m), int(m, 2)) for m in masks]
    tail = (1 << (max(map(len, masks)) - 1)) - 1
    zeros = lambda ones: int(Fraction(share).limit_denominator(10_000) / (1 - Fraction(share).limit_denominator(10_000)) * ones)
    seen: dict[tuple[int, int, int], str] = {(1, 1, 0): "1"}
    front = list(seen)
    while front:
        after = []
        for last, ones, out in front:
            text = seen[last, ones, out]
            if ones >= least and out <= zeros(ones) and text.endswith("1"):
                return text
            for bit in (1, 0):
                state = (last << 1 | bit) & (tail << 1 | 1)
                if ones + bit > most or out + 1 - bit > zeros(most) or len(text) + 1 > (length or 1 << 30):
                    continue
                if any(len(text) + 1 >= n and state & m == m for n, m in bits):
                    continue
                key = (state & tail, ones + bit, out + 1 - bit)
                if key not in seen:
                    seen[key] = text + str(bit)
                    after.append(key)
        front = after
    return None


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Seed hashes at each place that has the mask's words after it."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), np.uint64(int(mask, 2)), dtype=np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1" and n > 0:  # words' hashes are mixed already, so their polynomial needs no mixing
            out *= tk._Q
            out += hashes[j : j + n]
    return out


def _probes(hashes: np.ndarray, bits: int, j: int) -> np.ndarray:
    place = hashes + np.uint64(j) * (hashes >> np.uint64(32) | np.uint64(1)) if j else hashes
    return (place & np.uint64((1 << bits) - 1)).view(np.int64)


def known_seeds(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the bit table."""
    bits = int(len(table) * 8).bit_length() - 1
    at: np.ndarray | slice = slice(None)
    for j in range(PROBES):
        p = _probes(hashes[at], bits, j)
        hit = np.flatnonzero(table[p >> 3] >> (p & 7).astype(np.uint8) & 1)
        at = hit if j == 0 else at[hit]
    return at


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, dtype=np.int32)]).astype(np.int32)))


def _by_seed(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct hashes and the places of each."""
    order = np.lexsort((places, hashes))
    hashes, places = hashes[order], places[order]
    cuts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, dtype=np.int64)
    return hashes[cuts], np.split(places, cuts[1:]) if len(cuts) else []


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, text): item names the text."""
    return benchmark.select(F.md5("text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")


def _seeds(items: DataFrame, rule: Overlap) -> DataFrame:
    """(h, item, places, mask) of distinct items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            for first, _, data, offsets in tk.slices(b.column(1), lower=True):
                w = tk.words(data, offsets, tk.LOOSE)
                h, item, at, masks = [], [], [], []
                for i, (x, y) in enumerate(zip(w.bounds, w.bounds[1:])):
                    for mask in rule.masks_for(int(y - x)):
                        seeds = masked(w.hashes[x:y], mask)
                        keys, places = _by_seed(seeds, np.arange(len(seeds)))
                        h.append(keys)
                        at += places
                        item += [names[first + i]] * len(keys)
                        masks += [mask] * len(keys)
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate([*h, np.zeros(0, dtype=np.uint64)]).view(np.int64)), "item": pa.array(item, pa.string()), "places": _lists(at), "mask": pa.array(masks, pa.string())})

    return items.select("item", "text").mapInArrow(run, "h long, item string, places array<int>, mask string")


def _table(seeds: DataFrame, n: int) -> np.ndarray:
    """The bit table of all seeds; its size follows their number up to 2^MOST_BITS bits."""
    bits = min(MOST_BITS, max(20, (BITS_PER_SEED * max(n, 1) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for j in range(PROBES):
                p = _probes(h, bits, j)
                np.bitwise_or.at(out, p >> 3, (1 << (p & 7)).astype(np.uint8))
        parts = out.reshape(TABLE_SLICES, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(TABLE_SLICES), pa.int32()), "bits": pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())})

    def fold(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 << (bits - 3)) // TABLE_SLICES, dtype=np.uint8)
        for b in batches:
            for x in b.column("bits"):
                out |= np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.tobytes()], pa.binary())})

    got = seeds.select("h").mapInArrow(run, "part int, bits binary").groupBy("part").applyInArrow(fold, "part int, bits binary").collect()
    table = np.zeros((TABLE_SLICES, (1 << (bits - 3)) // TABLE_SLICES), dtype=np.uint8)
    for r in got:
        table[r["part"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return table.reshape(-1)


def _probe(docs: DataFrame, table: np.ndarray, masks: list[str]) -> DataFrame:
    """Of each text that may hold a seed: (key, h, places) of each such seed, and (key, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(0), lower=True):
                w = tk.words(data, offsets, tk.LOOSE)
                owner = w.docs
                room = w.bounds[owner + 1] - np.arange(len(owner))
                found = []
                for mask in masks:
                    h = masked(w.hashes, mask)
                    at = known_seeds(table, h)
                    at = at[room[at] >= len(mask)]
                    found.append((h[at], at))
                h, at = (np.concatenate([f[j] for f in found]) for j in (0, 1))
                order = np.argsort(owner[at], kind="stable")
                h, at = h[order], at[order]
                docs_of = owner[at]
                key, seed, places, texts = [], [], [], []
                for d in np.unique(docs_of):
                    x, y = np.searchsorted(docs_of, [d, d + 1])
                    text = b.column(0)[first + int(d)].as_py()
                    name = hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
                    keys, lists = _by_seed(h[x:y], at[x:y] - w.bounds[d])
                    seed += [*keys.view(np.int64).tolist(), None]
                    places += [*lists, np.zeros(0, dtype=np.int64)]
                    key += [name] * (len(keys) + 1)
                    texts += [None] * len(keys) + [text]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.string()), "h": pa.array(seed, pa.int64()), "places": _lists(places), "text": pa.array(texts, pa.string())})

    return docs.select("text").filter("text is not null").mapInArrow(run, "key string, h long, places array<int>, text string")


def diagonals(hits: list[tuple[np.ndarray, np.ndarray]], words: int, items: int) -> np.ndarray:
    """Distinct differences of places in the document and in the item, ascending."""
    marks = np.zeros(words + items + 1, dtype=bool)
    for there, here in hits:
        step = max(1, CELLS // len(here))
        for i in range(0, len(there), step):
            marks[np.subtract.outer(there[i : i + step], here).ravel() + items] = True
    return np.flatnonzero(marks) - items


def best_run(same: np.ndarray, rule: Overlap) -> tuple[int, int, int, int]:
    """(equal words, substituted words, first, end) of the run with most equal words that is substituted by max_subst at most:
    to every end belongs the earliest start from which the share holds."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0, 0, 0, 0
    share = Fraction(rule.max_subst).limit_denominator(10_000)
    score = np.concatenate([[0], np.cumsum(np.where(same, share.numerator, share.numerator - share.denominator))])
    equal = np.concatenate([[0], np.cumsum(same)])
    ends = at + 1  # a run starts and ends with an equal word
    starts = np.searchsorted(-np.minimum.accumulate(score), -score[ends])
    starts = at[equal[starts]]
    n = equal[ends] - equal[starts]
    other = ends - starts - n
    i = np.lexsort((starts, other, -n))[0]
    return int(n[i]), int(other[i]), int(starts[i]), int(ends[i])


def best_overlap(doc: np.ndarray, item: np.ndarray, lines: np.ndarray, rule: Overlap) -> tuple[int, int, int, int] | None:
    """(equal, substituted, first word, end word) of the best run on these diagonals, the first of equals; None if none counts."""
    need, best = rule.need(len(item)), None
    for i in range(0, len(lines), max(1, CELLS // len(item))):
        part = lines[i : i + max(1, CELLS // len(item))]
        at = part[:, None] + np.arange(len(item))
        same = (doc[np.clip(at, 0, len(doc) - 1)] == item) & (at >= 0) & (at < len(doc))
        good = same.sum(1) >= need
        part, same = part[good], same[good]
        if not len(part):
            continue
        packed = np.ascontiguousarray(np.packbits(same, axis=1))
        for j in np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_index=True)[1]:  # the first diagonal that looks so
            n, other, first, end = best_run(same[j], rule)
            got = (-n, other, int(part[j]) + first, int(part[j]) + end)
            if n >= need and (best is None or got < best):
                best = got
    return None if best is None else (-best[0], *best[1:])


def _verify(rows: DataFrame, rule: Overlap) -> DataFrame:
    """rows: (key, item, text, hits) by key, a document (item null) before the items it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, doc = None, np.zeros(0, dtype=np.uint64)
        for b in batches:
            keys, items, hits = (b.column(c).to_pylist() for c in (0, 1, 3))
            out = []
            for first, _, data, offsets in tk.slices(b.column(2), lower=True):
                w = tk.words(data, offsets, tk.LOOSE)
                for i, (x, y) in enumerate(zip(w.bounds, w.bounds[1:]), first):
                    if items[i] is None:
                        now, doc = keys[i], w.hashes[x:y].copy()
                    elif now == keys[i]:
                        pairs = [(np.array(p["there"]), np.array(p["here"])) for p in hits[i]]
                        got = best_overlap(doc, w.hashes[x:y], diagonals(pairs, len(doc), int(y - x)), rule)
                        if got:
                            out.append((keys[i], items[i], *got))
            names = ("key", "item", "matched", "substituted", "first_word", "end_word")
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.string() if j < 2 else pa.int32()) for j in range(6)], names)

    return rows.mapInArrow(run, "key string, item string, matched int, substituted int, first_word int, end_word int")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap()) -> DataFrame:
    """key (md5 of the text) and overlaps (array of the verified ones, by item) of every distinct text with any; a stored table."""
    named = _items(benchmark)
    items = stored(named.select("item", "text").dropDuplicates(["item"]), "overlap-items")
    seeds = stored(_seeds(items, rule), "overlap-seeds")
    used = {r["mask"]: r["n"] for r in seeds.groupBy("mask").agg(F.count("*").alias("n")).collect()}  # fourteen kinds at most
    probes = stored(_probe(docs, _table(seeds, sum(used.values())), sorted(used)), "overlap-probes") if used else docs.sparkSession.createDataFrame([], "key string, h long, places array<int>, text string")
    pairs = probes.filter("h is not null").select("key", "h", F.col("places").alias("there")).dropDuplicates(["key", "h"]).join(seeds.select("h", "item", F.col("places").alias("here")), "h")
    pairs = stored(pairs.groupBy("key", "item").agg(F.collect_list(F.struct("there", "here")).alias("hits")), "overlap-pairs")
    texts = probes.filter("text is not null").select("key", "text").join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    none = F.lit(None)
    both = texts.select("key", none.cast("string").alias("item"), "text", none.cast("array<struct<there:array<int>,here:array<int>>>").alias("hits"))
    both = both.unionByName(pairs.join(items, "item").select("key", "item", "text", "hits"))
    found = _verify(both.repartition("key").sortWithinPartitions("key", F.col("item").asc_nulls_first()), rule)
    ids = named.select("item", "item_id").distinct()
    overlap = F.struct("item_id", "matched", "substituted", "first_word", "end_word")
    return stored(found.join(ids, "item").groupBy("key").agg(F.array_sort(F.collect_list(overlap)).alias("overlaps")), "overlaps")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap()) -> DataFrame:
    """One row per document: doc_id, contaminated, overlaps (array of the verified ones, by item)."""
    found = contaminated_texts(docs, benchmark, rule)
    out = lookup_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("key")), found, "key")
    empty = F.array().cast("array<struct<item_id:bigint,matched:int,substituted:int,first_word:int,end_word:int>>")
    return out.select("doc_id", F.col("overlaps").isNotNull().alias("contaminated"), F.coalesce("overlaps", empty).alias("overlaps"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: Overlap = Overlap()) -> DataFrame:
    """The rows of docs whose text has no verified overlap with the benchmark."""
    found = contaminated_texts(docs, benchmark, rule).select(F.col("key").alias("__sl_key"))
    named = docs.withColumn("__sl_key", F.md5("text"))
    maybe, clean = split_by_ids(named, found, "__sl_key")
    kept = lookup_rows(maybe, found.withColumn("__sl_bad", F.lit(True)), "__sl_key").filter("__sl_bad is null")
    return clean.select(*docs.columns).unionByName(kept.select(*docs.columns))
