"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams in order of frequency; a document is given the language whose
profile is least out of place with the document's own ranking: each of its top n-grams adds the difference of ranks, or
the profile's length where the profile lacks it.

Profiles go to all tasks in blocks of MAX_LANGUAGES languages, one pass over the rows for each; a row carries its best
language from block to block, so any number of languages is compared.

Defined cases: null text or text without a letter (marks alone are none) is "und" with score 0; ties of counts are ranked
by code, ties of distance by language name; repeated rows are predicted alike; an empty table gives an empty result, and
without any training text every document is "und"; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm._runtime import stored

UNKNOWN = "und"
_BITS = 21  # of a code point; three make a key of 63 bits
#: Languages of a block of profiles.
MAX_LANGUAGES = 5_000


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> lower-cased letter or mark, or a space (marks stay, so that words of any script are whole); and whether it
    is a letter."""
    import sys
    import unicodedata

    out, letter = np.full(sys.maxunicode + 2, 32, dtype=np.int64), np.zeros(sys.maxunicode + 2, dtype=bool)
    for c in range(sys.maxunicode + 1):
        if (kind := unicodedata.category(x := chr(c))[0]) in "LM":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
            letter[c] = kind == "L"
    return out, letter


_cache: list[tuple[np.ndarray, np.ndarray]] = []


def letters(text: str) -> np.ndarray:
    """Letters and marks of a text, lower-cased, with runs of all else as one space, and a space at either end; only that if
    there is no letter."""
    if not _cache:
        _cache.append(_letters())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.concatenate([[32], _cache[0][0][raw], [32]]) if _cache[0][1][raw].any() else np.array([32, 32])
    space = codes == 32
    return codes[~(space & np.concatenate([[False], space[:-1]]))]


def ngrams(codes: np.ndarray, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the n-grams of up to 3 letters; a lone space is none."""
    alphabet, small = np.unique(codes, return_inverse=True)
    a = len(alphabet)
    keys, counts = [], []
    value = np.zeros(len(codes), dtype=np.int64)
    for n in range(1, longest + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        value = value[:m] * a + small[n - 1 :]
        if a**n <= 4 * len(codes) + 70_000:
            c = np.bincount(value, minlength=0)
            v = np.flatnonzero(c)
            c = c[v]
        else:
            v, c = np.unique(value, return_counts=True)
        key = np.zeros(len(v), dtype=np.int64)
        for j in range(n):
            key = (key << _BITS) | alphabet[v // a ** (n - 1 - j) % a]
        keys.append(key)
        counts.append(c)
    key, count = np.concatenate(keys), np.concatenate(counts)
    real = key != 32
    return key[real], count[real]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_profiles(docs: DataFrame, size: int = 400) -> DataFrame:
    """lang and grams, its size most frequent n-grams in order, counted over all of docs (text, lang) with a language; stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting = 0

        def merged(parts):
            k, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return k, np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def emit():
            for lang, parts in held.items():
                k, c = merged(parts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "gram": pa.array(k), "n": pa.array(c)})

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                codes = letters(text or "")
                if lang is None or len(codes) < 3:
                    continue
                held.setdefault(lang, []).append(ngrams(codes))
                waiting += len(held[lang][-1][0])
                if waiting > 2_000_000:
                    held = {x: [merged(p)] for x, p in held.items()}
                    waiting = 0
                    if sum(len(p[0][0]) for p in held.values()) > 2_000_000:
                        yield from emit()
                        held = {}
        yield from emit()

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The most frequent in each of 16 parts of a language's n-grams, then of these.
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(16))).orderBy(F.desc("n"), "gram")
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    for w in (part, place):
        counted = counted.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= size)
    return stored(counted.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x.gram).alias("grams")), "profiles")


class Profiles:
    """A block of profiles, as ranks of the n-grams that any of them has."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.langs = size, sorted(profiles)
        self.known = np.unique(np.array([g for x in self.langs for g in profiles[x]], dtype=np.int64))
        self.ranks = np.full((len(self.known) + 1, max(len(self.langs), 1)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.known, np.array(profiles[lang], dtype=np.int64)), j] = np.arange(len(profiles[lang]))

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 if all is in place, 0 if nothing is in common."""
        codes = letters(text or "")
        if len(codes) < 3 or not self.langs:
            return UNKNOWN, 0.0
        key, count = ngrams(codes)
        if len(key) > self.size:  # the top ones, with all that tie with the last, before the exact order is made
            least = np.partition(count, len(count) - self.size)[len(count) - self.size]
            key, count = key[count >= least], count[count >= least]
        top = key[np.lexsort((key, -count))][: self.size]
        at = np.minimum(np.searchsorted(self.known, top), len(self.known) - 1)
        theirs = np.where((self.known[at] == top)[:, None], self.ranks[at], -1)
        off = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(top))[:, None]))
        total = np.minimum(off, self.size).sum(0)
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (self.size * len(top)))


def predict_languages(docs: DataFrame, profiles: DataFrame, size: int = 400, block: int | None = None) -> DataFrame:
    """doc_id, lang_pred and score (1: in place throughout, 0: nothing in common) of every row of docs (doc_id, text)."""
    blocks = max(1, -(-profiles.count() // (block or MAX_LANGUAGES)))
    part = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    schema = "doc_id long, lang_pred string, score double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    for i in range(blocks):
        known = Profiles({r.lang: r.grams for r in profiles.filter(part == i).collect()}, size)
        sent = docs.sparkSession.sparkContext.broadcast(known)

        def predict(batches: Iterator[pa.RecordBatch], sent=sent, last=i == blocks - 1) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [sent.value.nearest(t) for t in b.column(1).to_pylist()]
                if blocks > 1:  # the best so far, by score, then by name; a language before none
                    found = [min(f, g, key=lambda x: (x[0] == UNKNOWN, -x[1], x[0])) for f, g in zip(found, zip(b.column(2).to_pylist(), b.column(3).to_pylist()))]
                out = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(0), *([] if last else [b.column(1)]), *out], ["doc_id", *([] if last else ["text"]), "lang_pred", "score"])

        rows = rows.mapInArrow(predict, schema if i == blocks - 1 else schema.replace("long,", "long, text string,"))
        if i < blocks - 1 and i % 4 == 3:  # no long chains of Python workers
            rows = stored(rows, "languages")
    return rows
