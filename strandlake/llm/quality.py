"""Quality rules by distribution divergence.

A document's character-class and common-word histograms are held against references of its language with the
Jensen-Shannon distance (square root of the divergence, base 2, from 0 to 1).  The references are counted over all
documents: two passes over the text, no sample.  A histogram of few words says nothing: below guard_words no distance is
taken, and a document that passes the base rule is kept.  References go to all tasks in blocks of MAX_LANGUAGES languages, one
pass over the rows for each; a row carries its distances from block to block, so any number of languages is compared.

Defined cases: null or empty text has no words and fails the base rule; a null or unseen language is held against every
reference and takes the nearest; repeated rows are judged alike, each on its own; an empty table gives an empty result;
extra columns are ignored (only the named ones are read).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import _tokens as tk
from strandlake.llm._runtime import dropped, stored

#: Languages of a block of references.
MAX_LANGUAGES = 5_000
#: Character classes by (lead) byte.
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "symbol", "control", "latin", "other2", "wide")


def _class_table() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"))
    out[:32] = CLASSES.index("control")
    out[127] = CLASSES.index("control")
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("stop", b".,;:!?'\"-()"), ("latin", range(0xC2, 0xC6)), ("other2", range(0xC6, 0xE0)), ("wide", range(0xE0, 0x100))):
        out[list(chars)] = CLASSES.index(name)
    out[0x80:0xC0] = -1  # continuation bytes are no characters of their own
    return out


_CLASS = _class_table()
_SYMBOLS = tk.table("#*$%&|<>")
_NEWLINE = tk.table("\n")


@dataclass(frozen=True)
class QualityRules:
    """min_words: below it a document fails; guard_words, which is more: below it no divergence is taken.

    A limit is its constant plus slack / sqrt(words): the distance of an honest short sample is larger by chance.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    guard_words: int = 64
    common_words: int = 100
    max_char_distance: float = 0.17
    max_word_distance: float = 0.39
    char_slack: float = 0.6
    word_slack: float = 0.8


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of the rows of p from the rows of q: (len(p), len(q))."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = q / np.maximum(q.sum(-1, keepdims=True), 1)
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip(terms.sum(-1) / 2, 0, 1))


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    kinds = _CLASS[data]
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    real = kinds >= 0
    k = len(CLASSES)
    return np.bincount(docs[real] * k + kinds[real], minlength=k * (len(offsets) - 1)).reshape(-1, k)


def _repeats(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each (document, hash) stands there twice or more."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        order = np.lexsort((hashes, docs))
        d, h = docs[order], hashes[order]
        same = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
        out[order[1:]] |= same
        out[order[:-1]] |= same
    return out


def base_metrics(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], tk.Words]:
    """The exact counts of every document of a slice."""
    w = tk.words(data, offsets)
    n_docs = len(offsets) - 1
    n_words = np.diff(w.bounds)
    lead = (data & 0xC0) != 0x80
    out = {"n_words": n_words, "word_chars": tk.per_doc(lead & ~tk.SPACES[data], offsets), "n_symbols": tk.per_doc(_SYMBOLS[data], offsets)}
    docs = w.docs
    # Lines: from each document's start or a newline to the next newline or the document's end.
    breaks = np.flatnonzero(_NEWLINE[data])
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    doc_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    line_docs = np.sort(np.concatenate([np.arange(n_docs), doc_of_break]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    sums, inv = tk.prefix(data)
    with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, line_docs = starts[with_word], ends[with_word], line_docs[with_word]
    hashes = tk.span_hashes(sums, inv, starts, ends)
    order = np.lexsort((hashes, line_docs))
    d, h = line_docs[order], hashes[order]
    again = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    out["n_dup_lines"] = np.bincount(d[1:][again], minlength=n_docs)
    windows = tk.grams(w.hashes, 3)
    whole = docs[: len(windows)] == docs[2:] if len(windows) else np.zeros(0, dtype=bool)
    flagged = np.zeros(len(w.hashes), dtype=bool)
    at = np.flatnonzero(whole)
    flagged[at] = _repeats(docs[at], windows[at])
    covered = flagged.copy()
    covered[1:] |= flagged[:-1]
    covered[2:] |= flagged[:-2]
    out["n_repeat_words"] = np.bincount(docs[covered], minlength=n_docs)
    return out, w


@dataclass
class References:
    """What is known of each language: class counts, its common words' hashes and counts, with all other words last."""

    langs: list[str]
    chars: np.ndarray
    hashes: np.ndarray
    words: np.ndarray


def language_counts(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """lang, classes (counts by class, with all words last) and common (hashes and counts of the common words), counted over every
    document with a language; a stored table of a line for each language."""
    k = len(CLASSES)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(h), pa.string()), "kind": pa.array(np.ones(len(h), dtype=np.int32)), "code": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int64))})
            held.clear()

        for b in batches:
            langs = np.array([*b.column(1).to_pylist(), None], dtype=object)[:-1]
            for first, end, data, offsets in tk.slices(b.column(0)):
                here = langs[first:end]
                c = class_counts(data, offsets)
                w = tk.words(data, offsets, tk.LOOSE, tk.fold_az())
                owner = w.docs
                for lang in set(here) - {None}:
                    of = here == lang
                    mine = of[owner]
                    totals[lang] = totals.get(lang, np.zeros(k + 1, dtype=np.int64)) + np.append(c[of].sum(0), mine.sum())
                    held.setdefault(lang, []).append(w.hashes[mine])
                size += len(w.hashes)
                if size > 4_000_000:
                    yield from flush()
                    size = 0
        yield from flush()
        for lang, c in totals.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (k + 1), pa.string()), "kind": pa.array(np.zeros(k + 1, dtype=np.int32)), "code": pa.array(np.arange(k + 1)), "n": pa.array(c)})

    counted = docs.select("text", "lang").mapInArrow(counts, "lang string, kind int, code long, n long").groupBy("lang", "kind", "code").agg(F.sum("n").alias("n"))
    counted = stored(counted, "language-counts")
    words = counted.filter("kind = 1")
    # The commonest in each of 64 parts of a language's words, then of these: no task gets all words of a language.
    part = Window.partitionBy("lang", F.pmod("code", F.lit(64))).orderBy(F.desc("n"), "code")
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    for w in (part, place):
        words = words.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= rules.common_words).drop("place")
    common = words.groupBy("lang").agg(F.collect_list(F.struct("code", "n")).alias("common"))
    classes = counted.filter("kind = 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: x.n).alias("classes"))
    out = stored(classes.join(common, "lang", "left"), "language-references")
    dropped(counted)
    return out


def language_references(counted: DataFrame, rules: QualityRules, block: int = 0, blocks: int = 1) -> References:
    """One block of the languages: block of blocks by hash."""
    k = len(CLASSES)
    rows = sorted(counted.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == block).collect(), key=lambda r: r.lang)
    out = References([r.lang for r in rows], np.zeros((len(rows), k)), np.zeros((len(rows), rules.common_words), dtype=np.uint64), np.zeros((len(rows), rules.common_words + 1)))
    for i, r in enumerate(rows):
        out.chars[i] = r.classes[:k]
        common = sorted((np.uint64(x.code & (2**64 - 1)), x.n) for x in r.common or [])
        out.hashes[i, : len(common)] = [h for h, _ in common]
        out.words[i, : len(common)] = [n for _, n in common]
        out.words[i, -1] = r.classes[k] - out.words[i].sum()
    return out


def divergences(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, refs: References, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character and word distances of each document that is not done, and whether they are from its own language; else they are
    from the nearest by words, and not a number without references."""
    n = len(offsets) - 1
    w = tk.words(data, offsets, tk.LOOSE, tk.fold_az())
    docs, total, classes = w.docs, np.diff(w.bounds), class_counts(data, offsets)
    chars, by_word = np.full(n, np.nan), np.full(n, np.nan)
    place = {x: i for i, x in enumerate(refs.langs)}
    own = np.array([x in place for x in langs], dtype=bool)
    for i in range(len(refs.langs)) if (~own & ~done).any() else sorted({place[x] for x in langs[~done]}):
        mine = ~done & (~own | (langs == refs.langs[i]))
        rows = np.flatnonzero(mine)
        if not len(rows):
            continue
        known = refs.hashes[i][refs.words[i, :-1] > 0]
        width = len(known) + 1
        some = mine[docs]
        owner, hashes = np.searchsorted(rows, docs[some]), w.hashes[some]
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
        counts = np.bincount(owner[hit] * width + at[hit], minlength=len(rows) * width).reshape(len(rows), width).astype(float)
        counts[:, -1] = total[rows] - counts.sum(1)
        far = js_distance(counts, np.append(refs.words[i, :-1][refs.words[i, :-1] > 0], refs.words[i, -1])[None, :])[:, 0]
        nearer = ~(far >= by_word[rows])
        by_word[rows[nearer]] = far[nearer]
        chars[rows[nearer]] = js_distance(classes[rows[nearer]], refs.chars[i : i + 1])[:, 0]
    return chars, by_word, own & ~done


_JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"
_CARRIED = "doc_id long, text string, lang string, chars double, words double, own boolean"


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), counted: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """One row per document: the base counts, the two distances (null below the guard) and the verdict. counted: references
    of other documents, from language_counts()."""
    counted = language_counts(docs, rules) if counted is None else counted
    blocks = max(1, -(-counted.count() // (block or MAX_LANGUAGES)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", *(F.lit(None).cast("double").alias(c) for c in ("chars", "words")), F.lit(False).alias("own"))
    for i in range(blocks):
        sent = docs.sparkSession.sparkContext.broadcast(language_references(counted, rules, i, blocks))

        def judge(batches: Iterator[pa.RecordBatch], sent=sent, last=i == blocks - 1) -> Iterator[pa.RecordBatch]:
            refs = sent.value
            for b in batches:
                for first, end, data, offsets in tk.slices(b.column(1)):
                    part = b.slice(first, end - first)
                    langs = np.array([*part.column(2).to_pylist(), None], dtype=object)[:-1]
                    chars, by_word, done = (part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5))
                    c, d, own = divergences(data, offsets, langs, refs, done)
                    take = own | (~done & ~np.isnan(d) & ~(d >= by_word))
                    chars, by_word = np.where(take, c, chars), np.where(take, d, by_word)
                    if not last:
                        carried = [pa.array(x, mask=np.isnan(x)) for x in (chars, by_word)]
                        yield pa.RecordBatch.from_arrays([*part.columns[:3], *carried, pa.array(done | own)], [f.split()[0] for f in _CARRIED.split(", ")])
                        continue
                    m, _ = base_metrics(data, offsets)
                    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"])
                    short = (m["n_words"] < rules.guard_words) | np.isnan(by_word)
                    root = np.sqrt(np.maximum(m["n_words"], 1))
                    far = ~short & ((chars > rules.max_char_distance + rules.char_slack / root) | (by_word > rules.max_word_distance + rules.word_slack / root))
                    out = {"doc_id": part.column(0)} | {k: pa.array(v.astype(np.int64)) for k, v in m.items()}
                    out |= {"base_failed": pa.array(failed), "char_distance": pa.array(chars, mask=short), "word_distance": pa.array(by_word, mask=short), "kept": pa.array(~failed & ~far)}
                    yield pa.RecordBatch.from_pydict(out)

        rows = rows.mapInArrow(judge, _JUDGED if i == blocks - 1 else _CARRIED)
        if i < blocks - 1 and i % 4 == 3:  # no long chains of Python workers
            rows = stored(rows, "quality")
    return rows
