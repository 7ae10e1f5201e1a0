"""Toxicity by a classifier chain: categories are predicted one after another, each by a linear model that also gets the
probabilities of the categories before it; in training these are out-of-fold predictions, as a model's view of its own
training rows is too good.

Features are the presence of hashed words; each model keeps those that tell its category best, by their counts over its
training rows.  The counts are summed in Spark, and only the features that some model keeps, N_FEATURES for each, come back
with the rows, so what reaches the driver is bounded whatever the texts' lengths.  Training takes a bounded sample of labelled
rows (max_train, by hash of the id), all else covers every row.

Defined cases: null or empty text has no features and gets the models' intercepts; rows whose label is null are not
trained on; a document whose labels contradict each other is in a category if one of them says so; of rows that repeat an id
one is trained on, that with the smallest hash of its text; repeated rows are scored alike, each by its own text; with no
labelled rows, or one class only, a category's probability is its base rate (0 without labels) and nothing is flagged; an
empty table gives an empty result; extra columns are not read by score_chain() and pass through drop_flagged().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import _tokens as tk
from strandlake.llm._runtime import dropped, stored

BITS = 22
#: Bytes of the word beginnings that are features of their own.
PREFIXES = (4, 6)
#: Labelled rows trained on, at most; folds of the out-of-fold predictions; features of a model.
MAX_TRAIN, FOLDS, N_FEATURES = 6_000, 3, 300


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed word or word beginning) of a slice of lower-cased texts, each once; sorted by document."""
    w = tk.words(data, offsets, tk.LOOSE)
    sums, inv = tk.prefix(data)
    docs, hashes = [w.docs], [w.hashes]
    for n in PREFIXES:  # beginnings of longer words: compounds of a stem share them
        long = w.ends - w.starts > n
        docs.append(w.docs[long])
        hashes.append(tk.mix(tk.span_hashes(sums, inv, w.starts[long], w.starts[long] + n) + np.uint64(n)))
    pairs = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(BITS)) | (np.concatenate(hashes) >> np.uint64(64 - BITS)))
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Model:
    """keys: sorted hashed words; weights: theirs, then those of the earlier categories' log-odds; bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray, keys: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        out = np.full(n, self.bias) + earlier @ self.weights[len(self.keys) :]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            out += np.bincount(rows[hit], weights=self.weights[at[hit]], minlength=n)
        return out


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Model] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def predict(self, rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        earlier = np.zeros((n, 0))
        for m in self.models:
            earlier = np.column_stack([earlier, np.clip(m.logits(rows, keys, n, earlier), -8, 8)])
        return _sigmoid(earlier)


def _chi(there: np.ndarray, positive: np.ndarray, n: int, total: float) -> np.ndarray:
    """How well features in `there` of n rows, `positive` of the category's `total`, tell it; 0 for those of one or two rows."""
    expect = there * (total / n)
    return np.where(there >= 3, (positive - expect) ** 2 / np.maximum(expect * (1 - there / n * 0.999), 1e-9), 0)


def _fit(rows: np.ndarray, keys: np.ndarray, y: np.ndarray, earlier: np.ndarray, n_features: int, l2: float = 1.0) -> Model:
    n = len(y)
    if not 0 < y.sum() < n:
        p = np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6)
        return Model(np.zeros(0, dtype=np.int32), np.zeros(earlier.shape[1]), float(np.log(p / (1 - p))))
    known, at = np.unique(keys, return_inverse=True)
    there = np.bincount(at, minlength=len(known)).astype(float)
    chi = _chi(there, np.bincount(at, weights=y[rows], minlength=len(known)), n, float(y.sum()))
    best = np.sort(np.argsort(-chi, kind="stable")[: min(n_features, int((chi > 0).sum()))])
    x = np.zeros((n, len(best) + earlier.shape[1]), dtype=np.float32)
    place = np.full(len(known), -1)
    place[best] = np.arange(len(best))
    col = place[at]
    x[rows[col >= 0], col[col >= 0]] = 1
    x[:, len(best) :] = earlier
    weight = np.where(y > 0, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    weight, y = weight.astype(np.float32), y.astype(np.float32)  # one precision throughout: x is never copied
    w, b = np.zeros(x.shape[1], dtype=np.float32), np.float32(0)
    vw, vb = w.copy(), b
    # Accelerated gradient descent; the step comes from the largest singular value by power iteration.
    v = np.ones(x.shape[1], dtype=np.float32) / np.sqrt(max(x.shape[1], 1))
    for _ in range(12):
        u = x.T @ (x @ v)
        v = u / max(float(np.linalg.norm(u)), 1e-9)
    step = 1 / (0.25 * weight.max() * (float(np.linalg.norm(x @ v)) ** 2 + n) + l2)
    step, l2 = np.float32(step), np.float32(l2)
    for i in range(150):
        g = weight * (_sigmoid(x @ vw + vb) - y)
        nw, nb = vw - step * (g @ x + l2 * vw), vb - step * g.sum()
        ahead = np.float32(i / (i + 3))
        vw, vb = nw + ahead * (nw - w), nb + ahead * (nb - b)
        w, b = nw, nb
    return Model(known[best].astype(np.int32), w.astype(float), float(b))


def _threshold(y: np.ndarray, z: np.ndarray) -> float:
    """The log-odds, between two neighbouring scores, with the best F1; the widest gap among equals."""
    order = np.argsort(-z, kind="stable")
    s, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    gap = np.append(s[:-1] - s[1:], 1.0)
    f1[gap <= 0] = -1
    best = max(np.flatnonzero(f1 >= f1.max() - 1e-12), key=lambda i: gap[i])
    return float(s[best] - gap[best] / 2)


def fit_chain(rows: np.ndarray, keys: np.ndarray, labels: np.ndarray, fold: np.ndarray, categories: tuple[str, ...], folds: int = FOLDS, n_features: int = N_FEATURES) -> Chain:
    """labels: (documents, categories) of 0 and 1; fold: of each document. rows, keys: presence of hashed words, sorted by row."""
    chain, n = Chain(categories), len(labels)
    earlier = np.zeros((n, 0))
    for c in range(len(categories)):
        y, out = labels[:, c].astype(float), np.zeros(n)
        for f in range(folds):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            new = np.full(n, -1)
            new[train] = np.arange(len(train))
            mine = new[rows] >= 0
            m = _fit(new[rows[mine]], keys[mine], y[train], earlier[train], n_features) if len(train) else Model(keys[:0], np.zeros(earlier.shape[1]), 0.0)
            new[:] = -1
            new[test] = np.arange(len(test))
            mine = new[rows] >= 0
            out[test] = m.logits(new[rows[mine]], keys[mine], len(test), earlier[test])
        chain.models.append(_fit(rows, keys, y, earlier, n_features))
        chain.thresholds.append(_threshold(y, np.clip(out, -8, 8)) if 0 < y.sum() < n else np.inf)
        earlier = np.column_stack([earlier, np.clip(out, -8, 8)])
    return chain


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_train: int = MAX_TRAIN) -> Chain:
    """Fit on at most max_train rows of labels (doc_id and a 0/1 column for each category)."""
    k = len(categories)
    chosen = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(0), lower=True):
                d, keys = _features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(end - first + 1)), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([lists, *(b.column(j).slice(first, end - first) for j in range(1, b.num_columns))], ["keys", *b.schema.names[1:]])

    # max_train rows of ids and labels: a proven bound for the broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), *[F.max(f"y{i}").alias(f"y{i}") for i in range(k)])
    fold = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    sample = one.select("text", "doc_id", fold, *(f"y{i}" for i in range(k))).mapInArrow(extract, "keys array<int>, doc_id long, fold int, " + ", ".join(f"y{i} int" for i in range(k)))
    sample = stored(sample, "toxicity-sample")
    rows = sorted(sample.drop("keys").collect())
    y = np.array([r[2:] for r in rows], dtype=float).reshape(len(rows), k)
    folds = np.array([r[1] for r in rows], dtype=int)
    # Features by fold and label; the best of each category and each set of training rows (all, or all but a fold).
    each = sample.select("fold", *(f"y{i}" for i in range(k)), F.explode("keys").alias("key")).groupBy("key", "fold").agg(F.count("*").alias("n"), *[F.sum(f"y{i}").alias(f"p{i}") for i in range(k)])
    wide = each.groupBy("key").pivot("fold", list(range(FOLDS))).agg(F.max("n").alias("n"), *[F.max(f"p{i}").alias(f"p{i}") for i in range(k)]).na.fill(0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            key = b.column("key").to_numpy(zero_copy_only=False)
            there = np.column_stack([b.column(f"{f}_n").to_numpy(zero_copy_only=False) for f in range(FOLDS)]).astype(float)
            for c in range(k):
                positive = np.column_stack([b.column(f"{f}_p{c}").to_numpy(zero_copy_only=False) for f in range(FOLDS)]).astype(float)
                for out in range(FOLDS + 1):  # the fold that is left out, or none
                    use, mine = [f for f in range(FOLDS) if f != out], folds != out
                    chi = _chi(there[:, use].sum(1), positive[:, use].sum(1), max(int(mine.sum()), 1), float(y[mine, c].sum()))
                    old = kept.get((c, out), (np.zeros(0), np.zeros(0, dtype=np.int32)))
                    chi, keys = np.concatenate([old[0], chi[chi > 0]]), np.concatenate([old[1], key[chi > 0]])
                    top = np.lexsort((keys, -chi))[:N_FEATURES]
                    kept[c, out] = chi[top], keys[top]
        for (c, out), (chi, keys) in kept.items():
            yield pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(keys), c * (FOLDS + 1) + out, dtype=np.int32)), "chi": pa.array(chi), "key": pa.array(keys.astype(np.int32))})

    tops = wide.mapInArrow(best, "model int, chi double, key int")
    first = Window.partitionBy("model").orderBy(F.desc("chi"), "key")
    wanted = sorted({r["key"] for r in tops.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= N_FEATURES).select("key").distinct().collect()})
    wanted_array = np.array(wanted, dtype=np.int32)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            hit = np.isin(flat, wanted_array)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "keys": pa.array([x[h].tobytes() for x, h in zip(np.split(flat, np.cumsum(n)[:-1]), np.split(hit, np.cumsum(n)[:-1]))], pa.binary())})

    # max_train rows of at most N_FEATURES keys for each of the models.
    got = {r["doc_id"]: np.frombuffer(r["keys"], dtype=np.int32) for r in sample.select("doc_id", "keys").mapInArrow(keep, "doc_id long, keys binary").collect()}
    dropped(sample)
    keys = [got[r[0]] for r in rows]
    owner = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
    return fit_chain(owner, np.concatenate([*keys, np.zeros(0, dtype=np.int32)]), y, folds, categories)


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> and is_<category> of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = _sigmoid(np.array(chain.thresholds))
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(1), lower=True):
                p = chain.predict(*_features(data, offsets), end - first)
                out = {"doc_id": b.column(0).slice(first, end - first).cast(pa.int64())}
                for j, c in enumerate(chain.categories):
                    out |= {f"p_{c}": pa.array(p[:, j]), f"is_{c}": pa.array((p[:, j] >= limits[j]) & np.isfinite(chain.thresholds[j]))}
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, " + ", ".join(f"p_{c} double, is_{c} boolean" for c in chain.categories))


def drop_flagged(docs: DataFrame, chain: Chain, category: str) -> DataFrame:
    """The rows of docs that the chain does not put into a category, each judged by its own text."""
    where, j = docs.columns.index("text"), chain.categories.index(category)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = _sigmoid(np.array(chain.thresholds[j]))
        for b in batches:
            for first, end, data, offsets in tk.slices(b.column(where), lower=True):
                p = chain.predict(*_features(data, offsets), end - first)[:, j]
                yield b.slice(first, end - first).filter(pa.array(~((p >= limit) & np.isfinite(chain.thresholds[j]))))

    return docs.mapInArrow(keep, docs.schema)
