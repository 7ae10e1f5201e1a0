"""Ordered and sequential operators (inventory 2.7, 2.12)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_record(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of a key by the given order, which must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def islands(rows: DataFrame, keys: list[str], start: str, end: str, tie: str, gap: int = 0) -> DataFrame:
    """W3, W5, W6, ST4: numbers runs of intervals that overlap (or lie within gap) as island, from 0 in each key."""
    order = Window.partitionBy(*keys).orderBy(start, tie)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("__new", (reach.isNotNull() & (F.col(start) > reach + gap)).cast("int"))
    return fresh.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def merge_intervals(rows: DataFrame, keys: list[str], start: str, end: str, tie: str, gap: int = 0) -> DataFrame:
    """Unions of overlapping intervals."""
    return islands(rows, keys, start, end, tie, gap).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def split_segments(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """P10: elementary closed segments that at least one interval covers, with how many do; starts go before ends."""
    edges = rows.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("step")), F.struct((F.col(end) + 1).alias("at"), F.lit(-1).alias("step")))).alias("e")).groupBy(*keys, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    w = Window.partitionBy(*keys).orderBy("at")
    cut = edges.withColumns({"depth": F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "till": F.lead("at").over(w) - 1})
    return cut.filter("depth > 0").select(*keys, F.col("at").alias(start), F.col("till").alias(end), "depth")


def isolated(rows: DataFrame, keys: list[str], pos: str, tie: str, gap: int) -> DataFrame:
    """Rows with no neighbour within gap on either side."""
    w = Window.partitionBy(*keys).orderBy(pos, tie)
    near = (F.col(pos) - F.lag(pos).over(w) <= gap) | (F.lead(pos).over(w) - F.col(pos) <= gap)
    return rows.withColumn("__near", F.coalesce(near, F.coalesce(F.col(pos) - F.lag(pos).over(w) <= gap, F.lit(False)) | F.coalesce(F.lead(pos).over(w) - F.col(pos) <= gap, F.lit(False)))).filter("not __near").drop("__near")


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = rows.withColumn("__new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1)))
    runs = changed.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", value).agg(F.count("*").alias("n"))


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last value that was not null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def saturation(rows: DataFrame, order: str, values: list[str], steps: int = 10) -> DataFrame:
    """W10, ST7: distinct value tuples among the first 1/steps, 2/steps, ... of the rows by a unique order.

    Rows are ranked in two levels (range blocks, then within each), so no task holds them all.
    """
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "step int, n_rows long, n_distinct long")
    firsts = rows.groupBy(*values).agg(F.min(order).alias("__at"))
    bounds = [(i + 1, n * (i + 1) // steps) for i in range(steps)]
    ranked = rank_all(rows.select(order), order, n)
    cuts = ranked.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, "step int, n_rows long")), F.col("rank") == F.col("n_rows")).select("step", "n_rows", F.col(order).alias("__cut"))
    return F.broadcast(cuts).join(firsts, F.col("__at") <= F.col("__cut")).groupBy("step", "n_rows").agg(F.count("*").alias("n_distinct"))


#: Most ranges of a column that rank_all() counts, so their running sum is one small task.
MAX_RANGES = 1 << 20


def rank_all(rows: DataFrame, order: str, n: int, per_range: int = 100_000) -> DataFrame:
    """rank 1..n by a unique numeric column: ranges of equal width are counted, then ranked each by itself. Ids and hashes fill
    their ranges evenly."""
    ranges = min(MAX_RANGES, max(1, -(-n // per_range)))
    low, high = (float(x) if x is not None else 0.0 for x in rows.agg(F.min(order), F.max(order)).first())
    width = (high - low) / ranges or 1.0
    place = F.least(F.greatest(F.floor((F.col(order).cast("double") - low) / width), F.lit(0)), F.lit(ranges - 1))
    dealt = rows.withColumn("__range", place)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return dealt.withColumn("__rank", inside).join(before, "__range").withColumn("rank", F.col("__before") + F.col("__rank")).drop("__range", "__rank", "__before")


def dominance(rows: DataFrame, key: str, value: str, count: str) -> DataFrame:
    """Keys with exactly one value at or above max(2, half of the top count) (1 if the top is 1)."""
    w = Window.partitionBy(key)
    top = F.max(count).over(w)
    cut = F.when(top == 1, F.lit(1.0)).otherwise(F.greatest(F.lit(2.0), top / 2.0))
    kept = rows.withColumn("__cut", cut).filter(F.col(count) >= F.col("__cut")).drop("__cut")
    return kept.withColumn("__k", F.count("*").over(w)).filter("__k = 1").drop("__k")


def terminal_feature(rows: DataFrame, key: str, strand: str, start: str, last: bool = True) -> DataFrame:
    """The last (or first) feature of a key by strand."""
    plus = F.col(strand) != "-"
    sign = F.when(plus == last, -F.col(start)).otherwise(F.col(start))
    return best_record(rows, [key], sign, F.col(start))


def thin_positions(rows: DataFrame, key: str, pos: str, gap: int = 100) -> DataFrame:
    """Drops a position closer than gap to the last one kept, in order.

    A position at least gap after the one before it is kept whatever came before, so a key falls into runs that are thinned
    each by itself, row by row in their order; a key's rows are only sorted together, never held.
    """
    by = Window.partitionBy(key).orderBy(pos)
    fresh = F.coalesce(F.col(pos) - F.lag(pos).over(by) >= gap, F.lit(True)).cast("int")
    runs = rows.select(key, F.col(pos).cast("long").alias(pos)).withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, 0
        for b in batches:
            kept = []
            for i, (k, r, p) in enumerate(zip(b[key], b["__run"], b[pos])):
                if (k, r) != now or p - last >= gap:
                    now, last = (k, r), p
                    kept.append(i)
            yield b.iloc[kept][[key, pos]]

    fields = {f.name: f.dataType.simpleString() for f in runs.schema}
    return runs.repartition(key, "__run").sortWithinPartitions(key, "__run", pos).mapInPandas(thin, f"`{key}` {fields[key]}, `{pos}` long")


def umi_clusters(rows: DataFrame, keys: list[str], umi: str, trusted: str, count: str, order: str, max_distance: int, disregard_length: bool = False) -> DataFrame:
    """Greedy clusters of UMIs in order of `order`: a UMI joins the cluster whose head is nearest, the first of equally near ones, if that is near enough, else founds one.

    The distance is the edit distance less the difference of lengths, and near enough is max_distance (0: one holds the
    other, the distance is the difference of lengths; below 0: all are one). With disregard_length it is the edit distance
    itself (0: they are equal). Equal UMIs are collapsed first, so a group's size is its distinct UMIs; a UMI is compared with
    the heads that share a part with it.
    """
    distinct = rows.groupBy(*keys, umi).agg(F.bool_or(trusted).alias(trusted), F.sum(count).alias(count), F.min(order).alias(order))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in distinct.schema) + ", cluster string"

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        heads = _Heads(max_distance, disregard_length)
        group = group.sort_values([order, umi])
        return group.assign(cluster=[heads.nearest(u) or heads.add(u) for u in group[umi]])

    spark = rows.sparkSession  # groups are small in bytes and long in time: they are not put together in few tasks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return distinct.repartition(tasks, *keys).groupBy(*keys).applyInPandas(cluster, schema)


class _Heads:
    """Heads of clusters in the order they were founded. Cut in e + 1 parts, a head that is at most e edits away has a part that is
    unchanged and at most e places off, so only heads with such a part are compared."""

    def __init__(self, most: int, disregard_length: bool):
        self.most, self.disregard_length = most, disregard_length
        self.names: list[str] = []
        self.by_length: dict[int, list[int]] = {}
        self.by_part: dict[tuple[int, int], dict[tuple[int, str], list[int]]] = {}  # (length of the heads, edits)

    def add(self, u: str) -> str:
        self.by_length.setdefault(len(u), []).append(len(self.names))
        for (n, e), index in self.by_part.items():
            if n == len(u):
                self._enter(index, u, len(self.names), e)
        self.names.append(u)
        return u

    def nearest(self, u: str) -> str | None:
        """The head with the least (distance, number), None if none is near enough."""
        if self.most <= 0:
            near = ((d, i) for i, h in enumerate(self.names) if (d := _distance(h, u, self.most, self.disregard_length)) is not None)
        else:
            near = (x for n in self.by_length if (x := self._near(u, n)))
        best = min(near, default=None)
        return None if best is None else self.names[best[1]]

    def _near(self, u: str, n: int) -> tuple[int, int] | None:
        gap = abs(n - len(u))
        e = self.most + (0 if self.disregard_length else gap)
        found = sorted(self._candidates(u, n, e)) if gap <= e else []
        if not found:
            return None
        edits = edit_distances(u, [self.names[i] for i in found])
        at = int(edits.argmin())
        return (int(edits[at]) - (0 if self.disregard_length else gap), found[at]) if edits[at] <= e else None

    def _candidates(self, u: str, n: int, e: int) -> Iterable[int]:
        if n <= e:
            return self.by_length[n]
        if (index := self.by_part.get((n, e))) is None:
            index = self.by_part[n, e] = {}
            for i in self.by_length[n]:
                self._enter(index, self.names[i], i, e)
        spans = [(k, s, b - a) for k, (a, b) in enumerate(_parts(n, e)) for s in range(max(0, a - e), min(a + e, len(u) - b + a) + 1)]
        return {i for k, s, size in spans for i in index.get((k, u[s : s + size]), ())}

    @staticmethod
    def _enter(index: dict[tuple[int, str], list[int]], head: str, number: int, e: int) -> None:
        for k, (a, b) in enumerate(_parts(len(head), e)):
            index.setdefault((k, head[a:b]), []).append(number)


@cache
def _parts(n: int, e: int) -> list[tuple[int, int]]:
    """e + 1 parts of n places."""
    return [(k * n // (e + 1), (k + 1) * n // (e + 1)) for k in range(e + 1)]


def edit_distances(a: str, others: list[str]) -> np.ndarray:
    """The Levenshtein distances of a to strings of one length, all at once."""
    n = len(others[0])
    if len(others) < 5 or not n:
        return np.array([levenshtein(a, b) for b in others])
    codes = np.frombuffer("".join(others).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(others), n).T
    before = [np.full(len(others), j, dtype=np.int32) for j in range(n + 1)]
    for i, x in enumerate(a, 1):
        unequal = codes != ord(x)
        now = [np.full(len(others), i, dtype=np.int32)]
        for j in range(1, n + 1):
            now.append(np.minimum(np.minimum(before[j], now[-1]) + 1, before[j - 1] + unequal[j - 1]))
        before = now
    return before[-1]


def _distance(a: str, b: str, most: int, disregard_length: bool) -> int | None:
    """How far a head is, None if it is too far."""
    if most < 0:
        return 0
    if disregard_length:
        d = 0 if a == b else most + 1 if most == 0 else levenshtein(a, b)
        return d if d <= most else None
    if most == 0:
        return abs(len(a) - len(b)) if a in b or b in a else None
    d = levenshtein(a, b) - abs(len(a) - len(b))
    return d if d <= most else None


def levenshtein(a: str, b: str) -> int:
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def ranked_umi_collapse(rows: DataFrame, keys: list[str], umi: str, cutoff: int) -> DataFrame:
    """UMIs by count, then key, descending; one is accepted if it is at least cutoff edits from all accepted."""
    counts = rows.groupBy(*keys, umi).agg(F.count("*").alias("n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)

    def accept(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n", umi], ascending=False)
        kept: list[str] = []
        for u in group[umi]:
            if all(levenshtein(u, k) >= cutoff for k in kept):
                kept.append(u)
        return group[group[umi].isin(kept)]

    return counts.groupBy(*keys).applyInPandas(accept, schema)


def coordinate_dedup(rows: DataFrame, keys: list[str], start: str, end: str, order: str, gap_start: int, gap_end: int) -> DataFrame:
    """Drops a row whose start and end are both within the gaps of one kept before it, in order.

    A row that starts farther than gap_start after the one before it is near none before, so a key falls into runs that are
    looked through each by itself; only the kept rows within gap_start are held.
    """
    by = Window.partitionBy(*keys).orderBy(start, order)
    fresh = F.coalesce(F.col(start) - F.lag(start).over(by) > gap_start, F.lit(True)).cast("int")
    runs = rows.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for b in batches:
            flags = []
            for *run, s, e in zip(*(b[k] for k in keys), b["__run"], b[start], b[end]):
                if run != now:
                    now, kept = run, []
                kept = [(x, y) for x, y in kept if s - x <= gap_start]
                new = not any(abs(e - y) <= gap_end for _, y in kept)
                flags.append(new)
                if new:
                    kept.append((s, e))
            yield b[flags].drop(columns="__run")

    return runs.repartition(*keys, "__run").sortWithinPartitions(*keys, "__run", start, order).mapInPandas(keep, rows.schema)


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) for a row's keys, from their MD5 digest, so that any engine can draw the same ones."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / float(1 << 52)


def stratified_sample(rows: DataFrame, by: list[str], n: int, seed: int, *unique: str) -> DataFrame:
    """R2: n rows of each group, by a hash, so the same rows whatever the partitions."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(u).cast("string") for u in unique])), *unique)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def bernoulli(rows: DataFrame, fraction: float, seed: int, *unique: str) -> DataFrame:
    """Rows whose number falls below the fraction; repeatable."""
    return rows.filter(uniform(seed, *unique) < fraction)


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """ST1, ST2: lists of size rows; the last may be shorter."""
    out: list = []
    for r in rows:
        out.append(r)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out


def select_high_count_groups(rows: DataFrame, group: str, sample: str, cap: int, least: int, target: int) -> DataFrame:
    """Groups with enough rows, also after each sample is capped."""
    per = rows.groupBy(group, sample).agg(F.count("*").alias("n"))
    return per.groupBy(group).agg(F.sum("n").alias("total"), F.sum(F.least(F.col("n"), F.lit(cap))).alias("capped")).filter((F.col("total") >= least) & (F.col("capped") >= target))


