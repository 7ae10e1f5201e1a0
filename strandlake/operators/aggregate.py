"""Aggregations and normalisations (inventory 2.6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_having(rows: DataFrame, key: str, least: int = 0, most: int = 0) -> DataFrame:
    """A1-A3: counts by key within limits (most 0: unlimited)."""
    out = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return out.filter(F.col("n") <= most) if most else out


def distinct_per_key(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """A4, A5, A36, A38, P63, P64."""
    return rows.groupBy(key).agg(F.count_distinct(*values).alias("n_distinct"))


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups of more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def share_of(value: Column, scale: float = 1e6, by: Sequence[str] = ()) -> Column:
    """Value / sum * scale as a window. For a single total prefer tpm(), which sums first."""
    return value * scale / F.sum(value).over(Window.partitionBy(*by))


def tpm(counts: DataFrame, value: str, scale: float = 1e6, length: str | None = None) -> DataFrame:
    """Counts (per kilobase of length) scaled to a total; the total is one row that is sent to all, so
    the rows are not gathered in one task."""
    rate = F.col(value) if length is None else F.col(value) / (F.col(length) / 1000.0)
    total = counts.agg(F.sum(rate).alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("tpm", rate * scale / F.col("__total")).drop("__total")


def histogram(rows: DataFrame, value: str, edges: Sequence[float], closed_last: bool = True, keep_empty: bool = False) -> DataFrame:
    """Counts in [a, b), the last closed if wanted; what is outside is dropped."""
    v = F.col(value)
    place = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        upper = v <= edges[i + 1] if closed_last and i == len(edges) - 2 else v < edges[i + 1]
        place = F.when((v >= edges[i]) & upper, i).otherwise(place)
    out = rows.select(place.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    if keep_empty:
        out = rows.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(out, "bin", "left").na.fill(0, ["n"])
    low = F.array(*[F.lit(float(x)) for x in edges])
    return out.select("bin", F.get(low, F.col("bin")).alias("low"), F.get(low, F.col("bin") + 1).alias("high"), "n")


def floor_bin(value: Column, bounds: Sequence[float]) -> Column:
    """The largest bound that is not above value; null below the first."""
    out = F.lit(None).cast("double")
    for b in bounds:
        out = F.when(value >= b, F.lit(float(b))).otherwise(out)
    return out


def share_by_group(hist: DataFrame, group: str, value: str = "n") -> DataFrame:
    """Counts as shares within their group."""
    return hist.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(group)))


def counts_above(rows: DataFrame, value: str, limits: Sequence[float]) -> DataFrame:
    """One row with how many values are above each limit."""
    return rows.agg(*[F.count_if(F.col(value) > x).alias(f"above_{x:g}") for x in limits])


def describe(rows: DataFrame, keys: list[str], value: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, extremes and linearly interpolated quantiles."""
    q = [F.percentile(value, x).alias(f"q{round(100 * x)}") for x in quantiles]
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), *q)


def average_ranks(rows: DataFrame, value: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Ranks with ties averaged, as a column."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return rows.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2.0)


def spearman(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation. Ranks come from the counts of distinct values, which are small next to the rows."""
    rows = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        counts = rows.groupBy(*by, c).agg(F.count("*").alias("__n"))
        upto = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        ranks = counts.select(*by, c, (F.sum("__n").over(upto) - (F.col("__n") - 1) / 2.0).alias(f"__rank_{c}"))
        rows = rows.join(ranks, [*by, c])
    return rows.groupBy(*by).agg(F.corr(f"__rank_{x}", f"__rank_{y}").alias("spearman"))


def accuracy(rows: DataFrame, called: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """Tp, fp, fn, precision and recall in per cent of two flags."""
    out = rows.groupBy(*by).agg(F.count_if(called & truth).alias("tp"), F.count_if(called & ~truth).alias("fp"), F.count_if(~called & truth).alias("fn"))
    return out.withColumns({"precision": 100.0 * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), "recall": 100.0 * F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))})


def accuracy_by_threshold(rows: DataFrame, score: str, correct: str, recall: bool = False) -> DataFrame:
    """Called, correct and precision at or above every score that occurs.

    With recall, rows with a null score are reads without a call, and recall is the share of correct ones in all reads.
    """
    if recall:
        out = accuracy_by_threshold(rows.filter(F.col(score).isNotNull()), score, correct)
        return out.crossJoin(F.broadcast(rows.agg(F.count("*").alias("__all")))).withColumn("recall", 100.0 * F.col("correct") / F.col("__all")).drop("__all")
    per = rows.groupBy(score).agg(F.count("*").alias("__n"), F.count_if(correct).alias("__c"))  # few scores: the window is small
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = per.select(score, F.sum("__n").over(w).alias("called"), F.sum("__c").over(w).alias("correct"))
    return out.withColumn("precision", 100.0 * F.col("correct") / F.col("called"))


def umis_within(rows: DataFrame, umi: str, truth: str, trusted: str | None = None, length: int = 13) -> DataFrame:
    """UMIs, cut to length, within 1, 2 and 3 edits of the truth, cumulative; with trusted, also those of trusted rows."""
    d = F.levenshtein(F.substring(umi, 1, length), F.col(truth))
    flags = {"": F.lit(True)} | ({"trusted_": F.col(trusted)} if trusted else {})
    return rows.agg(*[F.count_if((d <= k) & f).alias(f"{name}within_{k}") for name, f in flags.items() for k in (1, 2, 3)])


def quantification_accuracy(rows: DataFrame, observed: str, truth: str) -> DataFrame:
    """Exact, within 10 and 20 per cent, false and missed."""
    o, t = F.col(observed), F.col(truth)
    both = (o > 0) & (t > 0)
    return rows.agg(F.count_if(o == t).alias("exact"), F.count_if(both & (F.abs(o - t) <= 0.1 * t)).alias("within_10"), F.count_if(both & (F.abs(o - t) <= 0.2 * t)).alias("within_20"), F.count_if((o > 0) & (t == 0)).alias("false"), F.count_if((o == 0) & (t > 0)).alias("missed"))


def crosstab(rows: DataFrame, *dims: str) -> DataFrame:
    """Counts of all combinations with their marginal totals; level is Spark's grouping id."""
    return rows.cube(*dims).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def top_values(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of a key with their share; ties by value."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), value))})
    return ranked.filter(F.col("place") <= k)


def count_of_counts(rows: DataFrame, key: str) -> DataFrame:
    """A48."""
    return rows.groupBy(key).agg(F.count("*").alias("times")).groupBy("times").agg(F.count("*").alias("n"))


def merge_flags(rows: DataFrame, key: str, flags: Sequence[str], largest: Sequence[str], sets: Sequence[str]) -> DataFrame:
    """Flags by or, numbers by maximum, the rest as sorted sets."""
    return rows.groupBy(key).agg(*[F.bool_or(f).alias(f) for f in flags], *[F.max(x).alias(x) for x in largest], *[F.array_sort(F.collect_set(s)).alias(s) for s in sets])


def presence_pattern(rows: DataFrame, key: str, source: str, sources: Sequence[str]) -> DataFrame:
    """How many keys have each pattern of sources, as a string of 0 and 1."""
    flags = [F.max((F.col(source) == s).cast("int")).alias(f"__{i}") for i, s in enumerate(sources)]
    bits = F.concat(*[F.col(f"__{i}").cast("string") for i in range(len(sources))])
    return rows.groupBy(key).agg(*flags).groupBy(bits.alias("pattern")).agg(F.count("*").alias("n"))


def set_overlap_counts(called: Column, truth: Column) -> Column:
    """Struct of common, extra and missed of two arrays."""
    return F.struct(F.size(F.array_intersect(called, truth)).alias("common"), F.size(F.array_except(called, truth)).alias("extra"), F.size(F.array_except(truth, called)).alias("missed"))


def fold_change(long: Column, short: Column) -> Column:
    """-1 where there is nothing to divide by."""
    return F.when(short == 0, -1.0).otherwise(long / short)


def group_mean_columns(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Means of the columns that share the part before '_'."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(c.split("_")[0], []).append(c)
    return rows.select(key, *[(sum((F.col(c) for c in cs[1:]), F.col(cs[0])) / len(cs)).alias(g) for g, cs in groups.items()])


def row_zscore(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Centred, and divided by the sample deviation; NaN where all values of a row are equal, as 0 / 0 is in floating
    point, null where there is one."""
    w = Window.partitionBy(by)
    centred, sd = F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)
    return rows.withColumns({"centred": centred, "z": F.when(sd == 0, F.lit(float("nan"))).otherwise(centred / F.nullif(sd, F.lit(0.0)))})


def expressed(rows: DataFrame, feature: str, sample: str, value: str, cutoff: float = 1.0, samples: int = 2) -> DataFrame:
    """Features whose share per million exceeds cutoff in enough samples."""
    totals = rows.groupBy(sample).agg(F.sum(value).alias("__total"))
    cpm = rows.join(totals, sample).withColumn("cpm", F.col(value) * 1e6 / F.col("__total"))
    return cpm.groupBy(feature).agg(F.count_if(F.col("cpm") > cutoff).alias("n_samples")).filter(F.col("n_samples") >= samples)


def frequent_terms(rows: DataFrame, term: str, least: int) -> DataFrame:
    """All rows whose term occurs more than `least` times."""
    common = rows.groupBy(term).agg(F.count("*").alias("__n")).filter(F.col("__n") > least)
    return rows.join(common.select(term), term, "left_semi")


def sample_distance(rows: DataFrame, feature: str, sample: str, value: str) -> DataFrame:
    """1 - Pearson correlation of log2(x + 1) for every pair of samples, through the features they share."""
    logged = rows.select(feature, F.col(sample), F.log2(F.col(value) + 1).alias("v"))
    a, b = logged.withColumnsRenamed({sample: "sample_a", "v": "x"}), logged.withColumnsRenamed({sample: "sample_b", "v": "y"})
    return a.join(b, feature).filter("sample_a < sample_b").groupBy("sample_a", "sample_b").agg((1 - F.corr("x", "y")).alias("distance"))


def lfc_range(rows: DataFrame, gene: str, lfc: str) -> DataFrame:
    """The range of the contrasts' changes, 0 included."""
    return rows.groupBy(gene).agg((F.greatest(F.lit(0.0), F.max(lfc)) - F.least(F.lit(0.0), F.min(lfc))).alias("lfc_range"))


def significant(rows: DataFrame, lfc: str, fdr: str, cut: float, level: float) -> DataFrame:
    """Rows past both limits, with their direction."""
    kept = rows.filter((F.col(fdr) <= level) & (F.abs(F.col(lfc)) > cut))
    return kept.withColumn("direction", F.when(F.col(lfc) > 0, "up").otherwise("down"))
