"""Tests and adjustments (inventory 2.16)."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, exp, lgamma, log, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_2x2(a: Column, b: Column, c: Column, d: Column, yates: bool = True) -> Column:
    """D3: the statistic of [[a, b], [c, d]], with Yates' correction; null if a margin is empty."""
    n = (a + b + c + d).cast("double")
    diff = F.abs(a.cast("double") * d - b.cast("double") * c)
    if yates:
        diff = F.greatest(F.lit(0.0), diff - F.least(n / 2, diff))
    bottom = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    return F.when(bottom > 0, n * diff * diff / bottom)


def gated(a: Column, b: Column, c: Column, d: Column) -> Column:
    """D3: whether the test may be made: no column above 0.9 of all, every expected count above 5."""
    n = (a + b + c + d).cast("double")
    share = F.greatest(a + c, b + d) / n
    expected = F.least(a + b, c + d).cast("double") * F.least(a + c, b + d) / n
    return (n > 0) & (share <= 0.9) & (expected > 5)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_p(statistic: float, df: int = 1) -> float:
    return erfc(sqrt(statistic / 2)) if df == 1 else gamma_q(df / 2, statistic / 2)


@F.pandas_udf(DoubleType())
def chi2_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """P of a chi-squared statistic; null stays null."""
    return pd.Series([None if pd.isna(s) else chi2_p(float(s), int(d)) for s, d in zip(statistic, df)], dtype="float64")


def table_chi2(cells: DataFrame, keys: Sequence[str], row: str, column: str, count: str) -> DataFrame:
    """D5 (tables as they are; codon_dependency() compresses them), P16: statistic and degrees of freedom of each key's table; rows of the long form, absent cells are 0."""
    k = list(keys)
    rows = cells.groupBy(*k, row).agg(F.sum(count).alias("__r"))
    cols = cells.groupBy(*k, column).agg(F.sum(count).alias("__c"))
    total = cells.groupBy(*k).agg(F.sum(count).alias("__n"))
    full = rows.join(cols, k).join(cells.groupBy(*k, row, column).agg(F.sum(count).alias("__o")), [*k, row, column], "left").join(total, k)
    expected = F.col("__r").cast("double") * F.col("__c") / F.col("__n")
    observed = F.coalesce("__o", F.lit(0))
    return full.groupBy(*k).agg(F.sum((observed - expected) * (observed - expected) / expected).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).cast("int").alias("df"))


def compress_tables(cells: DataFrame, keys: Sequence[str], row: str, column: str, count: str) -> DataFrame:
    """Each key's table with at most two rows and two columns: the two of the smallest sums are added, again and again,
    and stand last; the first of equal sums, in the order of the labels, is the smaller. Labels are joined by "+".
    Tables of one row or column stay as they are; a key's table (codons) is small. All cells of a table are given."""
    k = list(keys)
    types = dict(cells.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in k), f"`{row}` string, `{column}` string, `{count}` long"])

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        while len(t) > 2:
            i = t.sum(axis=1).to_numpy().argmin()
            one, rest = t.iloc[i], t.drop(index=t.index[i])
            j = rest.sum(axis=1).to_numpy().argmin()
            both = (one + rest.iloc[j]).to_frame(f"{t.index[i]}+{rest.index[j]}").T
            t = pd.concat([rest.drop(index=rest.index[j]), both])
        return t

    def compress(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        t = group.assign(**{row: group[row].astype(str), column: group[column].astype(str)}).pivot_table(index=row, columns=column, values=count, aggfunc="sum", fill_value=0)
        if min(t.shape) >= 2:
            t = fold(fold(t).T).T
        out = [(*key, r, c, int(t.loc[r, c])) for r in t.index for c in t.columns]
        return pd.DataFrame(out, columns=[*k, row, column, count])

    return cells.groupBy(*k).applyInPandas(compress, schema)


def codon_dependency(cells: DataFrame, keys: Sequence[str], row: str, column: str, count: str) -> DataFrame:
    """The compressed tables with two rows and columns, two filled cells and min column * min row / total >= 5: the
    statistic with Yates' correction, p and the BH rate."""
    k = list(keys)
    t = compress_tables(cells, k, row, column, count)
    by = Window.partitionBy(*k)
    placed = t.withColumns({"__r": F.col(row) == F.min(row).over(by), "__c": F.col(column) == F.min(column).over(by)})
    a, b, c, d = (F.sum(F.when((F.col("__r") == x) & (F.col("__c") == y), F.col(count)).otherwise(0)) for x, y in ((True, True), (True, False), (False, True), (False, False)))
    wide = placed.groupBy(*k).agg(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), F.count_distinct(row).alias("__rows"), F.count_distinct(column).alias("__cols"))
    filled = sum((F.col(x) > 0).cast("int") for x in "abcd")
    least = F.least(F.expr("a + b"), F.expr("c + d")) * F.least(F.expr("a + c"), F.expr("b + d")) / F.expr("a + b + c + d")
    kept = wide.filter((F.col("__rows") == 2) & (F.col("__cols") == 2) & (filled >= 2) & (least >= 5))
    tested = kept.withColumn("chi2", chi2_2x2(*[F.col(x) for x in "abcd"])).withColumn("p", chi2_p_value("chi2", F.lit(1)))
    return adjust(tested.drop("__rows", "__cols"), "p", "fdr", "BH")


def adjust(rows: DataFrame, p: str, name: str, method: str = "BH", by: Sequence[str] = ()) -> DataFrame:
    """False discovery rates (BH, or BY with the harmonic factor) within by.

    The p-values are first counted by value, so ties are one row. Ranks and running minima go in two levels: over bands of p,
    a 64th of a power of two each, and within a band, so no task holds all p-values.
    """
    by = list(by)
    band = F.when(F.col(p) > 0, F.floor(-64 * F.log2(F.col(p)))).otherwise(1 << 17)  # from large p to small
    per = rows.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__k")).withColumn("__band", band)
    inside = Window.partitionBy(*by, "__band")
    smaller = Window.partitionBy(*by).orderBy(F.desc("__band")).rowsBetween(Window.unboundedPreceding, -1)
    larger = Window.partitionBy(*by).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = per.groupBy(*by, "__band").agg(F.sum("__k").alias("__s"))
    sizes = sizes.withColumns({"__before": F.coalesce(F.sum("__s").over(smaller), F.lit(0)), "__n": F.sum("__s").over(Window.partitionBy(*by))})
    upto = inside.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    factor = F.col("__n") * (harmonic_number(F.col("__n")) if method == "BY" else F.lit(1.0))
    raw = per.join(sizes, [*by, "__band"]).withColumn("__raw", F.col(p) * factor / (F.col("__before") + F.sum("__k").over(upto)))
    best = raw.groupBy(*by, "__band").agg(F.min("__raw").alias("__least")).withColumn("__above", F.min("__least").over(larger)).drop("__least")
    down = inside.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    fdr = raw.join(best, [*by, "__band"]).withColumn(name, F.least(F.lit(1.0), F.min("__raw").over(down), "__above"))
    return rows.join(fdr.select(*by, p, name), [*by, p], "left")


def harmonic_number(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: summed up to 256, beyond that by Euler and Maclaurin, exact to the last digits of a double."""
    x = n.cast("double")
    summed = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(256)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / i)
    return F.when(n <= 256, summed).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def psi(include: Column, exclude: Column) -> Column:
    """D3: share of inclusion."""
    return include / F.nullif(include + exclude, F.lit(0))



def differential_exons(counts: DataFrame, group: str, one: str, two: str, least: int = 10) -> DataFrame:
    """Exons (exon, group, include, exclude) compared between two groups: statistic, p, dPSI and BY rates."""
    wide = counts.filter(F.col(group).isin(one, two)).groupBy("exon").agg(*[F.sum(F.when(F.col(group) == g, F.col(c)).otherwise(0)).alias(f"{c}_{i}") for i, g in ((1, one), (2, two)) for c in ("include", "exclude")])
    wide = wide.filter((F.col("include_1") + F.col("exclude_1") >= least) & (F.col("include_2") + F.col("exclude_2") >= least))
    cells = [F.col(x) for x in ("include_1", "exclude_1", "include_2", "exclude_2")]
    tested = wide.withColumn("chi2", F.when(gated(*cells), chi2_2x2(*cells))).filter("chi2 is not null")
    tested = tested.withColumns({"psi1": psi(cells[0], cells[1]), "psi2": psi(cells[2], cells[3]), "p": chi2_p_value(F.col("chi2"), F.lit(1))})
    return adjust(tested.withColumn("dpsi", F.col("psi1") - F.col("psi2")), "p", "fdr", "BY")
