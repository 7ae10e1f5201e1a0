"""Ternary profiles (inventory 2.15): arrays of 1 (there), -1 (skipped) and 0 (not covered)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions import interval as iv


def feature_profile(blocks: Column, features: Column, delta: int = 0) -> Column:
    """1 where a block equals the feature, -1 where one overlaps it otherwise, 0 else."""
    return F.transform(features, lambda f: F.when(iv.equals_any(f, blocks, delta), 1).when(F.exists(blocks, lambda b: iv.overlaps(f, b)), -1).otherwise(0))


def _first(profile: Column) -> Column:
    return F.array_position(F.transform(profile, lambda x: (x != 0).cast("int")), 1)


def _last(profile: Column) -> Column:
    return F.size(profile) + 1 - F.array_position(F.reverse(F.transform(profile, lambda x: (x != 0).cast("int"))), 1)


def ends(profile: Column) -> Column:
    """Struct of the first and the last nonzero place, from 1; first is 0 if there is none."""
    return F.struct(_first(profile).alias("first"), _last(profile).alias("last"))


def fill_between(profile: Column, first: Column, last: Column) -> Column:
    """P2, P3, with the places known: as columns, they are not looked for again at each place."""
    return F.transform(profile, lambda x, i: F.when((first > 0) & (x == 0) & (i + 1 > first) & (i + 1 < last), -1).otherwise(x))


def fill_gaps(profile: Column) -> Column:
    """Zeros between the first and the last nonzero place become -1."""
    return fill_between(profile, _first(profile), _last(profile))


def merge(a: Column, b: Column) -> Column:
    """Zeros give way; null if two places contradict each other."""
    clash = F.exists(F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0) & (x != y)), lambda c: c)
    return F.when(~clash, F.zip_with(a, b, lambda x, y: F.when(x == 0, y).otherwise(x)))


def diff_only_present(a: Column, b: Column) -> Column:
    """P5: differing places where neither is 0; -1 if the lengths differ."""
    d = F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0) & (x != y)).cast("int"))
    return F.when(F.size(a) != F.size(b), -1).otherwise(F.aggregate(d, F.lit(0), lambda s, x: s + x))


def signed_cover_diff(cover: Column, signs: Column) -> Column:
    """Summed |cover| where the signs oppose."""
    return F.aggregate(F.zip_with(cover, signs, lambda c, s: F.when(c * s < 0, F.abs(c)).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda t, x: t + x)


def matching_places(a: Column, b: Column) -> Column:
    """P7."""
    return F.zip_with(a, b, lambda x, y: (x == y).cast("int"))


def is_subprofile(short: Column, long: Column) -> Column:
    """Equal from the first 1 to the last 1 of the short one; null without a 1 or with other lengths."""
    ones = F.transform(short, lambda x: (x == 1).cast("int"))
    a = F.array_position(ones, 1)
    b = F.size(short) + 1 - F.array_position(F.reverse(ones), 1)
    return F.when((a == 0) | (F.size(short) != F.size(long)), F.lit(None).cast("boolean")).otherwise(F.slice(short, a.cast("int"), (b - a + 1).cast("int")) == F.slice(long, a.cast("int"), (b - a + 1).cast("int")))


def one_hot(own: Column, universe: Column, exact: bool = False) -> Column:
    """1 at an isoform's own features (introns: exact) or parts of them (exons), -1 elsewhere."""
    if exact:
        return F.transform(universe, lambda u: F.when(iv.equals_any(u, own), 1).otherwise(-1))
    return F.transform(universe, lambda u: F.when(F.exists(own, lambda o: (o["start"] <= u["start"]) & (o["end"] >= u["end"])), 1).otherwise(-1))


def is_complete(profile: Column) -> Column:
    """No zeros between the first and the last nonzero place."""
    return ~F.exists(F.zip_with(profile, fill_gaps(profile), lambda x, y: x != y), lambda c: c)
