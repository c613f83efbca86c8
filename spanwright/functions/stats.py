"""Column functions for rates that are withheld rather than guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z, MIN_DENOMINATOR, PLACES = 1.96, 5, 6


def wilson(k: Column, n: Column, upper: bool, z: float = Z) -> Column:
    """One endpoint of the Wilson score interval, within 0 and 1; null without trials."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, z * z
    spread = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    centre = p + z2 / (2 * n)
    end = ((centre + spread) if upper else (centre - spread)) / (1 + z2 / n)
    return F.when(n > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), end)), PLACES))


def status(n: Column, least: int = MIN_DENOMINATOR) -> Column:
    """none (no trials), insufficient-evidence (too few) or measured."""
    return F.when(n == 0, "none").when(n < least, "insufficient-evidence").otherwise("measured")


def point(k: Column, n: Column, least: int = MIN_DENOMINATOR) -> Column:
    return F.when((n > 0) & (n >= least), F.round(k.cast("double") / n, PLACES))


def bound(k: Column, n: Column, upper: bool, least: int = MIN_DENOMINATOR) -> Column:
    return F.when((n > 0) & (n >= least), wilson(k, n, upper))


def nearest_rank(value: Column, share: float) -> Column:
    """The value at rank ceil(share * n), never interpolated."""
    ranked = F.array_sort(F.collect_list(value))
    return F.get(ranked, F.ceil(F.lit(share) * F.size(ranked)).cast("int") - 1)
