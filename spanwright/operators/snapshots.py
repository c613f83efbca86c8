"""Two states of a table compared, newest versions, and the schedule and margins of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contrast(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, state (added, removed, changed or same) and the names of the values that differ; null equals null."""
    side = lambda rows, name: rows.select(*keys, F.struct(*values).alias(name))
    both = side(before, "old_row").join(side(after, "new_row"), keys, "full")
    there = F.col("old_row").isNotNull() & F.col("new_row").isNotNull()
    differ = F.array_compact(F.array(*[F.when(there & ~F.col(f"old_row.{v}").eqNullSafe(F.col(f"new_row.{v}")), v) for v in values]))
    state = F.when(F.col("old_row").isNull(), "added").when(F.col("new_row").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(*keys, state.alias("state"), differ.alias("differing"))


def version_key(version: Column) -> Column:
    """The runs of digits and of other characters in order: numbers by value, marks before numbers before words, so that 1.10 follows 1.9 and -beta follows -alpha; what only goes on is later."""
    runs = F.regexp_extract_all(F.lower(version), F.lit("[0-9]+|[a-z]+|[^0-9a-z]+"), F.lit(0))
    number = lambda r: F.when(r.rlike("^[0-9]"), r.cast("decimal(38,0)"))
    kind = lambda r: F.when(r.rlike("^[0-9]"), 1).when(r.rlike("^[a-z]"), 2).otherwise(0)
    return F.transform(runs, lambda r: F.struct(kind(r).alias("kind"), F.coalesce(number(r), F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(r.rlike("^[0-9]"), "").otherwise(r).alias("word")))


def newest(rows: DataFrame, key: str, version: str, at: str) -> DataFrame:
    """key, newest (version) and the time it was first seen."""
    seen = rows.groupBy(key, version).agg(F.min(at).alias("first_seen"))
    pick = F.max(F.struct(version_key(F.col(version)).alias("k"), F.col(version).alias("newest"), "first_seen"))
    return seen.groupBy(key).agg(pick.alias("x")).select(key, "x.newest", "x.first_seen")


def round_order(groups: DataFrame, by: str, rounds: str) -> DataFrame:
    """by, place, round, side: the schedule of as many rounds as each group has, in which each side runs first in every other round."""
    one = groups.where(F.col(rounds) > 0).select(by, F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col(rounds).cast("long") - 1)).alias("place"))
    one = one.withColumn("round", F.floor(F.col("place") / 2))
    return one.withColumn("side", F.when((F.col("round") % 2) == (F.col("place") % 2), "baseline").otherwise("candidate"))


def lowest_margin(groups: DataFrame, by: str, keys: list[str], point: str, floor: str) -> DataFrame:
    """For each value of ``by`` the group whose point is least above, or most below, its floor; groups without a point or floor take no part."""
    margin = F.round(F.col(point) - F.col(floor), 9)
    best = groups.where(F.col(point).isNotNull() & (F.col(floor) > 0)).groupBy(by).agg(F.min(F.struct(margin.alias("margin"), *keys, point, floor)).alias("x"))
    return best.select(by, *[f"x.{k}" for k in keys], f"x.{point}", f"x.{floor}", (F.col("x.margin") >= 0).alias("met"))
