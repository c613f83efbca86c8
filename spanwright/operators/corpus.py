"""Checks of a corpus: balance over an axis, repeated rows, and a frozen part against the present state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .independence import entry, frozen_digest


def distribution(rows: DataFrame, axis: str, known: list[str], minimum: int, share: float) -> DataFrame:
    """axis, n, share, problem (null if none): values that are unknown, too few, or more than a share of all rows; known ones without a row count 0."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(axis).alias("axis")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(k, True) for k in known], "axis string, known boolean")
    total = counts.agg(F.sum("n").alias("total"))
    every = counts.join(F.broadcast(names), "axis", "full").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    part = F.coalesce(F.try_divide(n, F.col("total")), F.lit(0.0))
    problem = F.concat_ws(",", F.when(F.col("known").isNull(), "unknown").when(n < minimum, "few"), F.when(part > share, "dominates"))
    return every.select("axis", n.alias("n"), F.round(part, 6).alias("share"), F.nullif(problem, F.lit("")).alias("problem"))


def repeated(rows: DataFrame, key: str, keys: dict) -> DataFrame:
    """key, prior, id: for each named value of a row that rows of smaller id have too, the smallest such id."""
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in keys.items()]))
    long = rows.select(F.col(key).alias("id"), named.alias("x")).select("id", "x.*")
    first = long.groupBy("key", "value").agg(F.min("id").alias("prior"), F.count("*").alias("n")).where("n > 1 and value is not null")
    return long.join(first, ["key", "value"]).where("id > prior").select("key", "prior", "id")


def frozen_problems(frozen: DataFrame, rows: DataFrame, digest: str | None = None) -> DataFrame:
    """id, problem of frozen rows (id, group, sha256) that are gone, in another group, edited since, or repeat an id; a row may have several.

    With the digest that was noted for the frozen rows (see ``frozen_digest``), a
    row without id says stale-digest if they have another.
    """
    now = rows.select("id", F.col("group").alias("now_group"), F.col("sha256").alias("now_sha"), F.lit(True).alias("there"))
    both = frozen.join(now, "id", "left")
    gone = F.when(F.col("there").isNull(), "removed")
    moved = F.when(F.col("there") & ~F.col("group").eqNullSafe(F.col("now_group")), "regrouped")
    edited = F.when(F.col("there") & ~F.col("sha256").eqNullSafe(F.col("now_sha")), "edited")
    found = both.select("id", F.explode(F.filter(F.array(gone, moved, edited), lambda p: p.isNotNull())).alias("problem")).distinct()
    twice = frozen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("problem"))
    out = found.unionByName(twice)
    if digest is None:
        return out
    own = frozen_digest(frozen.select(F.lit(1).alias("all"), entry(F.col("id"), F.col("sha256")).alias("h")), "all", "h").where(F.col("digest") != digest)
    return out.unionByName(own.select(F.lit(None).cast(frozen.schema["id"].dataType).alias("id"), F.lit("stale-digest").alias("problem")))
