"""Byte ranges: half-open, so ranges that only touch do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import let


def match_ranges(text: Column, pattern: str, holds: str = "") -> Column:
    """Array of byte ranges (start, end) at which the pattern matches, in order; null if it doesn't. The text is searched once, not once a match, and only if it ``holds`` what every match holds."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def places(x: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            start = (s["at"] + F.octet_length(F.get(x["between"], i))).cast("int")
            end = (start + F.octet_length(F.get(x["found"], i))).cast("int")
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), empty, add, lambda s: s["out"])

    return F.when(F.contains(text, F.lit(holds)) & text.rlike(pattern), let(both, places))


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def overlap_bytes(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def union(rows: DataFrame, keys: list[str], touching: bool = True) -> DataFrame:
    """Merged ranges of each key; ranges that touch are merged unless told otherwise."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = before.isNull() | ((F.col("start") > before) if touching else (F.col("start") >= before))
    marked = rows.withColumn("_new", new.cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def covered(ranges: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bytes: how many bytes of the merged ranges the merged cover holds."""
    c = cover.select(*keys, F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    both = ranges.join(c, keys).where(overlaps(F.col("start"), F.col("end"), F.col("c_start"), F.col("c_end")))
    return both.groupBy(*keys).agg(F.sum(overlap_bytes(F.col("start"), F.col("end"), F.col("c_start"), F.col("c_end"))).alias("bytes"))


def bytes_outside(ranges: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outside: bytes of the union of ranges that the union of cover lacks."""
    merged = union(ranges, keys)
    total = merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    inside = covered(merged, union(cover, keys), keys)
    return total.join(inside, keys, "left").select(*keys, (F.col("total") - F.coalesce("bytes", F.lit(0))).cast("long").alias("outside"))
