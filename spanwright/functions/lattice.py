"""Outcomes of a document's spans as functions of arrays in its row, so that scoring moves no row.

Spans are structs with start, end, env_start, env_end (the last two null without
an envelope), findings structs with start and end; both half-open byte ranges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranges import overlap_bytes, overlaps
from .text import let

OUTCOMES = ["MISS", "PARTIAL", "OVERBROAD", "COVERED", "EXACT"]
LEAKED = ["PARTIAL", "MISS"]
_RANGES = "array<struct<start:int,end:int>>"


def as_ranges(items: Column, start=lambda x: x["start"], end=lambda x: x["end"]) -> Column:
    return F.transform(items, lambda x: F.struct(start(x).cast("int").alias("start"), end(x).cast("int").alias("end")))


def envelopes(spans: Column) -> Column:
    """What findings of each span may touch."""
    return as_ranges(spans, lambda x: F.coalesce(x["env_start"], x["start"]), lambda x: F.coalesce(x["env_end"], x["end"]))


def union(ranges: Column) -> Column:
    """Merged ranges; those that touch are merged too."""

    def add(done: Column, x: Column) -> Column:
        return let(F.try_element_at(done, F.lit(-1)), lambda last: F.when(
            x["start"] <= last["end"],
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))))

    return F.aggregate(F.array_sort(ranges), F.array().cast(_RANGES), add)


def total(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))


def shared_bytes(one: Column, other: Column) -> Column:
    """Bytes that lie in both of two merged lists."""
    return F.aggregate(one, F.lit(0).cast("long"), lambda n, a: n + F.aggregate(other, F.lit(0).cast("long"), lambda m, b: m + overlap_bytes(a["start"], a["end"], b["start"], b["end"])))


def outcome(span: Column, findings: Column) -> Column:
    """EXACT, COVERED within the envelope, OVERBROAD, PARTIAL or MISS: the best that a finding by itself makes of the span."""
    low, high = F.coalesce(span["env_start"], span["start"]), F.coalesce(span["env_end"], span["end"])

    def rank(f: Column) -> Column:
        equal = (f["start"] == span["start"]) & (f["end"] == span["end"])
        holds = (f["start"] <= span["start"]) & (f["end"] >= span["end"])
        return F.when(equal, 4).when(holds & (f["start"] >= low) & (f["end"] <= high), 3).when(holds, 2).otherwise(1)

    near = F.filter(findings, lambda f: overlaps(span["start"], span["end"], f["start"], f["end"]))
    best = F.coalesce(F.array_max(F.transform(near, rank)), F.lit(0))
    return F.element_at(F.array(*map(F.lit, OUTCOMES)), best + 1)


def scored(spans: Column, findings: Column, merged: Column) -> Column:
    """The spans with outcome and leaked_bytes: what the merged findings lack of those that are PARTIAL or MISS."""

    def one(s: Column) -> Column:
        lost = (s["end"] - s["start"]).cast("long") - F.aggregate(merged, F.lit(0).cast("long"), lambda n, m: n + overlap_bytes(s["start"], s["end"], m["start"], m["end"]))
        return let(outcome(s, findings), lambda o: F.struct(*[s[c].alias(c) for c in ("family", "start", "end", "env_start", "env_end")], o.alias("outcome"), F.when(o.isin(LEAKED), lost).otherwise(F.lit(0).cast("long")).alias("leaked_bytes")))

    return F.transform(spans, one)
