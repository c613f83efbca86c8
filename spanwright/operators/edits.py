"""Which edits lead from one text to another, and whether a twin changes exactly one property of its positive.

Texts of a pair are trimmed at both ends; what lies between is compared by a
longest common subsequence of characters. Of equally long ones insertions come
before deletions, and edits up to MERGE_GAP characters apart on one line are one.
A pair whose middle parts multiply to more than MOST_CELLS isn't compared
(diff-too-large), so work and memory are bounded for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.functions.text import let

MERGE_GAP, MOST_CELLS = 3, 4_000_000
_HUNK = "array<struct<a_start:int,a_end:int,b_start:int,b_end:int>>"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Characters that both share at the beginning, and of the rest at the end."""
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    head = int(other[0]) if len(other) else n
    n -= head
    other = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1]) if n else other[:0]
    return head, int(other[0]) if len(other) else n


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x[i:] and y[j:] for each i and j."""
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        row = best[i + 1].copy()
        row[:-1] = np.maximum(row[:-1], best[i + 1, 1:] + (y == x[i]))
        best[i] = np.maximum.accumulate(row[::-1])[::-1]
    return best


def hunks(a: str, b: str) -> list[tuple[int, int, int, int]] | None:
    """Ranges of characters of a and b that differ, in order; None if the pair is too large."""
    x, y = _codes(a), _codes(b)
    head, tail = _ends(x, y)
    u, v = x[head : len(x) - tail], y[head : len(y) - tail]
    if len(u) * len(v) > MOST_CELLS:
        return None
    best = _common(u, v) if len(u) and len(v) else np.zeros((len(u) + 1, len(v) + 1), np.int32)
    found: list[list[int]] = []
    i = j = 0
    together = True
    while i < len(u) or j < len(v):
        if i < len(u) and j < len(v) and u[i] == v[j]:
            i, j, together = i + 1, j + 1, True
            continue
        if together:
            found.append([i, i, j, j])
            together = False
        if j < len(v) and (i == len(u) or best[i, j + 1] >= best[i + 1, j]):
            j += 1
        else:
            i += 1
        found[-1][1], found[-1][3] = i, j
    merged: list[list[int]] = []
    for h in found:
        last = merged[-1] if merged else None
        if last is not None and h[0] - last[1] <= MERGE_GAP and 0x0A not in u[last[1] : h[0]]:
            last[1], last[3] = h[1], h[3]
        else:
            merged.append(list(h))
    return [tuple(k + head for k in h) for h in merged]


def with_hunks(pairs: DataFrame) -> DataFrame:
    """pairs with ``hunks`` from column ``a`` to column ``b``; null where a text is null or the pair too large."""
    names = [c for c in pairs.columns if c not in ("a", "b")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            found = [None if a is None or b is None else hunks(a, b) for a, b in zip(rows["a"], rows["b"], strict=True)]
            rows["hunks"] = [None if f is None else [dict(zip(("a_start", "a_end", "b_start", "b_end"), h, strict=True)) for h in f] for f in found]
            yield rows

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema), f"hunks {_HUNK}"])
    return pairs.mapInPandas(run, schema).select(*[F.col(f"`{c}`") for c in names], "a", "b", "hunks")


def audit_twins(twins: DataFrame, positives: DataFrame) -> DataFrame:
    """twin_id, positive_id, mutation_kind, hunks, value_hunks, context_hunks, flags (array) of twins (twin_id, positive_id, mutation_kind, text).

    positives: doc_id, text, spans (array of character ranges start and end). An
    edit is one of the value if it stays within a span or a character beside it.
    A twin of kind ``context`` must leave the values alone and make one edit, any
    other must edit one value once and nothing else; one of kind ``length`` may
    not also replace characters. missing-positive, identical and diff-too-large
    stand alone.
    """
    known = positives.select(F.col("doc_id").alias("positive_id"), F.col("text").alias("a"), "spans", F.lit(True).alias("there"))
    both = with_hunks(twins.withColumnRenamed("text", "b").join(known, "positive_id", "left"))
    none = F.array().cast(_HUNK)
    all_ = F.coalesce("hunks", none)
    near = lambda h: F.exists("spans", lambda s: (h["a_start"] >= s["start"] - 1) & (h["a_end"] <= s["end"] + 1))
    both = both.withColumn("value", F.filter(all_, near)).withColumn("context", F.filter(all_, lambda h: ~near(h)))
    value, context = F.size("value"), F.size("context")
    of_context = F.coalesce(F.col("mutation_kind") == "context", F.lit(False))
    resized = F.exists("value", lambda h: h["a_end"] - h["a_start"] != h["b_end"] - h["b_start"])
    replaced = F.exists("value", lambda h: (h["a_end"] > h["a_start"]) & (h["b_end"] > h["b_start"]))
    flag = lambda name, test: F.when(test, name)
    several = F.array(
        flag("context-twin-edits-value", of_context & (value > 0)),
        flag("multiple-context-edits", of_context & (context > 1)),
        flag("value-and-context", ~of_context & (context > 0)),
        flag("multiple-value-edits", ~of_context & (value > 1)),
        flag("length-and-content", (F.col("mutation_kind") == "length") & resized & replaced),
    )
    alone = F.when(F.col("there").isNull(), "missing-positive").when(F.col("hunks").isNull(), "diff-too-large").when(F.size("hunks") == 0, "identical")
    flags = F.when(alone.isNotNull(), F.array(alone)).otherwise(F.filter(several, lambda f: f.isNotNull()))
    return both.select("twin_id", "positive_id", "mutation_kind", F.size(all_).alias("hunks"), value.alias("value_hunks"), context.alias("context_hunks"), flags.alias("flags"))


def _shared_bytes(a: Column, b: Column, from_end: bool) -> Column:
    """Bytes that two binary values share at one end, by halving; a step compares only the bytes that it adds."""
    most = F.least(F.octet_length(a), F.octet_length(b))
    cut = (lambda x, at, n: F.substring(x, F.octet_length(x) - at - n + 1, n)) if from_end else (lambda x, at, n: F.substring(x, at + 1, n))
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= most) & (cut(a, at, step) == cut(b, at, step)), at + step).otherwise(at))


def changed_range(a: Column, b: Column) -> Column:
    """start, a_end, b_end in bytes: what differs after the common beginning and before the common end; null if nothing does.

    The common end never reaches into the common beginning.
    """

    def ends(x: Column) -> Column:
        room = F.least(F.octet_length(x["a"]), F.octet_length(x["b"])) - x["head"]
        shared = F.least(_shared_bytes(x["a"], x["b"], True), room)
        return let(shared, lambda tail: F.struct(x["head"].alias("start"), (F.octet_length(x["a"]) - tail).alias("a_end"), (F.octet_length(x["b"]) - tail).alias("b_end")))

    raw = F.struct(a.cast("binary").alias("a"), b.cast("binary").alias("b"))
    return F.when(a != b, let(raw, lambda x: let(F.struct(x["a"].alias("a"), x["b"].alias("b"), _shared_bytes(x["a"], x["b"], False).alias("head")), ends)))
