"""Differences between pairs of JSON documents of unknown shape, by path.

Objects are compared member by member, arrays by the meaning of their elements
(the members that a rule names for the array's path, else the position), never by
order. A path of a difference has ``*`` for each element; what is in one side
only ends in ``(added)`` or ``(removed)``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _names(items: list, rule: list[str] | None) -> dict[str, object]:
    """Elements by their key; one that repeats a key gets its number among those, so that none is lost."""
    out: dict[str, object] = {}
    for i, item in enumerate(items):
        key = "|".join(str(item.get(m, "")) for m in rule) if rule and isinstance(item, dict) else str(i)
        n = 1
        while key in out:
            n += 1
            key = f"{key}#{n}" if n == 2 else f"{key.rpartition('#')[0]}#{n}"
        out[key] = item
    return out


def differences(a: object, b: object, rules: list[tuple[str, list[str]]], ignored: frozenset[str] = frozenset()) -> Iterator[tuple[str, str]]:
    """Path with keys and path with stars of each difference; walked without recursion."""
    stack = [(a, b, "", "")]
    while stack:
        x, y, path, star = stack.pop()
        if isinstance(x, list) and isinstance(y, list):
            rule = next((members for pattern, members in rules if re.search(pattern, star)), None)
            p, q = _names(x, rule), _names(y, rule)
            for k in p.keys() | q.keys():
                if k in p and k in q:
                    stack.append((p[k], q[k], f"{path}/{k}", f"{star}/*"))
                else:
                    yield f"{path}/{k}", f"{star}/*({'removed' if k in p else 'added'})"
        elif isinstance(x, dict) and isinstance(y, dict):
            for k in (x.keys() | y.keys()) - ignored:
                if k in x and k in y:
                    stack.append((x[k], y[k], f"{path}/{k}", f"{star}/{k}"))
                else:
                    yield f"{path}/{k}", f"{star}/{k}"
        elif type(x) is not type(y) or x != y:
            yield path, star


def effects(pairs: DataFrame, rules: list[tuple[str, list[str]]], classes: list[tuple[str, str]], ignored: frozenset[str] = frozenset()) -> DataFrame:
    """id, path, kind (path with stars), class of each difference between the JSON texts before and after of pairs (id, before, after).

    classes are (pattern, class) of paths with stars, the first that matches holds;
    other differences are unexplained. A text that is null or no JSON is the string
    of itself, so it differs from any document.
    """
    schema = f"id {pairs.schema['id'].dataType.simpleString()}, path string, kind string"

    def parse(text: str | None) -> object:
        try:
            return None if text is None else json.loads(text)
        except ValueError:
            return text

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = [(i, *d) for i, a, b in zip(rows["id"], rows["before"], rows["after"], strict=True) for d in differences(parse(a), parse(b), rules, ignored)]
            yield pd.DataFrame(out, columns=["id", "path", "kind"])

    found = pairs.select("id", "before", "after").mapInPandas(run, schema)
    known = F.lit("unexplained")
    for pattern, name in reversed(classes):
        known = F.when(F.col("kind").rlike(pattern), name).otherwise(known)
    return found.withColumn("class", known)
