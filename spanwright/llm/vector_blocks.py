"""Queries against all vectors, block by block.

Equal vectors form one class that carries its smallest ids, so a vector with
very many copies costs as much as one. Classes are packed into blocks; each
block of queries meets each pack of candidates once, in a group of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

QUERY_BLOCK, PACK = 512, 16384
#: Most ranges of the order that packs are cut into.
RANGES = 256


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id whose embedding is neither null nor empty and has only finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False))).select("vec_id", "embedding")


def classes(rows: DataFrame, k: int) -> DataFrame:
    """``embedding, ids``: each distinct vector with its k + 1 smallest ids.

    That loses nothing: of equal vectors only the smallest ids can be among the
    first k, also if the query's own is left out. Rows that repeat id and vector
    count once. The rank filter limits each map task to k + 1 rows a vector
    before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.distinct().withColumn("nth", rank).where(F.col("nth") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, queries: Column, k: int, order: Callable, prepare: Callable, scan: Callable, score: str) -> DataFrame:
    """The k best of each query.

    order: column by which candidates are packed; prepare(matrix) -> state of a
    pack; scan(queries, state, ids, own, k) yields (row of query, ids, scores).
    """
    rows = vectors.where(queries).distinct()
    packs = written(classes(vectors, k).withColumn("dim", F.size("embedding")), "vectors")
    n_pack = max(1, -(-packs.count() // PACK))
    n_query = max(1, -(-rows.count() // QUERY_BLOCK))
    n_range = min(n_pack, RANGES)
    n_part = -(-n_pack // n_range)
    n_pack = n_range * n_part
    key = order(F.col("embedding"))
    cuts = [i / n_range for i in range(1, n_range)]
    bounds = packs.select(F.percentile_approx(key, cuts, 10000).alias("b")).first()["b"] or [] if cuts else []
    left = (
        rows.select("vec_id", F.array("vec_id").alias("ids"), "embedding", F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(n_query)).cast("int").alias("block"))
        .withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_pack - 1))))
    )
    # Packs are ranges of the order's value, split by hash if there are many; equal values at a bound are spread over the ranges that share it.
    low, high = (sum((F.when(key > b if after else key >= b, 1).otherwise(0) for b in bounds), F.lit(0)) for after in (True, False))
    right = (
        packs.withColumn("lo", low).withColumn("hi", high)
        .withColumn("range", F.col("lo") + F.pmod(F.xxhash64(F.element_at("ids", 1)), F.col("hi") - F.col("lo") + 1))
        .withColumn("pack", (F.col("range") * n_part + F.pmod(F.xxhash64(F.element_at("ids", 1), F.lit(5)), F.lit(n_part))).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    )

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            a, b = np.stack(q["embedding"].to_numpy()), np.stack(c["embedding"].to_numpy())
            best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in range(len(q))]
            own, ids = q["vec_id"].to_numpy(), c["ids"].to_numpy()
            for i, rows, scores in scan(a, prepare(b), k, best, own, ids):
                best[i] = merge(best[i], rows, scores, ids, own[i], k)
            for i, (x, s) in enumerate(best):
                out.append(pd.DataFrame({"query_id": own[i], "vec_id": x, "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found = left.groupBy("pack", "block", "dim").cogroup(right.groupBy("pack", "block", "dim")).applyInPandas(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merge(best: tuple, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple:
    """The k best of those so far and the classes ``rows``, without the query's own id; equal pairs of id and score count once, ties to the smaller id."""
    if not len(rows):
        return best
    found = [np.asarray(ids[r]) for r in rows]
    x = np.concatenate([best[0], *found])
    s = np.concatenate([best[1], np.repeat(scores, [len(f) for f in found])]) if len(best[1]) else np.repeat(scores, [len(f) for f in found])
    keep = x != own
    x, s = x[keep], s[keep]
    top = np.lexsort((x, -s))
    x, s = x[top], s[top]
    new = np.append(True, (x[1:] != x[:-1]) | (s[1:] != s[:-1]))[: len(x)]
    return x[new][:k], s[new][:k]


def blocks_of(n: int, size: int) -> Iterator[slice]:
    for i in range(0, n, size):
        yield slice(i, min(n, i + size))
