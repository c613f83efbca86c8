"""Exact largest inner products of integer vectors, by norm buckets.

Candidates are packed by length; within a pack they stand in buckets of falling
length. With the k-th best score so far, theta, a bucket's local cosine
threshold for a query is theta / (|q| * longest). Above 1 the bucket is skipped;
above COORDINATE_FROM candidates must lie in the feasible interval of the
query's strongest coordinates; else a prefix by length is kept. Products of what
is left are computed exactly.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows with a null id; vectors of another dimension than the query's do not meet it; equal
scores go to the smaller id; equal rows of one id count once; an empty table
gives no rows; columns other than vec_id and embedding play no part. Products are
taken in the cheapest way that is exact for the largest components at hand: in
doubles while no sum can reach 2 ** 53, in longs below 2 ** 63, else in Python
integers; components and scores saturate at the range of long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import search, usable

BUCKET, FOCUS, COORDINATE_FROM, K = 2048, 3, 0.6, 20


def _norm(v):
    return -F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _prepare(b: np.ndarray) -> list[dict]:
    lengths = np.sqrt((b.astype(float) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    out = []
    for i in range(0, len(order), BUCKET):
        rows = order[i : i + BUCKET]
        size = lengths[rows]
        out.append({"rows": rows, "lengths": size, "vectors": b[rows].astype(float), "exact": b[rows], "unit": (b[rows] / np.maximum(size, 1e-300)[:, None]).astype(np.float32).T.copy()})
    return out


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _scan(a: np.ndarray, buckets: list[dict], k: int, best: list, own: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    size = np.sqrt((a.astype(float) ** 2).sum(1))
    most = max((_largest(x["exact"]) for x in buckets), default=0)
    bounds = [_largest(row) * most * a.shape[1] for row in a]
    for bucket in buckets:
        longest = bucket["lengths"][0]
        for i in range(len(a)):
            theta = best[i][1][-1] if len(best[i][1]) == k else None
            if theta is None:
                keep = np.arange(len(bucket["rows"]))
            else:
                local = theta / (size[i] * longest) if size[i] * longest > 0 else (2.0 if theta > 0 else -1.0)
                if local > 1 + 1e-9:
                    continue
                if local >= COORDINATE_FROM:
                    unit = a[i] / size[i]
                    within = np.arccos(min(1.0, local))
                    keep = None
                    for f in np.argsort(-np.abs(unit))[:FOCUS]:
                        at = np.arccos(np.clip(unit[f], -1, 1))
                        low, high = np.cos(min(np.pi, at + within)) - 1e-5, np.cos(max(0.0, at - within)) + 1e-5
                        x = bucket["unit"][f] if keep is None else bucket["unit"][f][keep]
                        ok = np.flatnonzero((x >= low) & (x <= high))
                        keep = ok if keep is None else keep[ok]
                elif theta > 0:
                    keep = np.arange(np.searchsorted(-bucket["lengths"], -(theta / size[i]) * (1 - 1e-9), "right"))
                else:
                    keep = np.arange(len(bucket["rows"]))
            if not len(keep):
                continue
            if bounds[i] >= 2**63:
                got = bucket["exact"][keep].astype(object) @ a[i].astype(object)
                scores = np.array([max(1 - 2**63, min(2**63 - 1, x)) for x in got], np.int64)
            elif bounds[i] >= 2**53:
                scores = bucket["exact"][keep] @ a[i]
            else:
                part = bucket["vectors"] if len(keep) == len(bucket["rows"]) else bucket["vectors"][keep]
                scores = np.rint(part @ a[i].astype(float)).astype(np.int64)
            if len(scores) > 2 * k + 2:
                values = np.unique(scores)  # an id with several vectors of one score is one neighbour
                cut = values[max(0, len(values) - k - 1)]
                cut = cut if theta is None else max(cut, theta)
                chosen = scores >= cut
                keep, scores = keep[chosen], scores[chosen]
            elif theta is not None:
                chosen = scores >= theta
                keep, scores = keep[chosen], scores[chosen]
            yield i, bucket["rows"][keep], scores


def exact_topk(vectors: DataFrame, every: int = 20, k: int = K, scale: int = 64) -> DataFrame:
    """Of floor(scale * x): for ids divisible by ``every`` the k largest inner products with all others."""
    ints = usable(vectors).withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")))
    return search(ints, F.col("vec_id") % every == 0, k, _norm, _prepare, _scan, "long")
