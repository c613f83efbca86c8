"""Approximate nearest neighbours with randomly rotated one-bit codes.

Each vector is rotated by a fixed random orthogonal matrix (padded to CODE_BITS)
and kept as packed sign bits with two correction scalars: its length and the
inner product of its direction with its code. The inner product with a query is
estimated from the bits; its error is bounded with high probability by
ERROR_Z * sqrt((1 - c^2) / c^2) / sqrt(bits - 1), c being that second scalar.
Vectors whose upper bound reaches the k-th best exact score so far are reranked
on the original vectors in double precision. Every row is indexed.

Defined cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do rows with a null id; vectors of another dimension than the
query's do not meet it; components may be as large as the type holds; rows that
repeat id and vector count once; equal scores go to the smaller id; columns other
than vec_id and embedding play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import blocks_of, search, usable

CODE_BITS, ERROR_Z, SEED, K = 256, 2.2, 20240229, 20
_ROTATION: dict[tuple, np.ndarray] = {}


def rotation(dim: int, bits: int) -> np.ndarray:
    """dim orthonormal rows in ``bits`` dimensions, the same in every task."""
    if (dim, bits) not in _ROTATION:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((bits, dim)))
        _ROTATION[dim, bits] = (q * np.sign(np.diag(r))).T.copy()
    return _ROTATION[dim, bits]


def encode(b: np.ndarray) -> dict:
    """Packed bits, lengths and correction scalars of the rows of b."""
    bits = max(CODE_BITS, -(-b.shape[1] // 8) * 8)
    turned = b.astype(float) @ rotation(b.shape[1], bits)
    length = np.sqrt((turned**2).sum(1))
    code = turned > 0
    along = np.abs(turned).sum(1) / np.sqrt(bits) / np.maximum(length, 1e-300)
    return {"packed": np.packbits(code, axis=1), "length": length, "along": along, "bits": bits, "vectors": b}


def estimate(queries: np.ndarray, pack: dict, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (query by row) and the half-widths of their bounds."""
    bits = pack["bits"]
    unit = queries.astype(float)
    size = np.sqrt((unit**2).sum(1))[:, None]
    turned = (unit / np.maximum(size, 1e-300) @ rotation(queries.shape[1], bits)).astype(np.float32)
    signs = np.unpackbits(pack["packed"][rows], axis=1, count=bits).astype(np.float32) * 2 - 1
    # Single precision holds products of directions only; lengths of any size are multiplied in doubles.
    along = np.maximum(pack["along"][rows], 1e-300)
    both = size * pack["length"][rows]
    c2 = np.minimum(along**2, 1.0)
    wide = both * (np.sqrt((1 - c2) / c2) * ERROR_Z / np.sqrt(bits - 1))
    return both * ((turned @ signs.T) / (along * np.sqrt(bits))), np.where(np.isfinite(wide), wide, np.inf)


def _scan(a: np.ndarray, pack: dict, k: int, best: list, own: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
    full = pack["vectors"].astype(float)
    for rows in blocks_of(len(full), 4096):
        value, wide = estimate(a, pack, rows)
        for i in range(len(a)):
            upper = np.nan_to_num(value[i] + wide[i], nan=np.inf, posinf=np.inf, neginf=-np.inf)
            if len(best[i][1]) < k:
                first = np.argsort(-value[i], kind="stable")[: 2 * k]
                yield i, first + rows.start, (full[rows][first] * a[i].astype(float)).sum(1)
                upper[first] = -np.inf
            theta = best[i][1][-1] if len(best[i][1]) == k else -np.inf
            near = np.flatnonzero(upper >= theta)
            near = near[upper[near] > -np.inf]
            if len(near):
                scores = (full[rows][near] * a[i].astype(float)).sum(1)
                good = scores >= theta
                yield i, near[good] + rows.start, scores[good]


def _first(v):
    return F.pmod(F.xxhash64(v), F.lit(1 << 30)).cast("double")


def nearest(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """For ids divisible by ``every`` the k rows of largest inner product among all others."""
    rows = usable(vectors).where(F.exists("embedding", lambda x: x != 0))
    return search(rows, F.col("vec_id") % every == 0, k, _first, encode, _scan, "double")
