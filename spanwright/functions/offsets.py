"""Offset maps: where the byte offsets of a text go when it is rewritten character by character.

A map is a struct of ``base``, the bytes put before the text, and ``moves``, the
ascending byte positions of characters that grow, each as often as it grows by a
byte. An offset moves by the base and by the number of moves before it, which is
found by halving; so ranges and envelopes are carried without looking for values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Growth in bytes of each byte value when it is written within a JSON string; those below 0x20 without a short form take six bytes.
_JSON = np.zeros(256, np.int64)
_JSON[:0x20] = 5
_JSON[[0x08, 0x09, 0x0A, 0x0C, 0x0D, 0x22, 0x5C]] = 1


def _positions(texts: pd.Series, growth) -> pd.Series:
    def one(text: str | None) -> list[int]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        return np.repeat(np.arange(len(data)), growth(data)).tolist()

    return texts.map(one)


def _crlf(data: np.ndarray) -> np.ndarray:
    before = np.append(np.uint8(0), data[:-1])[: len(data)]
    return ((data == 0x0A) & (before != 0x0D)).astype(np.int64)


@F.pandas_udf(ArrayType(IntegerType()))
def crlf_moves(texts: pd.Series) -> pd.Series:
    """Line feeds without a carriage return before them."""
    return _positions(texts, _crlf)


@F.pandas_udf(ArrayType(IntegerType()))
def json_moves(texts: pd.Series) -> pd.Series:
    """Characters that a JSON string escapes."""
    return _positions(texts, lambda data: _JSON[data])


def offset_map(base: int, moves: Column | None = None) -> Column:
    return F.struct(F.lit(base).alias("base"), (F.array().cast("array<int>") if moves is None else moves).alias("moves"))


def count_below(ascending: Column, x: Column) -> Column:
    """How many elements of an ascending array are less than x, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(29, -1, -1)])
    fits = lambda at, step: (at + step <= F.size(ascending)) & (F.get(ascending, at + step - 1) < x)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def moved(offset: Column, of: Column) -> Column:
    """Where an offset of the old text lies in the new one."""
    return offset + of["base"] + count_below(of["moves"], offset)
