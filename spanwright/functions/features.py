"""Thirty whole numbers that describe the shape of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Symbols (code points) of a value that are looked at, and the longest lag of the autocorrelation: fixed values of the vector's definition.
SYMBOLS, LONGEST_LAG = 256, 32
# Sizes of the alphabets of lower, upper, digit, symbol, and space or control.
ALPHABETS = [26, 26, 10, 32, 34]
NAMES = [
    "byte_len", "analysed_chars", "truncated", "distinct_symbols", "max_symbol_count", "shannon_entropy_q16", "min_entropy_q16", "information_bits_q16",
    "class_lower", "class_upper", "class_digit", "class_symbol", "class_space_control", "class_non_ascii", "class_count", "class_transitions", "class_alphabet_size",
    "entropy_efficiency_permille", "alphabet_efficiency_permille", "distinct_ratio_permille", "length_permille", "longest_run", "adjacent_repeat_permille", "repeated_bigram_permille",
    "smallest_period", "max_autocorrelation_permille", "max_autocorrelation_lag", "residual_symbols", "residual_entropy_q16", "residual_min_entropy_q16",
]


def log2_q16(x: int) -> int:
    """Binary logarithm in 65536ths from sixteen truncated squarings; 0 for 0."""
    whole = max(x.bit_length() - 1, 0)
    mantissa, bits = x << (32 - whole), 0
    for _ in range(16 if x else 0):
        mantissa = mantissa * mantissa >> 32
        carry = mantissa >> 33
        mantissa, bits = mantissa >> carry, bits << 1 | carry
    return whole << 16 | bits


#: Logarithms of all counts and alphabet sizes that SYMBOLS allows.
LOGARITHMS = [log2_q16(x) for x in range(SYMBOLS + sum(ALPHABETS) + 1)]


def permille(a: Column, b: Column) -> Column:
    return F.coalesce(F.floor(F.try_divide(1000 * a, b)), F.lit(0))


def _log(x: Column) -> Column:
    return F.get(F.lit(LOGARITHMS), x).cast("long")


def _entropies(symbols: Column, body) -> Column:
    """body(number of symbols, counts, Shannon and least entropy)."""
    counts = F.transform(F.array_distinct(symbols), lambda x: F.size(F.filter(symbols, lambda y: y == x)))
    whole = F.struct(F.size(symbols).alias("n"), counts.alias("counts"))

    def measures(x: Column) -> Column:
        spread = F.aggregate(x["counts"], F.lit(0).cast("long"), lambda a, c: a + c * _log(c))
        shannon = F.coalesce(F.greatest(_log(x["n"]) - F.floor(F.try_divide(spread, x["n"])), F.lit(0)), F.lit(0))
        least = F.coalesce(_log(x["n"]) - _log(F.array_max(x["counts"])), F.lit(0))
        return F.struct(x["n"].alias("n"), x["counts"].alias("counts"), shannon.alias("shannon"), least.alias("least"))

    return let(let(whole, measures), body)


def _classes(symbols: Column) -> Column:
    one = lambda c: F.when(c.between(0x61, 0x7A), 0).when(c.between(0x41, 0x5A), 1).when(c.between(0x30, 0x39), 2).when(c.between(0x21, 0x7E), 3).when((c <= 0x20) | (c == 0x7F), 4).otherwise(5)
    return F.transform(symbols, one)


def _size_of(classes: Column, one: int) -> Column:
    return F.size(F.filter(classes, lambda c: c == one))


def _residual(symbols: Column) -> Column:
    """Symbols that neither a repeat, nor an even step at lag 1 or 2, nor an earlier equal trigram foretells."""
    word = F.transform(symbols, lambda x, i: F.coalesce((F.get(symbols, i - 2).cast("long") * 2**21 + F.get(symbols, i - 1)) * 2**21 + x, F.lit(-1)))

    def left(trigrams: Column) -> Column:
        def foretold(x, i):
            before = lambda lag: F.get(symbols, i - lag)
            known = F.get(trigrams, i)
            return (before(1) == x) | (x + before(2) == 2 * before(1)) | (x + before(4) == 2 * before(2)) | ((known >= 0) & (F.array_position(trigrams, known) <= i))

        return F.filter(symbols, lambda x, i: ~F.coalesce(foretold(x, i), F.lit(False)))

    return let(word, left)


def evidence(value: Column) -> Column:
    """The vector of a value as array<bigint> in the order of NAMES; null for null."""
    length = F.length(value)
    points = F.transform(F.sequence(F.lit(1), F.greatest(F.least(length, F.lit(SYMBOLS)), F.lit(1))), lambda i: F.ascii(F.substring(value, i, F.lit(1))))
    symbols = F.when(length > 0, points).otherwise(F.array().cast("array<int>"))
    return F.when(value.isNotNull(), let(symbols, lambda s: _entropies(s, lambda e: let(_classes(s), lambda c: _vector(value, s, e, c)))))


def _vector(value: Column, s: Column, e: Column, classes: Column) -> Column:
    n, distinct, half = e["n"], F.size(e["counts"]), F.floor(e["n"] / 2).cast("int")
    of_class = [_size_of(classes, k) for k in range(6)]
    other = F.size(F.array_distinct(F.filter(s, lambda c: c > 0x7F)))
    alphabet = sum((F.when(count > 0, size).otherwise(0) for count, size in zip(of_class, ALPHABETS, strict=False)), other)
    repeats = F.size(F.filter(s, lambda x, i: F.get(s, i - 1) == x))
    starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
    run = let(starts, lambda at: F.array_max(F.transform(at, lambda p, i: F.coalesce(F.get(at, i + 1), n) - p)))
    pairs = F.filter(F.transform(s, lambda x, i: F.get(s, i - 1).cast("long") * 2**21 + x), lambda p: p.isNotNull())
    again = let(pairs, lambda p: F.size(p) - F.size(F.array_distinct(p)))
    period = F.when(half >= 1, F.get(F.filter(F.sequence(F.lit(1), half), lambda p: F.slice(s, F.lit(1), n - p) == F.slice(s, p + 1, n - p)), F.lit(0)))
    lags = F.sequence(F.lit(2), F.greatest(F.least(half, F.lit(LONGEST_LAG)), F.lit(2)))
    matches = F.transform(lags, lambda k: permille(F.size(F.filter(s, lambda x, i: F.get(s, i + k) == x)), n - k))
    peak = F.when(half >= 2, let(matches, lambda m: F.struct(F.array_max(m).alias("most"), (F.array_position(m, F.array_max(m)) + 1).alias("lag"))))
    rest = _entropies(_residual(s), lambda r: F.array(r["n"].cast("long"), r["shannon"], r["least"]))
    efficiency = lambda size: F.when(size >= 2, F.least(F.lit(1000), permille(e["shannon"], _log(size)))).otherwise(0)

    def put(p: Column) -> list[Column]:
        return [F.coalesce(p["most"], F.lit(0)), F.when(p["most"] > 0, p["lag"]).otherwise(0)]

    numbers = [
        F.octet_length(value), n, (F.length(value) > SYMBOLS).cast("int"), distinct, F.coalesce(F.array_max(e["counts"]), F.lit(0)), e["shannon"], e["least"], n * e["shannon"],
        *of_class, sum((F.when(count > 0, 1).otherwise(0) for count in of_class), F.lit(0)), F.size(F.filter(classes, lambda x, i: F.get(classes, i - 1) != x)), alphabet,
        efficiency(distinct), efficiency(alphabet), permille(distinct, n), permille(n, F.lit(SYMBOLS)), F.coalesce(run, F.lit(0)), permille(repeats, F.greatest(n - 1, F.lit(0))),
        permille(again, F.greatest(n - 1, F.lit(0))), F.coalesce(period, F.lit(0)),
    ]
    return F.concat(F.array(*[x.cast("long") for x in numbers]), let(peak, lambda p: F.array(*[x.cast("long") for x in put(p)])), rest)
