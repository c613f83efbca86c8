"""Spelling variants: words at distance one, by a self-join of the vocabulary's trie.

Words are counted over all documents, sorted into ranges of about PART_WORDS
words, and each range is a part of the trie. Within a part, active nodes move
down level by level: from each branching node the pairs of its children (one
letter replaced) and of a grandchild with a child (one letter inserted) become
active, a pair's children stay active while they carry the same letter, and a
pair of ends is a pair of words. Nodes that lie in several parts are ancestors of
the parts' first or last words; what becomes active there must agree in all that
follows, so both sides are sent by a hash of what stands before and after the
letter (at most one entry a letter of the alphabet meets there), and found pairs
are verified. So a prefix that a third of all words share is cut like any other.

Words are runs of ASCII letters and U+00C0 to U+00FF, A to Z in lower case. So
that there is something to find, one run in MUTATED (by the checksum of document
and run) loses a letter first.

Defined cases: a null or empty text has no words; a very long text is a slice of
its own; words may be of any length; rows that repeat an id count each; runs of a
row with a null id lose no letter; other columns play no part; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernel import Words, equal_segments, segment_hashes, slices
from .storage import shuffle_partitions, written

LEAST_LETTERS, LEAST_COUNT, FACTOR, MUTATED = 6, 5, 5, 199
#: Words of a part of the trie (expected), bytes of text counted at once, levels that are walked before what is left starts anew.
PART_WORDS, AT_ONCE, LEVELS = 20_000, 4 << 20, 48
#: Hashes of what stands before and after a letter: polynomials modulo a prime; what they find is verified.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _accented(data: np.ndarray) -> np.ndarray:
    """Bytes of U+00C0 to U+00FF: 0xC3 and the byte after it."""
    lead = data == 0xC3
    lead[1:] |= lead[:-1].copy()
    return lead


def _count(part: pa.RecordBatch) -> pa.RecordBatch:
    """word, n of the words of LEAST_LETTERS or more in some documents."""
    words = Words(part.column("text"), _ASCII, lower=True, more=_accented)
    ids = part.column("doc_id").to_pylist()
    later = np.append(0, np.cumsum((words.data & 0xC0) == 0x80))
    letters = words.end - words.start - (later[words.end] - later[words.start])
    keep = np.flatnonzero(letters >= LEAST_LETTERS)
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    group, first = _grouped(words.data, start, end, segment_hashes(words.data, start, end))
    raw = words.data.tobytes()
    keys = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    pair, times = np.unique(doc * max(1, len(keys)) + group, return_counts=True)
    seeds = [None if i is None else zlib.crc32(b"%d:" % i) for i in ids]
    total: Counter = Counter()
    for p, n in zip(pair.tolist(), times.tolist(), strict=True):
        d, g = divmod(p, len(keys))
        key, seed = keys[g], seeds[d]
        if seed is not None and (h := zlib.crc32(key, seed)) % MUTATED == 0:
            word = key.decode()
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LETTERS:
                continue
            key = word.encode()
        total[key] += n
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _grouped(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each distinct byte range, and the first of each."""
    group, _ = pd.factorize(hashed)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(group), prepend=-1) > 0) if len(group) else np.zeros(0, np.int64)
    odd = np.flatnonzero(~equal_segments(data, start, end, first[group])) if len(group) else first
    if not len(odd):
        return group, first
    _, group = np.unique([data[s:e].tobytes() for s, e in zip(start, end, strict=True)], return_inverse=True)
    return group, np.unique(group, return_index=True)[1]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words with LEAST_LETTERS letters and LEAST_COUNT occurrences."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j in slices(batch.column("text"), AT_ONCE):
                yield _count(batch.slice(i, j - i))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _common(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and member of each range."""
    size = end - begin
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + begin[row]


class _Level:
    """The nodes of one depth: their parents and letters in order, first words, and whether they end a word or lie in several parts."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray, first: np.ndarray, ends: np.ndarray, shared: np.ndarray):
        self.parent, self.letter, self.first, self.ends, self.shared = parent, letter, first, ends, shared
        self.key = parent * (1 << 21) + letter

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and node of every child of some nodes of the level above."""
        return _spread(np.searchsorted(self.parent, nodes), np.searchsorted(self.parent, nodes, "right"))

    def child(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Child of each node by its letter, -1 without."""
        if not len(self.key):
            return np.full(len(nodes), -1)
        key = nodes * (1 << 21) + letters
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def _down(pairs: np.ndarray, one: _Level, two: _Level) -> np.ndarray:
    """Pairs of children that carry the same letter."""
    row, child = one.children(pairs[:, 0])
    other = two.child(pairs[row, 1], one.letter[child])
    return np.stack([child, other], 1)[other >= 0]


def near_words(words: list[str], shared: list[int]) -> list[tuple[int, int]]:
    """Pairs of distance one among sorted distinct words, without those that part at a node whose depth is at most the ``shared`` of its words."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(words), 0)]
    while stack:
        low, high, base = stack.pop()
        if high - low < 2:
            continue
        base += _common(words[low][base:], words[high - 1][base:])
        _walk(words, shared, low, high, base, out, stack)
    return out


def _walk(words: list[str], shared: list[int], low: int, high: int, base: int, out: list, stack: list) -> None:
    """One part of the trie from depth base on, for LEVELS levels; what lies deeper goes on the stack."""
    own = words[low:high]
    sizes = np.fromiter(map(len, own), np.int64, len(own)) - base
    limit = np.array(shared[low:high]) - base
    codes = np.array([[*map(ord, w[base : base + LEVELS])] + [0] * (LEVELS - len(w[base : base + LEVELS])) for w in own], np.int64)
    node = np.zeros(len(own), np.int64)
    none = np.zeros((0, 2), np.int64)
    above = None
    level = _Level(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), sizes[:1] == 0, limit[:1] >= 0)
    replaced, inserted = none, none

    def emit(x: np.ndarray, y: np.ndarray) -> None:
        out.extend(zip((x + low).tolist(), (y + low).tolist(), strict=True))

    for k in range(LEVELS):
        alive = np.flatnonzero(sizes > k)
        if not len(alive):
            return
        parent, letter = node[alive], codes[alive, k]
        new = np.append(True, (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1]))
        first = alive[new]
        below = _Level(parent[new], letter[new], first, sizes[first] == k + 1, limit[first] >= k + 1)
        node = np.full(len(own), -1)
        node[alive] = np.cumsum(new) - 1
        # A letter replaced: children of one node.
        each = np.arange(len(first))
        row, other = _spread(each + 1, np.searchsorted(below.parent, below.parent, "right"))
        siblings = np.stack([each[row], other], 1)[~level.shared[below.parent[row]]]
        replaced = np.concatenate([_down(replaced, below, below), siblings])
        # A letter inserted: a grandchild and the child of its own letter, which is another than that of its parent.
        further = none
        if above is not None:
            x = below.parent
            u = level.parent[x]
            d = level.child(u, below.letter)
            fits = (d >= 0) & (d != x) & ~above.shared[u]
            further = np.stack([each, d], 1)[fits]
            inserted = _down(inserted, below, level)
        inserted = np.concatenate([inserted, further])
        for pairs, two in ((replaced, below), (inserted, level)):
            both = below.ends[pairs[:, 0]] & two.ends[pairs[:, 1]]
            emit(below.first[pairs[both, 0]], two.first[pairs[both, 1]])
        longer = below.ends & level.ends[below.parent] & ~level.shared[below.parent]
        emit(below.first[longer], level.first[below.parent[longer]])
        above, level = level, below
    _deep(words, low, base + LEVELS, node, above, level, replaced, inserted, emit, stack)


def _deep(words: list[str], low: int, depth: int, node: np.ndarray, above: _Level, level: _Level, replaced: np.ndarray, inserted: np.ndarray, emit, stack: list) -> None:
    """Ends of the pairs that are active at the last level, by equal rests; nodes of several words are walked from there."""
    held: dict[int, list[int]] = {}
    for i in np.flatnonzero(node >= 0).tolist():
        held.setdefault(int(node[i]), []).append(i)
    upper: dict[int, list[int]] = {}
    for n, own in held.items():
        upper.setdefault(int(level.parent[n]), []).extend(own)
        if len(own) > 1:
            stack.append((low + own[0], low + own[-1] + 1, depth))
    for x, y in replaced.tolist():
        rest = {r: j for j in held.get(y, []) if (r := words[low + j][depth:])}
        hits = [(i, rest[r]) for i in held.get(x, []) if (r := words[low + i][depth:]) in rest]
        emit(*(np.array(c, np.int64) for c in zip(*hits, strict=True))) if hits else None
    for x, y in inserted.tolist():  # y is one level higher
        rest = {words[low + j][depth - 1 :]: j for j in upper.get(y, [])}
        hits = [(i, rest[r]) for i in held.get(x, []) if (r := words[low + i][depth:]) in rest and rest[r] != i]
        emit(*(np.array(c, np.int64) for c in zip(*hits, strict=True))) if hits else None
    for u, own in upper.items():
        if above.shared[u]:
            continue
        rest = {words[low + j][depth - 1 :]: j for j in own}
        hits = [(i, rest[r]) for i in own if (r := words[low + i][depth:]) in rest and node[rest[r]] != node[i]]
        emit(*(np.array(c, np.int64) for c in zip(*hits, strict=True))) if hits else None


def _entries(word: str, depth: int) -> Iterator[tuple]:
    """depth, hashes before and after, the letter left out (null: none), and whether what follows is another letter; for each depth up to ``depth``."""
    before, power = [0], [1]
    for c in word:
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    n = len(word)
    rest = lambda k: (before[n] - before[k] * power[n - k]) % _PRIME
    for k in range(min(depth, n) + 1):
        yield k, before[k], rest(k), None, False
        if k < n:
            yield k, before[k], rest(k + 1), word[k], k + 1 == n or word[k] != word[k + 1]


def _part(group: pa.Table) -> pa.Table:
    """Pairs within a part, and entries of its words for the nodes that it shares."""
    words = sorted(group.column("word").to_pylist())
    left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
    reach = lambda w, edge, most: -1 if most < 0 else min(_common(w, edge), most)
    shared = [max(reach(w, words[0], left), reach(w, words[-1], right)) for w in words]
    pairs = near_words(words, shared)
    both = [(words[a], words[b]) for x, y in pairs for a, b in ((x, y), (y, x))]
    rows = [(w, *entry) for w, h in zip(words, shared, strict=True) if h >= 0 for entry in _entries(w, h)]
    pad = [None] * len(both)
    columns = [[*x, *y] for x, y in zip([*zip(*both, strict=True)] or [[], []], [[r[0] for r in rows], [None] * len(rows)], strict=True)]
    rest = [[*pad, *(r[i] for r in rows)] for i in range(1, 6)]
    return pa.table({"word": pa.array(columns[0], pa.string()), "near": pa.array(columns[1], pa.string()), "depth": pa.array(rest[0], pa.int32()), "before": pa.array(rest[1], pa.int64()), "after": pa.array(rest[2], pa.int64()), "letter": pa.array(rest[3], pa.string()), "last": pa.array(rest[4], pa.bool_())})


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, near: both directions of every pair of words (distinct, column word) at distance one."""
    spark = vocabulary.sparkSession
    n = max(shuffle_partitions(spark), -(-vocabulary.count() // PART_WORDS))
    ranges = written(vocabulary.select("word").repartitionByRange(n, "word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id()), "ranges")
    edges = ranges.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("end"))
    order = Window.orderBy("part")  # a row a part
    edges = edges.select("part", "first", "end", F.lag("end").over(order).alias("earlier"), F.lead("first").over(order).alias("later"))

    def shared(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            depth = lambda a, b: -1 if b is None else _common(a, b)
            yield pd.DataFrame({"part": rows["part"], "left": [depth(a, b) for a, b in zip(rows["first"], rows["earlier"], strict=True)], "right": [depth(a, b) for a, b in zip(rows["end"], rows["later"], strict=True)]}).astype("int32")

    known = edges.mapInPandas(shared, "part int, left int, right int")
    found = ranges.join(known, "part").groupBy("part").applyInArrow(_part, "word string, near string, depth int, before long, after long, letter string, last boolean")
    found = written(found, "trie-parts")
    inside = found.where(F.col("near").isNotNull()).select("word", "near")
    entry = found.where(F.col("near").isNull()).drop("near")
    cut = entry.where(F.col("letter").isNotNull())
    other = entry.select("depth", "before", "after", F.col("word").alias("near"), F.col("letter").alias("other"))
    met = cut.join(other, ["depth", "before", "after"]).where((F.col("word") != F.col("near")) & (F.col("other").isNotNull() | F.col("last")))
    met = met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", F.col("other").isNull().alias("turn"))
    across = met.select("word", "near").unionByName(met.where("turn").select(F.col("near").alias("word"), F.col("word").alias("near")))
    return inside.unionByName(across)


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form: forms followed to the last; each round doubles the steps, and a form is FACTOR times as frequent, so rounds are few."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        both = written(roots.join(next_, "root", "left"), "roots")
        if both.where(F.col("further").isNotNull()).isEmpty():
            return roots
        roots = both.select("word", F.coalesce("further", "root").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of docs (doc_id, text)."""
    vocabulary = written(word_counts(docs), "vocabulary")
    pairs = near_pairs(vocabulary)
    others = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = pairs.join(others, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    joined = vocabulary.join(best, "word", "left").withColumn("has", F.coalesce(form_n >= FACTOR * F.col("n"), F.lit(False)))
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), form_n).alias("form_n")), "forms")
    roots = with_roots(joined.where(F.col("form").isNotNull()))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
