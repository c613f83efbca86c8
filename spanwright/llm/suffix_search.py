"""Benchmark passages in documents, found by binary search in suffix arrays of the documents.

Each slice of the documents is a shard: its words become numbers of the
benchmark's vocabulary, unknown words and word pairs that the benchmark lacks
cut it, and the suffixes of what is left are sorted (prefix doubling). Every
suffix of the benchmark is then searched in the shard by halving its interval of
the array word after word, which gives its longest match and all places; its
window (WINDOW words, or the whole of a shorter item) occurs at the places of the
interval at that depth. Shards are independent, so nothing is shuffled.

The benchmark is sent to the tasks in blocks of at most about BLOCK_BYTES; a
larger one makes several passes, one a block, whose findings are joined by
document. Long items are cut into parts that overlap by all but one word of a
window.

Defined cases: a null or empty text has no words; a very long text is a shard of
its own; rows that repeat an id are judged each; a null doc_id is kept like any
other; rows that repeat an item_id are one item, one with a null item_id takes
no part; an item without words has no windows; columns other than those named
play no part; an empty table of documents gives no rows, an empty benchmark no
hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import OTHER_SEED, Words, slices, window_hashes
from .storage import written

WINDOW = 10
#: Bytes of the benchmark in one pass, words of a part of an item, bytes of text of a shard.
BLOCK_BYTES, PART_WORDS, AT_ONCE = 8 << 20, 4096, 4 << 20
#: Bytes of words: digits, letters and all of other characters.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(column: pa.Array) -> Words:
    return Words(column, WORD_BYTES, lower=True)


@dataclass
class Block:
    """A part of the benchmark: its words as numbers from 1, with 0 after each part of an item."""

    vocabulary: np.ndarray  # hashes, sorted; the number of a word is its place + 1
    words: np.ndarray
    item: np.ndarray  # of each word
    place: np.ndarray  # of each word in its item
    pairs: np.ndarray  # keys of neighbouring words, sorted
    pair: np.ndarray  # of each word with the next, -1 without
    window: np.ndarray  # number of the distinct window that starts at each word, -1 without
    size: np.ndarray  # words of that window
    owners: np.ndarray  # items of each distinct window, one after the other
    bounds: np.ndarray
    longest: int
    shortest: int


def block_of(items: np.ndarray, places: np.ndarray, texts: pa.Array, whole: np.ndarray, width: int = WINDOW) -> Block:
    """The block of some parts of items; whole: whether a part is all of its item."""
    words = _words(texts)
    hashed = words.hashes()
    vocabulary, number = np.unique(hashed, return_inverse=True)
    n, at = len(hashed) + len(texts), np.arange(len(hashed)) + words.doc  # one place after each part stays 0
    seq, item, place = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    seq[at], item[at], place[at] = number + 1, items[words.doc], places[words.doc] + words.positions()
    key = seq[:-1] * (len(vocabulary) + 1) + seq[1:] if n else np.zeros(0, np.int64)
    joined = (seq[:-1] > 0) & (seq[1:] > 0) if n else np.zeros(0, bool)
    pairs = np.unique(key[joined])
    pair = np.full(n, -1)
    pair[:-1][joined] = np.searchsorted(pairs, key[joined])
    window, size = np.full(n, -1), np.zeros(n, np.int64)
    starts, names = [], []
    other = words.hashes(OTHER_SEED)
    for length in np.unique(np.minimum(words.count[words.count > 0], width)).tolist():
        first, second = window_hashes(hashed, length), window_hashes(other, length)
        begin = np.arange(len(first))
        begin = begin[words.doc[begin] == words.doc[begin + length - 1]]
        if length < width:  # only the whole of a shorter item is a window
            own = words.doc[begin]
            begin = begin[(words.count[own] == length) & whole[own]]
        starts.append(begin)
        names.append(np.stack([first[begin], second[begin], np.full(len(begin), length, np.uint64)], 1))
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    _, name = np.unique(np.concatenate(names), axis=0, return_inverse=True) if len(begin) else (None, np.zeros(0, np.int64))
    name = name.reshape(-1)
    window[at[begin]] = name
    size[at[begin]] = np.minimum(words.count[words.doc[begin]], width)
    owned = np.unique(np.stack([name, items[words.doc[begin]]], 1), axis=0) if len(begin) else np.zeros((0, 2), np.int64)
    bounds = np.searchsorted(owned[:, 0], np.arange(name.max(initial=-1) + 2))
    return Block(vocabulary, seq, item, place, pairs, pair, window, size, owned[:, 1], bounds, int(words.count.max(initial=0)), int(size[size > 0].min(initial=width)))


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of seq in the order of what follows, compared over at least ``depth`` numbers; prefix doubling."""
    _, rank = np.unique(seq, return_inverse=True)
    k = 1
    while k < depth and rank.max(initial=0) + 1 < len(seq):
        after = np.zeros(len(seq), np.int64)
        after[:-k] = rank[k:] + 1
        _, rank = np.unique(rank * (len(seq) + 1) + after, return_inverse=True)
        k *= 2
    return np.argsort(rank, kind="stable")


def _bound(seq: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
    """By halving: of each interval the first place whose number at this depth is at least ``word``."""
    low, high = low.copy(), high.copy()
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) >> 1
        less = seq[order[middle] + depth] < word[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]
    return low


@dataclass
class Shard:
    """Matches in a slice of the documents."""

    words: Words
    seq: np.ndarray  # words as numbers of the block, 0 between runs
    back: np.ndarray  # word of each place of seq
    order: np.ndarray  # the suffix array: places of seq
    suffix: np.ndarray  # places of the block's suffixes that were searched
    length: np.ndarray  # words of the longest match of each
    longest: np.ndarray  # its interval of the array, (n, 2)
    found: np.ndarray  # the interval of its window, (n, 2)


def search(column: pa.Array, block: Block) -> Shard:
    """The longest match of every suffix of the block, and where its window occurs."""
    words = _words(column)
    hashed = words.hashes()
    near = np.searchsorted(block.vocabulary, hashed)
    known = np.append(block.vocabulary, np.uint64(0))[near] == hashed if len(block.vocabulary) else np.zeros(len(hashed), bool)
    number = np.where(known, near + 1, 0)
    both = known[:-1] & known[1:] & (words.doc[:-1] == words.doc[1:])
    key = number[:-1] * (len(block.vocabulary) + 1) + number[1:]
    pair = np.searchsorted(block.pairs, key)
    both &= np.append(block.pairs, -1)[pair] == key
    # Runs of words that are joined by known pairs; shorter ones hold no window.
    begin = np.append(True, ~both)[: len(number)]
    run = np.cumsum(begin) - 1
    length = np.bincount(run) if len(run) else np.zeros(0, np.int64)
    keep = np.flatnonzero(known & (length[run] >= block.shortest)) if len(run) else np.zeros(0, np.int64)
    at = np.arange(len(keep)) + np.cumsum(begin[keep]) - 1
    seq = np.zeros(len(keep) + int(begin[keep].sum()) + 1, np.int64)
    back = np.full(len(seq), -1)
    seq[at], back[at] = number[keep], keep
    order = suffix_array(seq, block.longest)
    present = np.zeros(len(block.pairs) + 1, bool)
    inner = keep[both[np.minimum(keep, len(both) - 1)] & (keep < len(both))] if len(both) else np.zeros(0, np.int64)
    present[pair[inner]] = True
    suffix = np.flatnonzero((block.window >= 0) & (present[block.pair] | (block.size == 1)))
    low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(seq))
    longest, found = np.zeros((len(suffix), 2), np.int64), np.zeros((len(suffix), 2), np.int64)
    matched = np.zeros(len(suffix), np.int64)
    live, depth = np.arange(len(suffix)), 0
    while len(live):
        word = block.words[suffix[live] + depth]
        live, word = live[word > 0], word[word > 0]
        low[live] = _bound(seq, order, low[live], high[live], depth, word)
        high[live] = _bound(seq, order, low[live], high[live], depth, word + 1)
        live = live[low[live] < high[live]]
        depth += 1
        matched[live] = depth
        longest[live, 0], longest[live, 1] = low[live], high[live]
        full = live[block.size[suffix[live]] == depth]
        found[full] = longest[full]
    return Shard(words, seq, back, order, suffix, matched, longest, found)


def _spread(intervals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every place of the intervals."""
    size = intervals[:, 1] - intervals[:, 0]
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + intervals[row, 0]


def _hits(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are hit; row and distinct window of each pair that occurs."""
    window = block.window[shard.suffix]
    _, first = np.unique(window, return_index=True)
    row, place = _spread(shard.found[first])
    start, name, size = shard.back[shard.order[place]], window[first][row], block.size[shard.suffix[first]][row]
    edge = np.zeros(len(shard.words.doc) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + size, -1)
    owner = np.unique(np.stack([shard.words.doc[start], name], 1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
    return np.cumsum(edge[:-1]) > 0, owner[:, 0], owner[:, 1]


def items_digest(items: np.ndarray) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items.tolist()))).encode()).hexdigest()


def _parts(column: str) -> Iterator:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j in slices(batch.column(column), AT_ONCE):
                yield batch.slice(i, j - i)

    return run


def blocks(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks; one block at a time is in the driver."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts("text")(it):
            words = _words(batch.column("text"))
            ids = np.asarray(batch.column("item_id"))
            rows = []
            for d in range(len(ids)):
                i, j = int(words.first[d]), int(words.first[d + 1])
                for k in range(i, j, PART_WORDS):
                    if k > i and j - k < width:
                        break  # the part before ends with these words
                    last = min(j, k + PART_WORDS + width - 1)
                    rows.append((int(ids[d]), k - i, last - k == j - i, words.data[words.start[k] : words.end[last - 1]].tobytes().decode()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.string())], names=["item_id", "place", "whole", "text"])

    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = written(items.mapInArrow(cut, "item_id long, place long, whole boolean, text string"), "benchmark")
    n = -(-(parts.select(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    for b in range(n):
        own = parts if n == 1 else parts.where(F.pmod(F.xxhash64("item_id", "place", "text"), F.lit(n)) == b)
        table = own.toArrow().combine_chunks()
        yield block_of(np.asarray(table.column("item_id")), np.asarray(table.column("place")), table.column("text").combine_chunks(), np.asarray(table.column("whole")).astype(bool), width)


def overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
    sent = [spark.sparkContext.broadcast(b) for b in blocks(benchmark, width)]
    if len(sent) > 1:
        return _joined(docs, [_found(docs, b) for b in sent])
    none = items_digest(np.zeros(0, np.int64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, str]] = {}  # documents that share a passage share its items
        for part in _parts("text")(it):
            n_hit, n_items, sha = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), [none] * len(part)
            if sent:
                block = sent[0].value
                shard = search(part.column("text"), block)
                words = shard.words
                hit, owner, window = _hits(shard, block)
                n_hit = np.bincount(words.doc[hit], minlength=len(part))
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                for i in np.unique(owner).tolist():
                    own = window[edge[i] : edge[i + 1]]
                    if (key := own.tobytes()) not in known:
                        items = np.unique(np.concatenate([block.owners[block.bounds[w] : block.bounds[w + 1]] for w in own.tolist()]))
                        if len(known) > 50_000:
                            known.clear()
                        known[key] = len(items), items_digest(items)
                    n_items[i], sha[i] = known[key]
            else:
                words = _words(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(n_items), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema).withColumn("contaminated", F.col("n_hit") > 0)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def _found(docs: DataFrame, sent) -> DataFrame:
    """digest, hits, items of the texts that hold a window of one block."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts("text")(it):
            block = sent.value
            shard = search(part.column("text"), block)
            hit, owner, window = _hits(shard, block)
            at = np.flatnonzero(hit)
            doc = shard.words.doc[at]
            first = np.searchsorted(doc, np.arange(len(part) + 1))
            edge = np.searchsorted(owner, np.arange(len(part) + 1))
            rows = np.unique(owner).tolist()
            place = shard.words.positions()[at]
            hits = [place[first[i] : first[i + 1]] for i in rows]
            items = [np.unique(np.concatenate([block.owners[block.bounds[w] : block.bounds[w + 1]] for w in window[edge[i] : edge[i + 1]].tolist()])) for i in rows]
            digest = part.column("digest").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([digest, pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.int64()))], names=["digest", "hits", "items"])

    return _keyed(docs).mapInArrow(run, "digest string, hits array<long>, items array<long>").dropDuplicates(["digest"])


def _joined(docs: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The findings of all blocks by text, for each document; of a text that many share, one row is joined."""
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    merged = every.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = written(merged.select("digest", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256")), "found")

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts("text")(it):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(_words(part.column("text")).count.astype(np.int64))], names=["doc_id", "digest", "n_words"])

    counted = _keyed(docs).mapInArrow(count, "doc_id long, digest string, n_words long")
    out = counted.join(merged, "digest", "left")
    none = items_digest(np.zeros(0, np.int64))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _runs(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the block, place in the shard and length of every common run of a window or more that no word before prolongs."""
    row, at = _spread(shard.found)
    ours, theirs = shard.suffix[row], shard.order[at]
    before = np.where(ours > 0, block.words[ours - 1], 0)
    first = (before == 0) | (theirs == 0) | (before != shard.seq[theirs - 1])
    row, ours, theirs = row[first], ours[first], theirs[first]
    length = block.size[ours].copy()
    live = np.flatnonzero(length < shard.length[row])  # the longest match bounds the length
    while len(live):
        word = block.words[ours[live] + length[live]]
        live = live[(word > 0) & (word == shard.seq[theirs[live] + length[live]])]
        length[live] += 1
        live = live[length[live] < shard.length[row[live]]]
    return ours, theirs, length


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """item_id, item_start, doc_id, doc_start, length in words: every common run of a window or more that can't be prolonged (within a part of an item)."""
    spark = docs.sparkSession
    schema = "item_id long, item_start long, doc_id long, doc_start long, length long"
    out = spark.createDataFrame([], schema)
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for b in blocks(benchmark, width):
        sent = spark.sparkContext.broadcast(b)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in _parts("text")(it):
                block = sent.value
                shard = search(part.column("text"), block)
                ours, theirs, length = _runs(shard, block)
                word = shard.back[theirs]
                columns = [block.item[ours], block.place[ours], np.asarray(part.column("doc_id"))[shard.words.doc[word]], shard.words.positions()[word], length]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["item_id", "item_start", "doc_id", "doc_start", "length"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with all their columns."""
    spark = docs.sparkSession
    for b in blocks(benchmark, width):
        sent = spark.sparkContext.broadcast(b)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in _parts("text")(it):
                shard = search(part.column("text"), sent.value)
                places = shard.back[shard.order[_spread(shard.found)[1]]]
                clean = np.ones(len(part), bool)
                clean[shard.words.doc[places]] = False
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
