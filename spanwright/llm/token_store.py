"""Token ids in ORC files, written in ascending document order and read back.

ORC encodes the integer ids with its run-length encoding in stripes; row indexes
and a Bloom filter on doc_id let readers skip stripes, and stripes are read in
parallel. Files are ranges of doc_id, so a document's first token position is
the tokens of earlier files (one number a file) plus those before it in its own.

Encoding cuts texts where this tokenizer's pattern always begins a new piece (at
single spaces between other characters, and at marks of ENDS after letters or
digits) and encodes each distinct segment of a slice once; a bounded cache keeps
segments between slices. Segments of equal hash are compared byte by byte. The strings of special tokens are encoded as the
library does by default, as their ids.

Defined cases: a null or empty text has the end id only; a very long text is a
slice of its own; rows that repeat an id are rows of their own, whose starts
follow the checksums of their ids; a null id stands first; columns other than
doc_id and text play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import equal_segments, segment_hashes, slices, text_buffer
from .storage import new_path, shuffle_partitions, written

END_ID, CACHE_SEGMENTS, AT_ONCE = 0, 600_000, 4 << 20
#: Marks before which a letter or digit always ends a piece; none is in the string of a special token.
ENDS = b",.;:!?)\x22"
#: One piece of this tokenizer, after which a mark begins another.
LEAD = b" a"
STRIPE_BYTES, INDEX_STRIDE = 64 << 20, 1000
_STATE: dict = {}
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(ENDS)] = True
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _plain(b: np.ndarray) -> np.ndarray:
    return (b > 0x20) & (b < 0x7F)


def _solid_end(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the character before each end is surely no white space."""
    last, lead = data[end - 1], data[np.maximum(end - 2, 0)]
    return _plain(last) | ((last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead < 0xE0))


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which segments begin: texts, single spaces between characters that are surely no white space, and marks of ENDS after letters and digits."""
    n = len(data)
    begins = offsets[:-1][np.diff(offsets) > 0]
    if n < 3:
        return begins
    at = np.flatnonzero(data[1:-1] == 0x20) + 1
    right = data[at + 1]
    at = at[_solid_end(data, at) & (_plain(right) | ((right >= 0xC3) & (right < 0xE0)))]
    mark = np.flatnonzero(_MARK[data[1:]]) + 1
    left, lead = data[mark - 1], data[np.maximum(mark - 2, 0)]
    mark = mark[_ALNUM[left] | ((lead == 0xC3) & (left >= 0x80) & (left < 0xC0) & (left != 0x97) & (left != 0xB7))]
    text = np.searchsorted(offsets, at, "right") - 1
    at = at[(at > offsets[text]) & (at + 1 < offsets[text + 1])]
    cut = np.zeros(n, bool)
    cut[at] = cut[mark] = cut[begins] = True
    return np.flatnonzero(cut)


class Cache:
    """Ids of the segments met so far; emptied when it holds CACHE_SEGMENTS."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        size = self.tokenizer.get_vocab_size()
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])  # one character a byte
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin, self.size, self.arena = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, segments: dict[bytes, int]) -> None:
        """Encodes new segments by kind (see _kinds), those that may stand together many at a time: ids are told apart by their widths in bytes."""
        spaced, marked, other = ([k for k, kind in segments.items() if kind == want] for want in (1, 2, 0))
        joined = [*spaced, *[LEAD + k for k in marked]]
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        got = self.tokenizer.encode_batch_fast([b"".join(g).decode() for g in groups] + [k.decode() for k in other], add_special_tokens=False)
        ids = [np.array(x.ids, np.int32) for x in got]
        alone = np.fromiter(map(len, ids[len(groups) :]), np.int64, len(other))
        arena = np.concatenate([self.arena, *ids]) if ids else self.arena
        together = arena[len(self.arena) : len(arena) - int(alone.sum())]
        ends = np.searchsorted(np.cumsum(self.width[together]), np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))) + 1
        size = np.concatenate([np.diff(ends, prepend=0), alone]).astype(np.int64)
        begin = len(self.arena) + np.cumsum(size) - size
        begin[len(spaced) : len(joined)] += 1  # the lead is one id
        size[len(spaced) : len(joined)] -= 1
        first = len(self.begin)
        self.begin, self.size, self.arena = np.append(self.begin, begin), np.append(self.size, size), arena
        self.place.update(zip([*spaced, *marked, *other], range(first, first + len(size)), strict=True))


def _kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1: begins with a cut space, 2: begins with a mark; both end in no white space, so that another may follow. 0: others."""
    head, solid = data[starts], _solid_end(data, ends)
    after = data[np.minimum(starts + 1, len(data) - 1)]
    spaced = (head == 0x20) & (ends - starts > 1) & (_plain(after) | ((after >= 0xC3) & (after < 0xE0)))
    return np.where(solid & spaced, 1, np.where(solid & _MARK[head], 2, 0))


def encode(column: pa.Array, path: str) -> pa.ListArray:
    """Ids of each text, with END_ID at its end."""
    cache = _STATE.get(("cache", path)) or _STATE.setdefault(("cache", path), Cache(path))
    if len(cache.place) > CACHE_SEGMENTS:
        cache.clear()
    data, offsets = text_buffer(column)
    starts = _cuts(data, offsets)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    group, _ = pd.factorize(segment_hashes(data, starts, ends))
    first = np.flatnonzero(np.diff(np.maximum.accumulate(group), prepend=-1) > 0) if len(group) else np.zeros(0, np.int64)
    odd = np.flatnonzero(~equal_segments(data, starts, ends, first[group])) if len(group) else first
    group[odd] = len(first) + np.arange(len(odd))  # of equal hash but other bytes
    first = np.append(first, odd)
    raw = data.tobytes()
    keys = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    kinds = _kinds(data, starts[first], ends[first]).tolist() if len(first) else []
    new = {k: kind for k, kind in zip(keys, kinds, strict=True) if k not in cache.place}
    if new:
        cache.add(new)
    found = np.fromiter(map(cache.place.__getitem__, keys), np.int64, len(keys))
    each, begin = cache.size[found][group], cache.begin[found][group]
    before = np.cumsum(each) - each
    text = np.searchsorted(offsets, starts, "right") - 1
    total = int(each.sum())
    # Where each id comes from: one number higher than the id before it, but for the first of a segment.
    jump = np.ones(total, np.int64)
    some = np.flatnonzero(each)
    jump[before[some]] = np.diff(begin[some], prepend=0) - np.append(0, each[some][:-1] - 1)[: len(some)]
    per = np.bincount(text, weights=each, minlength=len(column)).astype(np.int64) + 1
    bounds = np.append(0, np.cumsum(per))
    out = np.full(bounds[-1], END_ID, np.int32)
    inner = np.ones(len(out), bool)
    inner[bounds[1:] - 1] = False  # the end id of each text
    out[inner] = cache.arena[np.cumsum(jump)] if total else 0
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes doc_id and ids of each row of docs (doc_id, text) as ORC files that are ascending ranges of doc_id."""
    rows = docs.select("doc_id", "text").withColumn("nth", F.xxhash64("text"))
    n = 2 * shuffle_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "nth")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j in slices(batch.column("text"), AT_ONCE):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), encode(part.column("text"), tokenizer)], names=["doc_id", "ids"])

    out = ordered.mapInArrow(run, "doc_id long, ids array<int>")
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(INDEX_STRIDE)}
    out.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, ids; with doc_ids the filter reaches the reader, which skips stripes by index and Bloom filter."""
    rows = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a table that write_tokens wrote."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column("ids")
            bounds = np.asarray(ids.offsets)
            values = memoryview(np.ascontiguousarray(np.asarray(ids.values), "<u4"))
            crc = [zlib.crc32(values[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())], names=["file", "doc_id", "n_tokens", "ids_crc32"])

    rows = tokens.select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids")
    each = written(rows.mapInArrow(run, "file string, doc_id long, n_tokens long, ids_crc32 long"), "token-counts")
    files = each.groupBy("file").agg(F.sum("n_tokens").alias("own")).withColumn("part", F.regexp_extract("file", r"^part-([0-9]+)", 1).cast("long"))
    before = files.withColumn("base", F.sum("own").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))).select("file", F.coalesce("base", F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    numbered = each.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return numbered.join(before, "file").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def store_and_digest(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return digest(read_tokens(spark, path))
