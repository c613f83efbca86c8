"""Removal of word windows that also start in a document with a smaller id.

Anchors are windows of ANCHOR words at positions p with p mod PERIOD in COVER, a
difference cover: for any two positions some shift below PERIOD puts both at
covered positions. As ANCHOR + PERIOD - 1 = WINDOW, any two equal windows of
WINDOW words hold an equal anchor at the same place. Three steps follow:

1. anchors that occur in two documents are found by hash (most occur once);
2. around those, every WINDOW-word window is hashed in full, and the smallest
   document of each is found;
3. words covered by a window that has a smaller document are removed.

Hashes go to buckets of about GROUP entries, so that a task holds a bounded part
whatever the size of the input. Within a slice of text a hash is reduced to its
smallest document before the shuffle, and what its other documents must learn is
decided there; a task remembers up to REMEMBERED hashes that it met in several
documents and asks for them once. So a passage of a third of all documents sends
about one entry a task. Anchor hashes are a filter only (a false match costs
work, not rows): 40 bits within a bucket, which other bits choose, so the share
of false matches stays the same at any size. Windows are told apart by 64 bits
within a bucket that a second hash, of the bytes of the words, chooses. The texts
are shuffled once, by doc_id, for both steps that need them again.

Defined cases: a null or empty text has no words and the hash of the empty
string; texts below WINDOW words lose nothing; a very long text is one slice of
its own; a document with a null id gives a row but takes no part; rows that
repeat an id are one document for the comparison, each giving its row; columns
other than doc_id and text play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .kernel import OTHER_SEED, Words, mix, segment_hashes, slices, window_hashes
from .storage import shuffle_partitions

WINDOW, ANCHOR, PERIOD = 13, 7, 7
COVER = (0, 1, 3)
#: Entries of a bucket (expected), bytes of text that are hashed at once, and repeated hashes that a task remembers.
GROUP, AT_ONCE, REMEMBERED = 1 << 20, 2 << 20, 1 << 18
#: Bytes of an anchor's hash within its bucket.
NARROW = 5
#: Bytes of text for each anchor (about six a word, of which three in seven start one).
BYTES_AN_ANCHOR = 14
_PACKED = "bucket int, known boolean, docs binary, hashes binary"
_STEPS = ("<u2", "<u4", "<i8")


class Memory:
    """Hashes that a task met in several documents, with the smallest document that it sent for each."""

    def __init__(self):
        self.key, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def smallest(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is remembered, and its document."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.key[at] == key, self.doc[at]

    def add(self, key: np.ndarray, doc: np.ndarray) -> None:
        old, _ = self.smallest(key)
        new = np.flatnonzero(~old)[: max(0, REMEMBERED - len(self.key))]
        took = np.concatenate([np.flatnonzero(old), new])
        key, doc = np.concatenate([self.key, key[took]]), np.concatenate([self.doc, doc[took]])
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        self.key, self.doc = key[first], doc[first]


def _pack(doc: np.ndarray, key: np.ndarray, bucket: np.ndarray, n_buckets: int, wide: bool, spare: int, memory: Memory) -> Iterator[tuple]:
    """Entries (doc, hash) of a slice by bucket; of a hash only the smallest doc asks, the others know already."""
    order = np.lexsort((doc, key))
    doc, key, bucket = doc[order], key[order], bucket[order]
    same = key[1:] == key[:-1]
    again = np.append(False, same & (doc[1:] == doc[:-1]))[: len(doc)]
    doc, key, bucket = doc[~again], key[~again], bucket[~again]
    same = key[1:] == key[:-1]
    later = np.append(False, same)[: len(doc)]  # has a smaller document in this slice
    shared = np.append(same, False)[: len(doc)]
    met, sent = memory.smallest(key)
    met &= sent < doc if wide else sent != doc
    memory.add(key[shared & ~later], doc[shared & ~later])
    ask = np.flatnonzero(~later & ~met)
    ask = ask[np.lexsort((doc[ask], bucket[ask]))]
    cuts = np.append(np.flatnonzero(np.diff(bucket[ask], prepend=-1)), len(ask))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own = ask[i:j]
        for known in (False, True) if not wide else (False,):
            rows = own[shared[own] == known] if not wide else own
            if len(rows):
                yield int(bucket[own[0]]), known, doc[rows], key[rows]
    told = np.flatnonzero(later | met if wide else later | shared | met)
    if len(told):
        yield n_buckets + spare % n_buckets, True, doc[told], key[told]


def _shorten(key: np.ndarray, width: int) -> bytes:
    return key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _lengthen(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _blobs(parts: Iterator[tuple], width: int) -> pa.RecordBatch:
    """Packed entries: documents as steps in the smallest type that holds them all, hashes cut to width bytes."""
    bucket, known, docs, hashes = [], [], [], []
    for b, k, d, h in parts:
        order = np.argsort(d, kind="stable")
        d = d[order]
        step = np.diff(d)
        most = step.max(initial=0)
        kind = 0 if most < 1 << 16 else 1 if most < 1 << 32 else 2
        bucket.append(b), known.append(k), hashes.append(_shorten(h[order], width))
        docs.append(bytes([kind]) + d[:1].astype("<i8").tobytes() + step.astype(_STEPS[kind]).tobytes())
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "known": pa.array(known, pa.bool_()), "docs": pa.array(docs, pa.binary()), "hashes": pa.array(hashes, pa.binary())})


def _docs(blob: bytes) -> np.ndarray:
    return np.cumsum(np.append(np.frombuffer(blob[1:9], "<i8"), np.frombuffer(blob[9:], _STEPS[blob[0]]).astype(np.int64)))


def _answers(group: pa.Table, n_buckets: int, wide: bool) -> pa.Table:
    """For a bucket: of entries whose hash has another document (or, if wide, a smaller one) the doc and hash."""
    width = 8 if wide else NARROW
    docs = [_docs(x.as_py()) for x in group.column("docs")]
    doc = np.concatenate(docs)
    key = np.concatenate([_lengthen(x.as_py(), width) for x in group.column("hashes")])
    known = np.repeat(group.column("known").to_numpy(zero_copy_only=False).astype(bool), [len(x) for x in docs])
    if group.column("bucket")[0].as_py() >= n_buckets:
        hit = np.ones(len(doc), bool)
    else:
        order = np.lexsort((doc, key))
        doc, key, known = doc[order], key[order], known[order]
        first = np.append(True, key[1:] != key[:-1])
        run = np.cumsum(first) - 1
        least, most = doc[first][run], doc[np.append(np.flatnonzero(first)[1:] - 1, len(doc) - 1)][run]
        hit = doc > least if wide else (least < most) & ~known
    return pa.table({"doc": pa.array(doc[hit]), "hash": pa.array(key[hit].view(np.int64))})


def _rounds(entries: DataFrame, n_buckets: int, wide: bool) -> DataFrame:
    """doc, hashes: what each document must know, from all buckets."""
    found = entries.groupBy("bucket").applyInArrow(lambda g: _answers(g, n_buckets, wide), "doc long, hash long")
    return found.groupBy("doc").agg(F.collect_list("hash").alias("hashes"))


def _anchors(words: Words, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word index and 64-bit hash of each anchor."""
    h = window_hashes(hashed, ANCHOR)
    at = np.arange(len(h))
    inside = words.doc[at] == words.doc[at + ANCHOR - 1] if len(at) else np.zeros(0, bool)
    covered = np.isin(words.positions()[: len(h)] % PERIOD, COVER)
    at = at[inside & covered]
    return at, h[at]


def _low(key: np.ndarray) -> np.ndarray:
    """The part of an anchor's hash that is sent; the rest chooses its bucket."""
    return key & np.uint64((1 << 8 * NARROW) - 1)


def _parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j in slices(batch.column("text"), AT_ONCE):
            yield batch.slice(i, j - i)


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of all hashes in a column of lists."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), np.asarray(column.flatten()).view(np.uint64)


def _tag(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1)))


def _windows(words: Words, hashed: np.ndarray, listed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word index and hash of the windows that hold an anchor whose hash is listed for its document."""
    at, key = _anchors(words, hashed)
    hit = at[np.isin(_tag(words.doc[at], _low(key)), _tag(*_listed(listed)))]
    h = window_hashes(hashed, WINDOW)
    open_ = np.zeros(len(h) + 1, np.int64)
    np.add.at(open_, np.clip(hit - (WINDOW - ANCHOR), 0, len(h)), 1)
    np.add.at(open_, np.clip(hit + 1, 0, len(h)), -1)
    start = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
    return (start := start[words.doc[start] == words.doc[start + WINDOW - 1]]), h[start]


def _other_hashes(words: Words, at: np.ndarray) -> np.ndarray:
    """A second hash, of other word hashes, of the windows at some words; only their words are hashed."""
    if not len(at):
        return np.zeros(0, np.uint64)
    used = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(used, at, 1)
    np.add.at(used, at + WINDOW, -1)
    own = np.flatnonzero(np.cumsum(used[:-1]) > 0)
    hashed = segment_hashes(words.data, words.start[own], words.end[own], OTHER_SEED)
    return window_hashes(hashed, WINDOW)[np.searchsorted(own, at)]


def _kept(words: Words, row: int, gone: np.ndarray) -> str:
    """SHA-256 of the words of a row that are not gone, joined by one space."""
    i, j = words.first[row], words.first[row + 1]
    if i == j:
        return hashlib.sha256(b"").hexdigest()
    base = words.start[i]
    data = words.data[base : words.end[j - 1]].tobytes()
    own = gone[i:j]
    if not own.any() and (words.start[i + 1 : j] - words.end[i : j - 1] == 1).all() and (words.data[words.end[i : j - 1]] == 0x20).all():
        return hashlib.sha256(data).hexdigest()
    keep = np.flatnonzero(~own)
    starts, ends = (words.start[i:j][keep] - base).tolist(), (words.end[i:j][keep] - base).tolist()
    return hashlib.sha256(b" ".join([data[s:e] for s, e in zip(starts, ends, strict=True)])).hexdigest()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    # No cast where none is needed: an alias would keep the two joins from sharing a shuffle.
    docs = docs.select("doc_id" if docs.schema["doc_id"].dataType == LongType() else F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(2 * shuffle_partitions(spark), -(-size // (BYTES_AN_ANCHOR * GROUP)))

    def anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for n, part in enumerate(_parts(it)):
            words = Words(part.column("text"))
            at, key = _anchors(words, words.hashes())
            bucket = ((key >> np.uint64(8 * NARROW)) % np.uint64(n_buckets)).astype(np.int64)
            yield _blobs(_pack(np.asarray(part.column("doc_id"))[words.doc[at]], key, bucket, n_buckets, False, int(part.column("doc_id")[0].as_py()) + n, memory), NARROW)

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for n, part in enumerate(_parts(it)):
            words = Words(part.column("text"))
            hashed = words.hashes()
            at, key = _windows(words, hashed, part.column("hashes"))
            other = _other_hashes(words, at)
            bucket = (other % np.uint64(n_buckets)).astype(np.int64)
            yield _blobs(_pack(np.asarray(part.column("doc_id"))[words.doc[at]], key, bucket, n_buckets, True, int(part.column("doc_id")[0].as_py()) + n, memory), 8)

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(it):
            words = Words(part.column("text"))
            gone = np.zeros(len(words.doc) + 1, np.int64)
            owner, flat = _listed(part.column("hashes"))
            if len(flat):
                told = np.zeros(len(part), bool)
                told[owner] = True
                own = np.flatnonzero(told[words.doc])  # words of the documents that lose some
                h = window_hashes(segment_hashes(words.data, words.start[own], words.end[own]), WINDOW)
                at = np.flatnonzero(words.doc[own[: len(h)]] == words.doc[own[WINDOW - 1 :]]) if len(h) else np.zeros(0, np.int64)
                at = own[at[np.isin(_tag(words.doc[own[at]], h[at]), _tag(owner, flat))]]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + WINDOW, -1)
            gone = np.cumsum(gone[:-1]) > 0
            removed = np.bincount(words.doc[gone], minlength=len(words.count))
            sha = [_kept(words, i, gone) for i in range(len(words.count))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.count), pa.array(removed), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    known = docs.where(F.col("doc_id").isNotNull()).hint("merge")  # both joins read one shuffle of the texts
    near = _rounds(known.mapInArrow(anchors, _PACKED), n_buckets, False)
    asked = known.join(near, known["doc_id"] == near["doc"]).select("doc_id", "text", "hashes")
    gone = _rounds(asked.mapInArrow(windows, _PACKED), n_buckets, True)
    told = known.join(gone, known["doc_id"] == gone["doc"], "left").select("doc_id", "text", "hashes")
    full = told.unionByName(docs.where(F.col("doc_id").isNull()).withColumn("hashes", F.lit(None).cast("array<long>")))
    return full.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
