"""Values in documents that arrive in chunks, equal to those of the whole text whatever the cuts.

A value never spans a line end, so a document's state is the bytes since its last
line end, where they begin, and chunks that came before their turn. Chunks may cut
characters. Lines are searched once they are whole, the last one with the chunk
that is marked as the last.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanwright.functions.text import let
from spanwright.sources.fixtures import HOLDS, PATTERNS, TOKEN_HEAD, TOKEN_TAIL

SPANS = "doc_id long, family string, start int, end int, env_start int, env_end int"
_FIELDS = [("doc_id", pa.int64()), ("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("env_start", pa.int32()), ("env_end", pa.int32())]
_COMPILED = {family: (re.compile(pattern.encode()), HOLDS.get(family, "").encode()) for family, pattern in PATTERNS.items()}


@dataclass
class Reader:
    """What is left of one document: the open line, where it begins, the chunk that is due, and chunks that came early."""

    line: bytearray = field(default_factory=bytearray)
    start: int = 0
    due: int = 0
    early: dict[int, tuple[bytes, bool]] = field(default_factory=dict)
    done: bool = False

    def take(self, k: int, chunk: bytes, last: bool) -> Iterator[tuple]:
        """Values of the lines that chunk k completes; a chunk that came before is taken once."""
        if k >= self.due:
            self.early[k] = (chunk, last)
        while self.due in self.early and not self.done:
            data, end = self.early.pop(self.due)
            self.due += 1
            left = 0 if end else len(data) - data.rfind(b"\n") - 1  # only the new bytes are searched for a line end
            self.line += data
            self.done = end
            whole = len(self.line) - left
            if whole > 0 and (end or left < len(data)):
                yield from self._found(bytes(self.line[:whole]))
                self.line, self.start = self.line[whole:], self.start + whole

    def _found(self, text: bytes) -> Iterator[tuple]:
        for family, (pattern, holds) in _COMPILED.items():
            for m in pattern.finditer(text) if holds in text else ():
                a, b = m.start() + self.start, m.end() + self.start
                yield (family, a + TOKEN_HEAD, b - TOKEN_TAIL, a, b) if family == "token" else (family, a, b, None, None)


def cut(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, k, chunk, last: the text of each document in chunks of so many bytes; an empty or null one is a single empty chunk."""

    def pieces(raw: Column) -> Column:
        n = F.greatest(F.ceil(F.octet_length(raw) / size), F.lit(1)).cast("int")
        return let(n, lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), F.substring(raw, k * size + 1, F.lit(size)).alias("chunk"), (k == n - 1).alias("last"))))

    chunks = let(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), pieces)  # the bytes are taken once, not once a chunk
    return docs.select("doc_id", F.explode(chunks).alias("c")).select("doc_id", "c.*")


def _frame(doc_id: int, found: list[tuple]) -> pd.DataFrame:
    rows = pd.DataFrame([(doc_id, *f) for f in found], columns=["doc_id", "family", "start", "end", "env_start", "env_end"])
    return rows.astype({"start": "int32", "end": "int32", "env_start": "Int32", "env_end": "Int32"})


def values(chunks: DataFrame) -> DataFrame:
    """doc_id and the true values (family, start, end, env_start, env_end) of a batch of chunks (doc_id, k, chunk, last); each task reads its documents' chunks in order, one after the other."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = object(), Reader()  # no id equals the first
        for rows in it:
            found = []
            for doc_id, k, chunk, last in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if doc_id != now:
                    now, reader = doc_id, Reader()
                found += [(doc_id, *f) for f in reader.take(k, chunk, last)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*found, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    rows = chunks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("k").cast("long").alias("k"), "chunk", "last")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "k").mapInArrow(run, SPANS)


def values_stream(chunks: DataFrame) -> DataFrame:
    """The same of a stream of chunks, in any order; the state of a document goes with its last chunk."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reader = pickle.loads(state.get[0]) if state.exists else Reader()
        found = []
        for rows in parts:
            for r in rows.itertuples():
                found += reader.take(int(r.k), bytes(r.chunk), bool(r.last))
        if reader.done:
            state.remove()
        else:
            state.update((pickle.dumps(reader),))
        yield _frame(key[0], found)

    return chunks.groupBy("doc_id").applyInPandasWithState(run, SPANS, "reader binary", "append", GroupStateTimeout.NoTimeout)
