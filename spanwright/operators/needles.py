"""Which secrets, or which tell-tale parts of them, stand in which texts.

A secret's parts are its windows of WIDTH characters with at least VARIETY
different ones (a secret of WIDTH or less is its only part). Windows of all texts
that can be a part by a filter of hash bits (of at most FILTER_BITS, whatever the
number of secrets) are joined with the parts by hash and characters, so neither
secrets nor texts are sent to all tasks. Whole secrets are looked for only in the
texts that hold the part of them that fewest texts hold.

Texts and secrets that share a part are the result, which grows with the product
of both where many secrets have a part in common. They are joined in blocks of
BLOCK texts by BLOCK secrets a part, and a pair comes out once, at the first of
its parts, so nothing that grows so fast is shuffled, grouped or held.

Defined cases: null or empty texts and secrets take no part; secrets without a
part of enough variety are found as a whole, by their first WIDTH characters;
repeated rows count once; texts and secrets are compared by code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.storage import written

WIDTH, VARIETY = 12, 4
#: Most bits of the filter (8 MB), and bits for each part while there are fewer.
FILTER_BITS, BITS_A_PART = 1 << 26, 64
#: Texts, and secrets, of one part that are joined in one block, and pairs that a task makes about.
BLOCK, TASK_PAIRS = 4096, 20_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each of the sizes (ascending) that fits, with the hash of every window of so many characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(codes), np.uint64)
    for k in range(min(len(codes), max(sizes, default=0))):
        out = (out[: len(codes) - k] + codes[k:]) * _BASE
        out ^= out >> np.uint64(29)
        if k + 1 in sizes:
            yield k + 1, out


def _part_hashes(parts: list[str]) -> list[int]:
    """The same hash of each whole part, those of one length together."""
    sizes, out = np.array([len(p) for p in parts], np.int64), np.zeros(len(parts), np.uint64)
    for n in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == n)
        codes = np.frombuffer("".join(parts[k] for k in of.tolist()).encode("utf-32-le"), "<u4").reshape(len(of), n).astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(of), np.uint64)
        for k in range(n):
            h = (h + codes[:, k]) * _BASE
            h ^= h >> np.uint64(29)
        out[of] = h
    return out.astype(np.int64).tolist()


def parts(secrets: DataFrame, width: int = WIDTH) -> DataFrame:
    """secret, secret_no, part, hash, telling (false for the lead of a secret without telling windows) of distinct secrets (column secret)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for s, no in zip(rows["secret"], rows["secret_no"], strict=True):
                if len(s) <= width:
                    out.append((s, no, s, True))
                    continue
                own = {s[i : i + width] for i in range(len(s) - width + 1)}
                telling = [w for w in own if len(set(w)) >= VARIETY]
                out += [(s, no, w, True) for w in telling] or [(s, no, s[:width], False)]
            frame = pd.DataFrame(out, columns=["secret", "secret_no", "part", "telling"])
            frame["hash"] = np.array(_part_hashes(list(frame["part"])), np.int64)
            yield frame[["secret", "secret_no", "part", "hash", "telling"]]

    tasks = int(secrets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = secrets.where(F.length("secret") > 0).select("secret").repartition(tasks, "secret").distinct()  # by number: secrets are short, so their tasks must not be merged by size
    return known.withColumn("secret_no", F.monotonically_increasing_id()).mapInPandas(run, "secret string, secret_no long, part string, hash long, telling boolean")


def _filter(own: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of the parts' hashes, and the lengths of parts (at most WIDTH); both bounded."""
    facts = own.agg(F.count("*").alias("n"), F.collect_set(F.length("part")).alias("sizes")).first()
    size = 1 << 12
    while size < min(FILTER_BITS, BITS_A_PART * (facts["n"] or 0)):
        size *= 2
    bit = F.pmod(F.col("hash"), F.lit(size))
    words = own.select(F.floor(bit / 64).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(hash, {size}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return bits, sorted(facts["sizes"] or [])


def _held(texts: DataFrame, own: DataFrame) -> DataFrame:
    """text_id, hash, part: windows of the texts that can be parts by the filter, each once a text."""
    bits, sizes = _filter(own)
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def windows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = sent.value, np.int64(len(sent.value) * 64)
        for rows in it:
            ids, found, hashes = [], [], []
            for i, text in zip(rows["text_id"], rows["text"], strict=True):
                for width, every in _hashes(text, sizes):
                    bit = every.astype(np.int64) % size  # as pmod: the sign of the divisor
                    near = np.flatnonzero(held[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))
                    h, first = np.unique(every[near], return_index=True)
                    for value, at in zip(h.astype(np.int64).tolist(), near[first].tolist(), strict=True):
                        ids.append(i), found.append(text[at : at + width]), hashes.append(value)
            yield pd.DataFrame({"text_id": ids, "hash": hashes, "part": found}).astype({"hash": "int64"})

    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.mapInPandas(windows, f"text_id {kind}, hash long, part string")


def _linked(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left (text_id, code) joined with those of right (secret_no, code), in blocks of both for a code of many."""
    counts = left.groupBy("code").agg(F.count("*").alias("nt")).join(right.groupBy("code").agg(F.count("*").alias("ns")), "code")
    counts = written(counts, "counts")
    pairs = counts.agg(F.sum(F.col("nt").cast("double") * F.col("ns"))).first()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / TASK_PAIRS) + 1)
    blocks = counts.select("code", F.ceil(F.col("nt") / BLOCK).alias("nt"), F.ceil(F.col("ns") / BLOCK).alias("ns"))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        each = rows.join(blocks, "code").withColumn(own, F.pmod(F.xxhash64(key), own)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return each.repartition(tasks, "code", "nt", "ns")  # by number: few bytes make many rows, so the tasks must not be merged by size

    return dealt(left, "text_id", "nt", "ns").join(dealt(right, "secret_no", "ns", "nt"), ["code", "nt", "ns"])


def scan(texts: DataFrame, secrets: DataFrame, width: int = WIDTH, shown: Column | None = None) -> DataFrame:
    """text_id, secret, full, fragment of each text (text_id, text) and secret (column secret) that meet: whether all of it or a telling part stands there.

    ``shown`` (of column secret) is computed once a secret and stands in its place. Texts are read twice.
    """
    known = texts.where(F.length("text") > 0).select("text_id", "text")
    own = written(parts(secrets, width), "parts")
    # A part of one secret alone has that secret's code, so a secret has few codes of its own.
    coded = own.groupBy("hash", "part").agg(F.count("*").alias("n"), F.min("secret_no").alias("one")).withColumn("part_no", F.monotonically_increasing_id())
    coded = written(coded.withColumn("code", F.when(F.col("n") == 1, -1 - F.col("one")).otherwise(F.col("part_no"))), "codes")
    hits = _held(known, own).join(coded, ["hash", "part"]).select("text_id", "part_no", "code").distinct()
    hits = written(hits, "hits")
    often = hits.groupBy("part_no").agg(F.count("*").alias("texts"))
    mine = own.join(coded, ["hash", "part"]).join(often, "part_no", "left").fillna(0, ["texts"])
    mine = written(mine.select("secret_no", "secret", "part_no", "code", "n", "telling", "texts"), "secret-parts")

    rarest = mine.groupBy("secret_no", "secret").agg(F.min(F.struct("texts", "part_no")).alias("r")).where("r.texts > 0").select("secret_no", "secret", "r.part_no")
    full = hits.join(rarest, "part_no").join(known, "text_id").where(F.contains("text", F.col("secret"))).select("text_id", "secret_no").distinct()
    full = written(full, "full")

    name = F.col("secret") if shown is None else shown
    codes = mine.where("telling and texts > 0").select("secret_no", "secret", "n", "code").distinct()
    codes = codes.groupBy("secret_no", "secret").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("code").alias("code")))).alias("own"))
    codes = codes.select("secret_no", name.alias("secret"), F.transform("own", lambda x: x["code"]).alias("own")).select("secret_no", "secret", "own", F.posexplode("own").alias("at", "code"))
    codes = codes.select("secret_no", "secret", "code", F.slice("own", F.lit(1), F.col("at")).alias("earlier"))
    seen = hits.groupBy("text_id").agg(F.collect_set("code").alias("codes")).join(full.groupBy("text_id").agg(F.collect_list("secret_no").alias("whole")), "text_id", "left")
    seen = seen.select("text_id", "codes", F.coalesce("whole", F.array().cast("array<bigint>")).alias("whole"), F.explode("codes").alias("code"))
    met = _linked(seen, codes).where((F.size("earlier") == 0) | ~F.arrays_overlap("earlier", "codes"))
    met = met.select("text_id", "secret", F.array_contains("whole", F.col("secret_no")).alias("full"), F.lit(True).alias("fragment"))
    alone = mine.where("not telling").select("secret_no", name.alias("secret"))  # one row each: the lead
    return met.unionByName(full.join(alone, "secret_no").select("text_id", "secret", F.lit(True).alias("full"), F.lit(True).alias("fragment")))
