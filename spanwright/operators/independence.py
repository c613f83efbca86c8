"""Shared shapes, similarity of word sets and linked groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwright.functions.text import let, normalize_values
from spanwright.storage import written

#: Fixed value: runs that count as values in a skeleton.
LONG_VALUE = "[A-Za-z0-9+/=_.~-]{16,}"
#: Least Jaccard similarity of a near-duplicate pair, and words of a shingle.
SIMILAR, WIDTH = 0.5, 3
#: Most buckets of the counts that order shingles (a byte each where they are sent), those of one merged row, and most bits of the filter of sets.
BUCKETS, RUN, FILTER_BITS = 1 << 24, 1 << 16, 1 << 26
#: Sets of a cell that are compared in one task at once, and rows of sets that are ordered at once.
CELL, SLICE = 64, 2000
#: Shingles that stand in more first parts than this join blocks of sets, not sets; most sets and shingles of a block, and shingles that are compared at once.
HEAVY, BLOCK, BLOCK_SHINGLES, WIDE = 64, 512, 1 << 20, 1 << 12
#: Shingles that two first parts must share (fewer if the threshold asks for fewer), for which each is longer by one less.
COMMON = 4


def shingles(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, shingles: the distinct runs of ``width`` words of the text in normal form; a shorter text is one run, one without words none."""
    words = F.filter(F.split(normalize_values(F.col("text")), r"[^\p{L}\p{N}⟨⟩_]+"), lambda w: w != "")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, width), " "))
    return docs.select("doc_id", words.alias("words")).where(F.size("words") > 0).select("doc_id", F.array_distinct(runs).alias("shingles"))


def similar_pairs(docs: DataFrame, threshold: float = SIMILAR, width: int = WIDTH) -> DataFrame:
    """a, b, copies_a, copies_b, similarity of pairs (a < b) with Jaccard similarity of shingles of the threshold or more.

    Texts of equal shingles are one class, named by its smallest id, and pairs are
    those of classes; a class of several texts is a pair with itself. Shingles are
    ordered from rare to common by counts in buckets (any order that is the same
    for all sets is right). Two sets so similar share COMMON of the first
    ``size - ceil(threshold * size) + COMMON`` shingles of each, or all that the
    threshold asks for, so only those are joined and counted, and pairs of too
    different sets are left out; the sets themselves, as 64-bit hashes, are sent
    once to each cell of linked sets and compared there. Sets that share a shingle
    of many sets are compared by blocks, so pairs of a large group of near copies
    are made where they come out.
    """
    hashed = F.array_sort(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s))))
    every = shingles(docs, width).select("doc_id", hashed.alias("shingles")).withColumn("key", F.unhex(F.sha2(F.array_join("shingles", ","), 256)))
    sets = every.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("shingles").alias("shingles"))
    sets = written(sets.select("doc_id", "copies", "shingles", F.monotonically_increasing_id().alias("no")), "shingle-sets")  # texts are read once
    first = _rarest(sets, threshold).withColumn("f", F.count("*").over(Window.partitionBy("s")))
    shared = written(first.where("f > 1"), "shared")
    blocks, cells = _blocks(shared.where(F.col("f") > HEAVY), threshold)
    light = shared.where(F.col("f") <= HEAVY)
    x, y = light.select("s", F.col("no").alias("a"), F.col("n").alias("na")), light.select("s", F.col("no").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, "s").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("k"), F.max(F.greatest("na", "nb")).alias("n")).where(F.col("k") >= F.least(F.lit(COMMON), F.ceil(threshold * F.col("n")))).select("a", "b")
    of = lambda name: blocks.select(F.col("no").alias(name), F.col("block").alias(f"l{name}"))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("p", F.when(F.col("lb").isNotNull(), F.least("la", "lb"))).withColumn("q", F.when(F.col("la").isNotNull(), F.greatest("la", "lb")))  # least passes over null
    pairs = pairs.join(cells, ["p", "q"], "left_anti").select("a", "b")
    found = _compared(written(pairs, "pairs"), sets, threshold)
    one = sets.select("no", "doc_id", "copies")
    side = lambda name: one.select(F.col("no").alias(name), F.struct("doc_id", "copies").alias(f"of_{name}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    low, high = F.least("of_a", "of_b"), F.greatest("of_a", "of_b")
    found = both.select(low["doc_id"].alias("a"), high["doc_id"].alias("b"), low["copies"].alias("copies_a"), high["copies"].alias("copies_b"), "similarity")
    same = one.where("copies > 1").select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"), F.lit(1.0).alias("similarity"))
    return found.unionByName(_compared_blocks(blocks, cells, sets, threshold)).unionByName(same)


def _commonness(sets: DataFrame) -> np.ndarray:
    """A byte for each bucket of shingles: the logarithm of how many stand in it."""
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    size = RUN
    while size < min(BUCKETS, total):
        size *= 2

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.uint32)
        for rows in it:
            np.add.at(n, rows.column(0).flatten().to_numpy(zero_copy_only=False) & np.int64(size - 1), np.uint32(1))
        for k in range(size // RUN):
            part = n[k * RUN : (k + 1) * RUN]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["run", "counts"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(RUN, np.float64)
        for counts in rows["counts"]:
            n += np.frombuffer(zlib.decompress(counts), np.uint32)
        level = np.minimum(255, np.round(8 * np.log2(1 + n))).astype(np.uint8)
        return pd.DataFrame({"run": rows["run"].iloc[:1], "level": [zlib.compress(level.tobytes(), 1)]})

    out = np.zeros(size, np.uint8)
    for r in sets.select("shingles").mapInArrow(count, "run int, counts binary").groupBy("run").applyInPandas(merge, "run int, level binary").collect():  # a byte a bucket
        out[r["run"] * RUN : (r["run"] + 1) * RUN] = np.frombuffer(zlib.decompress(bytes(r["level"])), np.uint8)
    return out


def _rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """s, no, n: the first shingles of each set (no, shingles) in the common order, and its size."""
    sent = sets.sparkSession.sparkContext.broadcast(_commonness(sets))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = sent.value
        for whole in it:
            for at in range(0, whole.num_rows, SLICE):
                rows = whole.slice(at, SLICE)
                s = rows.column(1).flatten().to_numpy(zero_copy_only=False)
                n = rows.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((s, level[s & np.int64(len(level) - 1)], row))
                place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                kept = place < np.repeat(n - np.ceil(threshold * n).astype(np.int64) + COMMON, n)
                own = row[kept]
                yield pa.RecordBatch.from_arrays([pa.array(s[order][kept]), rows.column(0).take(pa.array(own)), pa.array(n[own].astype(np.int32))], ["s", "no", "n"])

    return sets.select("no", "shingles").mapInArrow(run, "s long, no long, n int")


def _among(sets: DataFrame, numbers: DataFrame, *more: str) -> DataFrame:
    """no, shingles (and more columns) of the sets that can be among the numbers (column no) by a filter of bounded bits, so that most others stay at home."""
    size = 1 << 12
    while size < min(FILTER_BITS, 16 * numbers.count()):
        size *= 2
    words = numbers.select(F.pmod(F.xxhash64("no"), F.lit(size)).alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("b")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    sent = sets.sparkSession.sparkContext.broadcast(bits)
    kept = sets.select("no", "shingles", *more)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for rows in it:
            bit = rows.column(0).to_numpy(zero_copy_only=False)
            yield rows.select(range(1, rows.num_columns)).filter(pa.array((held[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return kept.select(F.pmod(F.xxhash64("no"), F.lit(size)).alias("bit"), *kept.columns).mapInArrow(run, kept.schema)


def _blocks(heavy: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Blocks (no, block) of the sets that hold heavy shingles (s, no, n), and the pairs (p, q) of blocks that share one; p is q for a block of several sets.

    Sets of the same least heavy shingle stand together, ordered by size, so near
    copies are in few blocks and blocks of too different sizes are no pair.
    """
    own = heavy.groupBy("no").agg(F.min("s").alias("key"), F.first("n").alias("n"))
    order = Window.partitionBy("key").orderBy("n", "no")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.floor(before / BLOCK_SHINGLES) + F.floor((F.row_number().over(order) - 1) / BLOCK)
    blocks = written(own.select("no", "n", F.xxhash64("key", part).alias("block")), "blocks")
    sizes = blocks.groupBy("block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("sets"))
    at = heavy.select("s", "no").join(blocks.select("no", "block"), "no").select("s", "block").distinct().join(sizes, "block")
    side = lambda name: at.select("s", F.col("block").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("lo", "hi", "sets")])
    near = (F.col("hi_p") >= threshold * F.col("lo_q")) & (F.col("hi_q") >= threshold * F.col("lo_p"))
    both = side("p").join(side("q"), "s").where(((F.col("p") < F.col("q")) | ((F.col("p") == F.col("q")) & (F.col("sets_p") > 1))) & near)
    return blocks.select("no", "block"), written(both.select("p", "q").distinct(), "cells")


def _shared(rows: np.ndarray, s: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles (s, of the rows) each left row shares with each right row, a bounded number of shingles at once."""
    _, column, count = np.unique(s, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, (_, column) = rows[shared], np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for base in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        at, to = np.searchsorted(column, (base, base + WIDE))
        there = np.zeros((int(max(left.max(), right.max())) + 1, WIDE), np.float32)
        there[rows[at:to], column[at:to] - base] = 1
        out += there[left] @ there[right].T
    return out


def _compared_blocks(blocks: DataFrame, cells: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, copies_a, copies_b, similarity of all pairs of sets in the cells (pairs p, q of blocks) that reach the threshold."""
    members = _among(sets, blocks.select("no"), "doc_id", "copies").join(blocks, "no")
    asked = cells.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    rows = asked.join(members, "block").select("p", "q", (F.col("block") == F.col("p")).alias("left"), "doc_id", "copies", "shingles")
    schema = f"a {sets.schema['doc_id'].dataType.simpleString()}, b {sets.schema['doc_id'].dataType.simpleString()}, copies_a long, copies_b long, similarity double"

    def compare(parts: list[pa.RecordBatch], twice: bool) -> pa.RecordBatch:
        cell = pa.Table.from_batches(parts).combine_chunks()
        first = cell["left"].to_numpy()
        ids, copies, sets_ = cell["doc_id"].to_numpy(), cell["copies"].to_numpy(), cell["shingles"].combine_chunks()
        n = sets_.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        left, right = np.flatnonzero(first), np.flatnonzero(first if twice else ~first)
        shared = _shared(np.repeat(np.arange(len(n)), n), sets_.flatten().to_numpy(zero_copy_only=False), left, right)
        similarity = shared / (n[left][:, None] + n[right][None, :] - shared)
        i, j = np.nonzero(np.triu(similarity >= threshold, 1) if twice else similarity >= threshold)
        x, y = left[i], right[j]
        swap = ids[x] > ids[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        kind = cell.schema.field("doc_id").type
        return pa.RecordBatch.from_arrays([pa.array(ids[x], kind), pa.array(ids[y], kind), pa.array(copies[x]), pa.array(copies[y]), pa.array(similarity[i, j])], ["a", "b", "copies_a", "copies_b", "similarity"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for rows in it:
            p, q = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            cuts = (np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist()
            for at, to in zip([0, *cuts], [*cuts, len(p)], strict=True):
                if at < to and now != (p[at], q[at]):
                    if held:
                        yield compare(held, now[0] == now[1])
                    held, now = [], (p[at], q[at])
                if at < to:
                    held.append(rows.slice(at, to - at))
        if held:
            yield compare(held, now[0] == now[1])

    return rows.repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(run, schema)


def _compared(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs (numbers a and b) that reach the threshold.

    A pair's cell is the least number linked to one of its sets, so the sets of a
    group of near copies meet in one cell; a cell of more than CELL sets is cut
    into blocks, and pairs of blocks are cells of their own.
    """
    ends = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("no", "other")
    label = written(ends.groupBy("no").agg(F.least(F.min("other"), F.first("no")).alias("label")), "labels")
    of = lambda name: label.select(F.col("no").alias(name), F.col("label").alias(f"l{name}"))
    placed = written(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.least("la", "lb").alias("cell")), "placed")
    blocks = placed.select("cell", F.explode(F.array("a", "b")).alias("no")).distinct().groupBy("cell").agg(F.ceil(F.count("*") / CELL).alias("blocks"))
    at = lambda c: F.pmod(F.xxhash64(c), "blocks").cast("int")
    placed = placed.join(blocks, "cell").select("a", "b", "cell", F.least(at("a"), at("b")).alias("lo"), F.greatest(at("a"), at("b")).alias("hi"))
    cell = ["cell", "lo", "hi"]
    members = placed.select(*cell, F.explode(F.array("a", "b")).alias("no")).distinct()
    there = _among(sets, label.select("no")).join(members, "no").select(*[F.col(c).alias(f"of_{c}") for c in cell], "no", "shingles")

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(held["no"].tolist(), map(np.asarray, held["shingles"]), strict=True))
        out = []
        for a, b in zip(asked["a"].tolist(), asked["b"].tolist(), strict=True):
            x, y = of[a], of[b]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            similarity = shared / (len(x) + len(y) - shared)
            if similarity >= threshold:
                out.append((a, b, similarity))
        return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return placed.groupBy(*cell).cogroup(there.groupBy(*[f"of_{c}" for c in cell])).applyInPandas(compare, "a long, b long, similarity double")


def entry(key: Column, sha: Column) -> Column:
    """The hash of an id with the hash of its content, so that two rows that swap contents change a digest."""
    return F.sha2(F.concat(key.cast("string"), F.lit("\t"), sha), 256)


def skeleton(text: Column, spans: Column) -> Column:
    """What is left of a text without its values: spans (array of byte ranges start and end) cut out by position, long value-like runs and white space reduced to one mark; one that begins within an earlier one is left out."""
    piece = lambda raw, a, b: F.hex(F.substring(raw, a + 1, b - a))
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    mark = F.hex(F.lit("⟨S⟩"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(raw: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            put = F.concat(a["out"], piece(raw, a["at"], s["start"]), mark)
            apart = s["start"] >= a["at"]
            return F.struct(F.when(apart, put).otherwise(a["out"]).alias("out"), F.when(apart, s["end"].cast("int")).otherwise(a["at"]).alias("at"))

        return F.aggregate(sorted_, start, step, lambda a: F.decode(F.unhex(F.concat(a["out"], piece(raw, a["at"], F.octet_length(raw)))), "UTF-8"))

    left = let(text.cast("binary"), cut)
    return F.trim(F.regexp_replace(F.regexp_replace(left, LONG_VALUE, "⟨V⟩"), r"[ \t]+", " "))


def by_family(values: DataFrame, spark) -> DataFrame:
    """family, raw, distinct_values, distinct_skeletons, upper_bound, axes, independent_axes, same_value_across_axes of values (family, doc_id, value, axis, skeleton).

    At most upper_bound documents can differ from all others in value and
    skeleton. Axes that share a value count as one independent axis; a value's
    rows on another axis than that of its smallest document are same_value_across_axes.
    """
    values = written(values, "values")  # texts are read once
    first = values.groupBy("family", "value").agg(F.min(F.struct("doc_id", "axis"))["axis"].alias("first_axis"))
    both = values.join(first, ["family", "value"])
    counts = both.groupBy("family").agg(F.count_distinct("doc_id").alias("raw"), F.count_distinct("value").alias("distinct_values"), F.count_distinct("skeleton").alias("distinct_skeletons"), F.count_distinct("axis").alias("axes"), F.count_if(F.col("axis") != F.col("first_axis")).alias("same_value_across_axes"))
    node = lambda c: F.to_json(F.array("family", c))
    links = both.where(F.col("axis") != F.col("first_axis")).select("family", node("axis").alias("a"), node("first_axis").alias("b")).distinct()
    merged = components(spark, links)
    lost = merged.groupBy(F.from_json("node", "array<string>")[0].alias("family")).agg((F.count("*") - F.count_distinct("comp")).alias("lost"))
    out = counts.join(lost, "family", "left")
    return out.select("family", "raw", "distinct_values", "distinct_skeletons", F.least("distinct_values", "distinct_skeletons").alias("upper_bound"), "axes", (F.col("axes") - F.coalesce("lost", F.lit(0).cast("long"))).alias("independent_axes"), "same_value_across_axes")


def frozen_digest(rows: DataFrame, key: str, hashes: str, digits: int = 4) -> DataFrame:
    """key, digest, rows: a digest of the hexadecimal hashes of each key in any order, by parts of the same first digits, so that no task holds a whole key."""
    part = F.substring(hashes, 1, digits)
    of = lambda c: F.sha2(F.array_join(c, ""), 256)
    parts = rows.groupBy(key, part.alias("part")).agg(of(F.array_sort(F.collect_list(hashes))).alias("d"), F.count("*").alias("n"))
    return parts.groupBy(key).agg(of(F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: x["d"])).alias("digest"), F.sum("n").alias("rows"))


def components(spark, edges: DataFrame) -> DataFrame:
    """node, comp (smallest reachable node) of edges (a, b).

    A round takes the least label among the neighbours, then that node's own
    label, so rounds grow with the logarithm of the longest path; each is written
    to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy("a").agg(F.min("c").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", "comp", F.least("comp", "near").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        new = new.join(far, "next", "left").select("node", "comp", F.least("next", F.coalesce("far", "next")).alias("next"))
        new = written(new, "labels")
        changed = new.where("comp <> next").limit(1).count()
        labels = new.select("node", F.col("next").alias("comp"))
        if not changed:
            return labels
