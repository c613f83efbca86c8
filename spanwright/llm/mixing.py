"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are a stream of documents, cut into blocks of BLOCK
words. Each output shard of SHARD slots draws its sources slot by slot, which
makes its counts a multinomial draw by the targets. The j-th slot of a source
takes block perm(j mod blocks) of a pseudorandom permutation of the source's
blocks (a swap-or-not network, which works for any size). What a source was
drawn above its whole number of slots goes to those drawn too seldom, so totals
meet the targets to a block and no block is taken more than twice.

Positions in a source's stream and slot numbers are running sums in two levels
(within parts of GROUP, then over parts), so no task holds a whole source.

Defined cases: a null source is a source of its own, the last; a null or empty
text has size 0 and nothing of it is taken; a very long text is cut into blocks
like any; rows that repeat an id are rows of their own, and of those that repeat
id, source and size the order follows the text's hash; a null id is an id; extra
columns are kept as they are, whatever their names; an empty table gives no rows.
One row a source comes to the driver, as each has a weight of its own.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import shuffle_partitions, written

BLOCK, SHARD, ROUNDS, SEED = 32, 4096, 16, 71
#: Rows of a source, or partial sums, that one task numbers at once (expected).
GROUP = 2000
#: Slots that one task numbers and permutes (expected).
SLOTS = 200_000
#: Most rows of a table of sources that is broadcast.
SMALL = 100_000
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"


def with_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size -> with target: min(weight * level, MOST * size), the level being such that all meet SHARE."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(one) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    rows = sizes.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = SHARE * F.sum("source_size").over(all_rows)
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / F.sum("weight").over(onward))
    # The level holds that leaves its own source uncapped with the fewest sources capped, which is the largest such.
    rows = rows.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(all_rows))
    return rows.withColumn("target", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("most")), F.col("most"))).select("source", "source_size", "target")


def permuted(x: Column, n: Column, key: Column) -> Column:
    """x of 0..n-1 under a pseudorandom permutation of that range, for each key another."""

    def step(now: Column, r: Column) -> Column:
        other = F.pmod(F.xxhash64(r, key, n) - now, n)
        return F.when(F.xxhash64(F.greatest(now, other), r, key) % 2 == 0, other).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def running(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over rows of the same key (nulls are a key) and a smaller order, which is unique in it and counts from 0."""
    cut = rows.withColumn("part_", F.floor(F.col(order) / GROUP))
    parts = cut.groupBy(key, "part_").agg(F.sum(value).alias("own_"))
    past = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base_", F.coalesce(F.sum("own_").over(past([key], "part_")), F.lit(0))).select(F.col(key).alias("key_"), F.col("part_").alias("of_"), "base_")
    inner = cut.withColumn("inner_", F.coalesce(F.sum(value).over(past([key, "part_"], order)), F.lit(0)))
    joined = inner.join(parts, inner[key].eqNullSafe(parts["key_"]) & (inner["part_"] == parts["of_"]))
    return joined.withColumn(name, F.col("base_") + F.col("inner_")).drop("part_", "key_", "of_", "base_", "inner_")


def placed(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, source, size, row) with start: words of the same source that stand before it."""
    n_chunks = max(1, docs.count() // GROUP)
    rows = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(n_chunks)))
    chunks = running(rows.groupBy("source", "chunk").agg(F.sum("size").alias("own")), "source", "chunk", "own", "base")
    chunks = chunks.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "base")
    inner = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = rows.join(chunks, rows["source"].eqNullSafe(chunks["s"]) & (rows["chunk"] == chunks["c"]))
    return joined.withColumn("start", F.col("base") + F.col("inner")).drop("s", "c", "base", "inner", "chunk")


def _first_above(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are x or less, by halving steps."""
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    table = F.array(*[F.lit(b) for b in bounds])
    more = lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), more)


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row a source, broadcast if it is small."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= SMALL else table


def taken_blocks(sources: DataFrame) -> DataFrame:
    """source, block, times: how often the mix takes each block. sources: source, source_size, target."""
    spark = sources.sparkSession
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    own = sources.where(F.col("source_size") > 0).withColumn("blocks", blocks)
    own = own.withColumn("want", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), 2 * F.col("blocks")))
    table = own.orderBy(F.col("source").asc_nulls_last()).select("source", "blocks", "want").collect()  # one row a source
    upto = [int(x) for x in accumulate(r["want"] for r in table)]
    n_slots = upto[-1] if table else 0
    known = _small(spark, [(r["source"], i, r["blocks"], r["want"]) for i, r in enumerate(table)], "source string, sid int, blocks long, want long")
    slots = spark.range(n_slots).select(F.floor(F.col("id") / SHARD).alias("shard"), _first_above(upto, F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(1, n_slots)))).alias("sid"))
    # Draws of each shard and source; a slot of a source is numbered by the draws of earlier shards and its place in its own.
    counts = written(slots.groupBy("shard", "sid").agg(F.count("*").alias("drawn")), "draws")
    got = {r["sid"]: r["n"] for r in counts.groupBy("sid").agg(F.sum("drawn").alias("n")).collect()}
    n_tasks = max(shuffle_partitions(spark), n_slots // SLOTS)
    drawn = running(counts, "sid", "shard", "drawn", "base").repartition(n_tasks, "sid", "shard").join(known, "sid")
    drawn = drawn.withColumn("j", F.explode(F.expr("sequence(base, base + drawn - 1)")))
    # Slots that sources lack, and those that others were drawn too many, matched in order.
    lack, first, spare, given = [], 0, 0, []
    for i, r in enumerate(table):
        extra = got.get(i, 0) - r["want"]
        if extra < 0:
            lack.append((first, first - extra, i, got.get(i, 0)))
            first -= extra
        elif extra > 0:
            given.append((i, spare))
            spare += extra
    plan = _small(spark, lack, "a long, b long, to int, had long")
    given = _small(spark, given, "from int, off long")
    keep = drawn.where(F.col("j") < F.col("want")).select("source", "sid", "blocks", "j")
    moved = drawn.where(F.col("j") >= F.col("want")).select("sid", "j", "want").join(given, F.col("sid") == F.col("from")).withColumn("m", F.col("off") + F.col("j") - F.col("want")).select("m")
    moved = moved.join(plan, (F.col("m") >= F.col("a")) & (F.col("m") < F.col("b"))).select(F.col("to").alias("sid"), (F.col("had") + F.col("m") - F.col("a")).alias("j"))
    moved = moved.join(known, "sid").select("source", "sid", "blocks", "j")
    every = keep.unionByName(moved)
    block = permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("sid"))
    return every.select("source", block.alias("block")).groupBy("source", "block").agg(F.count("*").alias("times"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and row (a hash of what tells rows of an id apart) of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), _row_hash().alias("row"))


def _row_hash() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def pieces(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Of each row of rows (source, start, size, ...) and block that it reaches into: from, upto (word positions in it), times."""
    cut = rows.where(F.col("size") > 0).withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK))))
    cut = cut.withColumn("from", F.greatest(F.col("block") * BLOCK, F.col("start")) - F.col("start")).withColumn("upto", F.least((F.col("block") + 1) * BLOCK, F.col("start") + F.col("size")) - F.col("start"))
    t = times.withColumnsRenamed({"source": "s", "block": "b"})
    return cut.join(t, cut["source"].eqNullSafe(t["s"]) & (cut["block"] == t["b"]), "left").drop("s", "b").withColumn("times", F.coalesce("times", F.lit(0)))


def _targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target: one row a source."""
    found = with_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).collect()
    return _small(rows.sparkSession, [tuple(r) for r in found], "source string, source_size long, target double")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs (doc_id, text, source)."""
    rows = written(sizes(docs), "sizes")
    sources = _targets(rows)
    found = pieces(placed(rows.where(F.col("size") > 0)), taken_blocks(sources))
    sums = found.groupBy("doc_id", "source", "start", "size").agg(F.sum((F.col("upto") - F.col("from")) * F.col("times")).cast("long").alias("taken")).drop("start")
    full = sums.unionByName(rows.where(F.col("size") == 0).select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    own = sources.withColumnRenamed("source", "s")
    return full.join(own, full["source"].eqNullSafe(own["s"])).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix with the columns of docs: for each document and nth taking (up to two) the words of its blocks taken so often.

    A document whose blocks were all taken keeps its text as it stands; else its
    words are joined by one space. n_chars, if there, is set anew. docs is read
    twice: for the sizes, and for the texts, which are shuffled once.
    """
    rows = written(sizes(docs), "sizes")
    light = placed(rows.where(F.col("size") > 0))
    found = pieces(light, taken_blocks(_targets(rows))).where(F.col("times") > 0).withColumn("nth", F.explode(F.expr("sequence(1, times)")))
    cuts = found.groupBy("doc_id", "source", "start", "size", "row", "nth").agg(F.array_sort(F.collect_list(F.struct("from", "upto"))).alias("cuts"))
    takes = cuts.groupBy("doc_id", "source", "start", "size", "row").agg(F.collect_list("cuts").alias("takes"))
    # Equal rows are numbered on both sides, so that each meets one.
    takes = takes.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("start"))).select(F.xxhash64("doc_id").alias("d"), F.col("row").alias("r"), F.col("copy").alias("c"), "size", "takes")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.xxhash64("doc_id").alias("id"), _row_hash().alias("row"))
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy("id", "row").orderBy(F.lit(0))))
    # The copy is compared, not a join key, so that the window's partitioning serves the join.
    both = own.join(takes, (own["id"] == takes["d"]) & (own["row"] == takes["r"]) & (own["copy"] - takes["c"] == 0))
    each = both.select("doc", "size", F.explode("takes").alias("cuts"))
    text = F.col("doc.text")
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.flatten(F.transform("cuts", lambda c: F.slice(w, (c["from"] + 1).cast("int"), (c["upto"] - c["from"]).cast("int")))))
    part = F.array_join(F.element_at(words, 1), " ")
    all_taken = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["upto"] - c["from"]) == F.col("size")
    each = each.withColumn("new", F.when(all_taken, text).otherwise(part))
    put = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return each.select(*[put.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
