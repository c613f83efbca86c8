"""What filters remove alone, together and in every order, from one histogram of failure masks.

Each document gets a mask with a bit for every filter that it fails; the bits of
filters on the text are native expressions, the bit of repeated texts comes from
the smallest doc_id of each text (texts are told apart by SHA-256). A part needs
only the 2 ** filters counts of its masks: what a filter removes at a step of an
order is a sum over the masks that hold its bit and none of the earlier ones, so
all orders are enumerated from those cells and documents are read once.

A text copied by a third of all documents is counted before each shuffle: rows of
one text are reduced to their cells and smallest ids by the tasks that read them.

Defined cases: a null text is empty; a null part is the empty string; a text of
any length is worked on whole; rows that repeat an id are rows of their own, of
which none is a repeat of the other; a row with a null id is no repeat and none
of its text, and has no labels; a document that several rows of labels name is
good or toxic if one of them says so; other columns play no part; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .storage import written

NAMES = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text has too few words, too few distinct ones, too many capitals, or a symbol."""
    n = F.size(words)
    return [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * n.cast("long"),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        text.rlike(SYMBOLS),
    ]


def _mask(failures: list[Column]) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def masked(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask of the filters on the text, digest of the text; one small row a document."""
    text = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = text.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return worded.select("doc_id", "part", _mask(text_failures(F.col("text"), F.col("words"))).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: how many documents fail exactly the filters of each mask."""
    rows = written(masked(docs, part), "masks")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    each = rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("rows"))
    each = each.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    found = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("rows").alias("n"), F.min(F.struct("doc_id", "rows")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a text has a row for each part and pair of labels
    originals = F.when(F.col("first.doc_id") == least, F.col("first.rows")).otherwise(F.lit(0))
    repeat = 1 << (len(NAMES) - 1)
    split = found.withColumn("originals", originals).select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
        F.struct((F.col("mask") + repeat).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )).alias("c")).select("part", "c.mask", "c.n", "good", "toxic")
    unnamed = rows.where(F.col("doc_id").isNull()).groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    both = split.where("n > 0").unionByName(unnamed)
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _bits(letters: Column, names: str) -> Column:
    return sum((F.when(letters.contains(x), 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0))


def orders(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of the filters."""
    ways = F.split(F.lit(",".join("".join(p) for p in permutations(names))), ",")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2 ** filters
    steps = parts.withColumn("filter_order", F.explode(ways)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    own = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    before = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    steps = steps.withColumn("own", _bits(own, names)).withColumn("before", _bits(before, names))
    fails = lambda c: c["mask"].bitwiseAND(F.col("own")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    total = lambda test, value=lambda c: c["n"]: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(test(c), value(c)).otherwise(F.lit(0)))
    # Of the k filters that a document fails, each comes first in one k-th of the orders.
    share = lambda c: c["n"] * (F.lit(factorial(len(names))) / F.bit_count(c["mask"])).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(lambda c: fails(c) & ~gone(c)).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: fails(c) & ~gone(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: fails(c) & ~gone(c), lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The report of all orders of the five filters over docs (doc_id, text, part column), with labels (doc_id, quality, toxic)."""
    return orders(written(cells(docs, labels, part), "cells"))
