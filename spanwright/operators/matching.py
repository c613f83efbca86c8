"""One-to-one matching of two sides by keys of falling priority, and old decisions carried to new ids. Nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.storage import written

#: What a row that found no partner is called: others hold the same last key, or none does.
AMBIGUOUS, UNMATCHED = "ambiguous", "unmatched"


def _alone(rows: DataFrame, key: str, name: str) -> DataFrame:
    """key and id of the keys that one row holds."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min("id").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")


def by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left_id, right_id, round, state of rows (id, keys) of two sides; ids are distinct.

    In each round a key that one remaining row of each side holds makes a pair
    (state matched), which leaves both sides; any other waits for the next key. A
    null key takes no part in its round. What is left is ambiguous if a row of
    the other side holds the same last key, else unmatched.
    """
    sides = [left.select("id", *keys), right.select("id", *keys)]
    done = None
    for k, key in enumerate(keys):
        pairs = _alone(sides[0], key, "left_id").join(_alone(sides[1], key, "right_id"), "key").select("left_id", "right_id", F.lit(k + 1).alias("round"))
        pairs = written(pairs, "pairs")
        sides = [written(side.join(pairs, side["id"] == pairs[of], "left_anti"), "rest") for side, of in zip(sides, ("left_id", "right_id"), strict=True)]
        done = pairs if done is None else done.unionByName(pairs)
    last = [side.where(F.col(keys[-1]).isNotNull()).select(F.col(keys[-1]).alias("key")).distinct().withColumn("there", F.lit(True)) for side in sides]

    def left_over(side: DataFrame, other: DataFrame, name: str) -> DataFrame:
        both = side.join(other, side[keys[-1]] == other["key"], "left")
        ids = [F.col("id").alias(c) if c == name else F.lit(None).cast(side.schema["id"].dataType).alias(c) for c in ("left_id", "right_id")]
        return both.select(*ids, F.lit(None).cast("int").alias("round"), F.when(F.col("there"), AMBIGUOUS).otherwise(UNMATCHED).alias("state"))

    rest = left_over(sides[0], last[1], "left_id").unionByName(left_over(sides[1], last[0], "right_id"))
    return done.withColumn("state", F.lit("matched")).unionByName(rest)


def rekey(old: DataFrame, new: DataFrame, joined: DataFrame, ledger: DataFrame) -> DataFrame:
    """side (old or new), id, old_id, reason: which old decision applies to which new occurrence, and why none does.

    old and new: id, case_id, variant, peer, property, digest; joined: old_case and
    new_case, one to one; ledger: id of the old occurrences that have a decision.
    Two occurrences are the same if case, variant, peer and property are, and each
    is the only one of its side; their content must have the same digest, and the
    old one a decision (reason null). The first reason that holds is given, of a
    new row: peer-not-in-old-run, case-not-joined, no-old-occurrence, ambiguous,
    content-differs; of an old row: not-in-ledger, case-not-joined,
    no-new-occurrence, ambiguous, content-differs.
    """
    parts = ["case_id", "variant", "peer", "property"]
    key = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in parts]))
    cases = joined.select("old_case", "new_case")
    moved = old.join(cases, old["case_id"] == cases["old_case"], "left").withColumn("case_id", F.col("new_case")).withColumn("key", F.when(F.col("new_case").isNotNull(), key))
    moved = moved.join(ledger.select(F.col("id").alias("ledger_id")).distinct(), F.col("id") == F.col("ledger_id"), "left").withColumn("decided", F.col("ledger_id").isNotNull())
    moved = written(moved.select("id", "peer", "key", "digest", "decided"), "old")
    known = written(new.join(cases.select(F.col("new_case").alias("case")).distinct(), F.col("case_id") == F.col("case"), "left").select("id", "peer", key.alias("key"), "digest", F.col("case").isNotNull().alias("in_join")), "new")
    count = lambda rows, p: rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias(f"{p}n"), *[F.min(c).alias(f"{p}{c}") for c in ("id", "digest") + (("decided",) if p == "old_" else ())])
    olds, news = count(moved, "old_"), count(known, "new_")
    peers = moved.select("peer").distinct().withColumn("scanned", F.lit(True))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    several = (F.col("old_n") > 1) | (F.col("new_n") > 1)
    n = known.join(peers, "peer", "left").join(olds, "key", "left").join(news.select("key", "new_n"), "key", "left")
    why = (
        F.when(F.col("scanned").isNull(), "peer-not-in-old-run").when(~F.col("in_join"), "case-not-joined").when(F.col("old_n").isNull(), "no-old-occurrence")
        .when(several, AMBIGUOUS).when(~same("digest", "old_digest"), "content-differs").when(~F.col("old_decided"), "no-old-occurrence")
    )
    of_new = n.select(F.lit("new").alias("side"), "id", F.when(why.isNull(), F.col("old_id")).alias("old_id"), why.alias("reason"))
    o = moved.join(news, "key", "left").join(olds.select("key", "old_n"), "key", "left")
    fits = (F.col("old_n") == 1) & (F.col("new_n") == 1) & same("digest", "new_digest")
    why = (
        F.when(F.coalesce(fits, F.lit(False)) & ~F.col("decided"), "not-in-ledger").when(F.coalesce(fits, F.lit(False)), F.lit(None)).when(F.col("key").isNull(), "case-not-joined")
        .when(F.col("new_n").isNull(), "no-new-occurrence").when(several, AMBIGUOUS).otherwise("content-differs")
    )
    return of_new.unionByName(o.select(F.lit("old").alias("side"), "id", F.when(why.isNull(), F.col("id")).alias("old_id"), why.alias("reason")))


def property_of(ours: Column, theirs: Column) -> Column:
    """How two arrays of findings (start, end, family) differ: peer-only, reference-only, range-disagreement, classification-disagreement; null if they don't."""
    ranges = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda f: F.struct(f["start"], f["end"]))))
    named = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda f: F.struct(f["start"], f["end"], F.coalesce(f["family"], F.lit("")).alias("family")))))
    none = (F.size(ours) == 0) & (F.size(theirs) == 0)
    return (
        F.when(none, F.lit(None)).when(F.size(ours) == 0, "peer-only").when(F.size(theirs) == 0, "reference-only")
        .when(ranges(ours) != ranges(theirs), "range-disagreement").when(named(ours) != named(theirs), "classification-disagreement")
    )
