"""Measurement inputs derived from the documents table, each a pure function of a row.

Families of values are found by strict patterns (the authored truth); scanners
report the same ranges changed in a known way, so every state of the outcome
lattice occurs. Tiers and kinds follow from source and id. All of a document's
values and findings stand as arrays in its row; the long tables are made of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.ranges import match_ranges
from spanwright.functions.text import once

PATTERNS = {
    "email": r"[a-z]+\.[0-9]+@[a-z0-9]+\.example\.[a-z]+",
    "phone": r"\+1 \([0-9]{3}\) 555-[0-9]{4}",
    "card": r"[0-9]{16}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "token": r"token = \x22[0-9a-f]{40}\x22",
}
#: What every match of a pattern holds.
HOLDS = {"email": ".example.", "phone": ") 555-", "token": "token = \""}
LICENCE = "[Ll]icensed? under|MIT License"
SCANNERS = ["exact", "wide", "cut", "greedy", "silent"]
#: Bytes before and after the hexadecimal digits of a token assignment.
TOKEN_HEAD, TOKEN_TAIL = 9, 1
SPAN = "struct<family:string,start:int,end:int,env_start:int,env_end:int>"
FINDING = "struct<scanner:string,family:string,start:int,end:int,action:string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.octet_length("text").alias("bytes"))


def true_values(text: Column) -> Column:
    """Array of SPAN: the true values of a text; a token's envelope is its assignment."""

    def of(family: str, pattern: str) -> Column:
        head, tail = (TOKEN_HEAD, TOKEN_TAIL) if family == "token" else (0, 0)
        edge = (lambda c: c) if family == "token" else (lambda c: F.lit(None).cast("int"))
        named = F.transform(match_ranges(text, pattern, HOLDS.get(family, "")), lambda r: F.struct(
            F.lit(family).alias("family"), (r["start"] + head).cast("int").alias("start"), (r["end"] - tail).cast("int").alias("end"),
            edge(r["start"]).alias("env_start"), edge(r["end"]).alias("env_end"),
        ))
        return F.coalesce(named, F.array().cast(f"array<{SPAN}>"))

    return F.flatten(F.array(*[of(f, p) for f, p in PATTERNS.items()]))


def reported(text: Column, doc_id: Column, truth: Column, version: int = 1) -> Column:
    """Array of FINDING: what each scanner reports on a text; a second version of ``cut`` does better on odd ids."""
    action, none, size = F.when(doc_id % 5 == 0, "warn").otherwise("redact"), F.lit(None).cast("string"), F.octet_length(text)
    found = lambda scanner, family, start, end: F.struct(
        F.lit(scanner).alias("scanner"), family.alias("family"), start.cast("int").alias("start"), end.cast("int").alias("end"), action.alias("action")
    )

    def on_value(v: Column) -> Column:
        start, end = v["start"], v["end"]
        half = start + F.floor((end - start) / 2)
        cut_end = F.when((F.lit(version) == 2) & (doc_id % 2 == 1), end).otherwise(half)
        greedy = F.when(doc_id % 3 != 1, found("greedy", none, start, F.least(end + 20, size)))
        return F.array(found("exact", v["family"], start, end), found("wide", v["family"], F.greatest(start - 9, F.lit(0)), F.least(end + 1, size)), found("cut", v["family"], start, cut_end), greedy)

    noise = F.coalesce(match_ranges(text, LICENCE, "icense"), F.array().cast("array<struct<start:int,end:int>>"))
    on_noise = lambda r: F.array(found("wide", F.lit("licence"), r["start"], r["end"]), found("greedy", none, r["start"], r["end"]))
    both = F.concat(F.flatten(F.transform(truth, on_value)), F.flatten(F.transform(noise, on_noise)))
    return F.filter(both, lambda f: f.isNotNull())


def measured(docs: DataFrame, version: int = 1) -> DataFrame:
    """docs (doc_id, text, source, bytes) with truth and found (arrays of SPAN and FINDING), kind and tier: all that scoring needs of a document, in its row."""
    rows = once(docs, "truth", true_values(F.col("text")))
    kind = F.when(F.size("truth") == 0, "must-not-flag").when(F.col("doc_id") % 10 == 9, "policy").otherwise("must-redact")
    rows = rows.withColumn("found", reported(F.col("text"), F.col("doc_id"), F.col("truth"), version))
    return rows.withColumn("kind", kind).withColumn("tier", tier(F.col("doc_id"), F.col("source")))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, family, start, end, env_start, env_end, bytes: the true values."""
    return docs.select("doc_id", "bytes", F.explode(true_values(F.col("text"))).alias("x")).select("doc_id", "x.*", "bytes")


def findings(docs: DataFrame, version: int = 1) -> DataFrame:
    """scanner, doc_id, family, start, end, action: what each scanner reports."""
    rows = once(docs, "truth", true_values(F.col("text")))
    rows = rows.select("doc_id", F.explode(reported(F.col("text"), F.col("doc_id"), F.col("truth"), version)).alias("f"))
    return rows.select("f.scanner", "doc_id", "f.family", "f.start", "f.end", "f.action")


def twins(rows: DataFrame) -> DataFrame:
    """doc_id (of the positive), text, source, bytes, scope_family: each positive of rows (measured) with the last character of its first value changed, so that it is none."""
    first = F.array_min(F.transform("truth", lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end"), v["family"].alias("family"))))
    with_first = rows.where(F.size("truth") > 0).withColumn("v", first)
    raw = F.encode("text", "UTF-8")
    text = F.concat(F.decode(F.substring(raw, F.lit(1), F.col("v.end") - 1), "UTF-8"), F.lit("!"), F.decode(F.substring(raw, F.col("v.end") + 1, F.col("bytes")), "UTF-8"))
    return with_first.select("doc_id", text.alias("text"), "source", "bytes", F.col("v.family").alias("scope_family"))


def tier(doc_id: Column, source: Column) -> Column:
    """T0 (not yet assessed) for a seventeenth of the ids, else by the number of the source."""
    number = F.regexp_extract(source, "[0-9]+", 0)
    return F.when(doc_id % 17 == 0, "T0").otherwise(F.concat(F.lit("T"), (F.when(number == "", F.lit("0")).otherwise(number).cast("int") % 3 + 1).cast("string")))
