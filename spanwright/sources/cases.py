"""Cases as JSON lines in parts: a document, its kind and tier, and its true spans; with a manifest of the parts and checks of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.functions.text import range_state

SPANS = "array<struct<family:string,start:int,end:int,env_start:int,env_end:int>>"
SCHEMA = f"doc_id long, source string, kind string, tier string, text string, spans {SPANS}"


def cases(docs: DataFrame, truth: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row a document with its spans in order."""
    span = F.struct("family", "start", "end", "env_start", "env_end")
    spans = truth.groupBy("doc_id").agg(F.array_sort(F.collect_list(span), lambda a, b: _order(a, b)).alias("spans"))
    whole = docs.select("doc_id", "text").join(fixtures.select("doc_id", "source", "kind", "tier"), "doc_id").join(spans, "doc_id", "left")
    return whole.select("doc_id", "source", "kind", "tier", "text", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _order(a: Column, b: Column) -> Column:
    key = lambda x: F.struct(x["start"], x["end"], x["family"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """part, rows, digest of the JSON lines as they stand; a part holds no more lines than it was written with."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("part"), F.sha2("value", 256).alias("h"))
    return lines.groupBy("part").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def write_parts(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """JSON lines of at most ``most`` a part, and a manifest of all parts beside them."""
    rows.write.option("maxRecordsPerFile", most).option("ignoreNullFields", "false").json(f"{path}/parts")
    parts(rows.sparkSession, f"{path}/parts").write.json(f"{path}/manifest")


def read_parts(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The rows; a line that is no JSON gives a row of nulls with the line in ``unreadable``."""
    row = F.from_json("value", f"{schema}, unreadable string", {"columnNameOfCorruptRecord": "unreadable"})
    return spark.read.text(f"{path}/parts").select(row.alias("x")).select("x.*")


def part_problems(spark: SparkSession, path: str) -> DataFrame:
    """part, problem: parts of the manifest that are missing or changed, and others that it doesn't name."""
    said = spark.read.schema("part string, rows long, digest string").json(f"{path}/manifest").select("part", F.struct("rows", "digest").alias("said"))
    both = said.join(parts(spark, f"{path}/parts").select("part", F.struct("rows", "digest").alias("now")), "part", "full")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("said").isNull(), "not-named").when(F.col("now") != F.col("said"), "changed")
    return both.select("part", problem.alias("problem")).where("problem is not null")


def case_problems(rows: DataFrame) -> DataFrame:
    """doc_id, family, problem of spans that are no range of the text (empty, outside, inside-character) or aren't within their envelope, and of ids that stand twice."""
    span = rows.select("doc_id", "text", F.explode("spans").alias("x")).select("doc_id", "text", "x.*")
    state = range_state(F.col("text"), F.col("start"), F.col("end"))
    beyond = (F.col("env_start") > F.col("start")) | (F.col("env_end") < F.col("end"))
    bad = span.select("doc_id", "family", F.when(state != "valid", state).when(beyond, "outside-envelope").alias("problem")).where("problem is not null")
    # An own shuffle of the ids: a union of tables that are dealt alike counts as dealt by doc_id even where its parts aren't.
    twice = rows.select("doc_id").repartition("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(None).cast("string").alias("family"), F.lit("repeated-id").alias("problem"))
    return bad.unionByName(twice)
