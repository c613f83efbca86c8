"""A corpus pipeline of five stages over documents, each a call of one operator.

Defined cases: a null or empty text has no language, so its document goes in the
first stage; rows that repeat an id are judged one by one there, and as copies of
one document in the second; a null id is kept by all stages; texts of any length
are worked on whole; columns besides doc_id, text and source are kept as they are,
whatever their names (n_chars is set anew where the text changes); empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwright.llm import language_id, mixing, ngram_join, pii, piece_scan
from spanwright.llm.storage import new_path, written

#: Share of a document's letters that its language must have.
LEAST_SCORE = 0.5
#: SQL can express neither the trained model nor the keyed permutations.
ORACLE_SQL = None


def _names(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _free(prefix: str, columns: list[str]) -> str:
    """The prefix, made longer until no column begins with it."""
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language and those of which no language has LEAST_SCORE of the letters."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    own = _free("found_", docs.columns)
    labelled = language_id.identify(docs, model, prefix=own)
    return labelled.where((F.col(f"{own}lang_pred") != "und") & (F.col(f"{own}score") >= LEAST_SCORE)).select(_names(docs))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate class the document of the smallest id; one row of those that repeat it."""
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull())
    rows = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") != F.col("class_id")).alias("copy"))
    odd = rows.where(F.col("copy") | (F.col("rows") > 1)).select(F.col("doc_id").alias("odd_id"), "copy")
    own = _free("row_", docs.columns)
    # Null ids are never odd; the salt spreads them. The window uses the join's partitioning, so texts are shuffled once.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    rows = docs.select(F.struct(*_names(docs)).alias("doc"), F.col("doc_id").alias(own), salt.alias("salt"), F.xxhash64("text").alias("order"))
    both = rows.join(odd.withColumn("odd_salt", F.lit(0).cast("long")), (F.col(own) == F.col("odd_id")) & (F.col("salt") == F.col("odd_salt")), "left")
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy(own, "salt").orderBy("order")))
    kept = both.where(F.col("odd_id").isNull() | (~F.col("copy") & (F.col("nth") == 1)))
    return kept.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text."""
    own = pii.pseudonymise(docs.select(F.struct(*_names(docs)).alias("doc"), "text"))
    put = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return own.select(*[put.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each time (at most two) that blocks of a document are taken, with those words."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text as count and checksum, and whether they decode to it."""
    return piece_scan.encode_digest(docs, piece_scan.model_path())


STAGES = [
    ("language_id", keep_identified),
    ("ngram_jaccard", keep_representatives),
    ("pii", pseudonymised),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    path = new_path(spark, f"stage-{STAGES[-1][0]}")
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
