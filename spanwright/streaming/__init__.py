"""Incremental scoring, equal to the batch result, and a windowed monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.sources import fixtures as fx


def extract_stream(docs: DataFrame) -> DataFrame:
    """The truth spans of a stream of documents; a document is one row, so no span crosses a micro-batch."""
    return fx.spans(docs)


def monitor(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows; works on streams (late rows are dropped) and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_once(spark: SparkSession, source: str, schema, transform, checkpoint: str, output: str) -> None:
    """Reads a folder of Parquet files as a stream, file by file, and appends the transformed rows to output."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query.awaitTermination()
