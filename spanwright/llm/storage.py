"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanwright.storage import new_path, shared_dir, written

__all__ = ["new_path", "shared_dir", "shuffle_partitions", "written"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
