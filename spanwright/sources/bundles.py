"""Sets of tables stored by content: objects named by their digest, a manifest of them, and a pointer that is written last.

A commit that is interrupted anywhere leaves the pointer before it, so readers see
the old set or the new one. A table whose content is there already isn't written
again. All files are written and read by Spark, in any store that it can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.operators.independence import frozen_digest
from spanwright.storage import written

_POINTER, _MANIFEST = "bundle string", "name string, digest string, rows long"


def digest(df: DataFrame) -> tuple[str, int]:
    """A digest of the rows in any order, with their columns' names and types, and their number."""
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}), 256)
    found = frozen_digest(df.select(F.lit(1).alias("all"), row.alias("h")), "all", "h").first()
    schema = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)
    whole = df.sparkSession.range(1).select(F.sha2(F.lit(f"{schema}|{found['digest'] if found else ''}"), 256).alias("d")).first()["d"]
    return whole, found["rows"] if found else 0


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to the path has ended."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished pointers, in order; a number a commit."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit() and _complete(spark, f"{root}/pointers/{n}"))


def store(spark: SparkSession, root: str, df: DataFrame) -> tuple[str, int, bool]:
    """Digest and rows of df, and whether it was written: not if the object is there."""
    staged = written(df, "staged")
    name, rows = digest(staged)
    path = f"{root}/objects/{name}"
    if _complete(spark, path):
        return name, rows, False
    staged.write.mode("overwrite").parquet(path)  # what an interrupted write left goes
    return name, rows, True


def stage(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> tuple[str, int]:
    """Stores the tables and their manifest without making them current; the bundle's name and how many objects were written."""
    entries, wrote = [], 0
    for name, df in sorted(tables.items()):
        found, rows, new = store(spark, root, df)
        entries.append((name, found, rows))
        wrote += new
    manifest = spark.createDataFrame(entries, _MANIFEST)
    bundle = digest(manifest)[0]
    if not _complete(spark, f"{root}/manifests/{bundle}"):
        manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{bundle}")
    return bundle, wrote


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> tuple[str, int]:
    """Stores the tables and makes them the current set; the bundle's name and how many objects were written."""
    bundle, wrote = stage(spark, root, tables)
    n = (_pointers(spark, root) or [0])[-1] + 1
    spark.createDataFrame([(bundle,)], _POINTER).coalesce(1).write.mode("overwrite").json(f"{root}/pointers/{n}")
    return bundle, wrote


def manifest(spark: SparkSession, root: str, bundle: str | None = None) -> DataFrame:
    """name, digest, rows of the tables of a bundle, the current one if none is named."""
    if bundle is None:
        known = _pointers(spark, root)
        if not known:
            raise ValueError(f"no bundle was committed to {root}")
        bundle = spark.read.schema(_POINTER).json(f"{root}/pointers/{known[-1]}").first()["bundle"]
    return spark.read.schema(_MANIFEST).json(f"{root}/manifests/{bundle}")


def resolve(spark: SparkSession, root: str, bundle: str | None = None) -> dict[str, DataFrame]:
    """The tables of a bundle, the current one if none is named."""
    return {r["name"]: spark.read.parquet(f"{root}/objects/{r['digest']}") for r in manifest(spark, root, bundle).collect()}


def problems(spark: SparkSession, root: str, bundle: str | None = None) -> list[tuple[str, str]]:
    """Tables of a bundle that are missing or whose content is another than their name says."""
    out = []
    for r in manifest(spark, root, bundle).collect():
        path = f"{root}/objects/{r['digest']}"
        if not _complete(spark, path):
            out.append((r["name"], "missing"))
        elif digest(spark.read.parquet(path)) != (r["digest"], r["rows"]):
            out.append((r["name"], "changed"))
    return out
