"""Versioned snapshots of the vector index as Parquet: written whole, read only under the version they were built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_version(vectors: DataFrame) -> str:
    """A version that changes with any vector or id, whatever the order of rows: one small aggregate over all rows."""
    row = vectors.agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "q").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("q", "id")).alias("x")).first()
    return f"{row.n}-{row.h}-{row.x}"


def write_index(vectors: DataFrame, path: str, version: str) -> None:
    """The index (id, q) under its version; an older version stays until its folder is removed."""
    vectors.select("id", "q", F.size("q").alias("dim")).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_index(spark: SparkSession, path: str, version: str, dim: int | None = None) -> DataFrame | None:
    """The index of that version, or None where there is none or it holds another dimension."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    index = spark.read.parquet(f"{path}/version={version}")
    if dim is not None and not index.where(F.col("dim") != dim).isEmpty():
        return None
    return index.select("id", "q")


def upsert(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """vectors (kind, ref_id, q) with those of changes put in their place."""
    return vectors.join(changes.select("kind", "ref_id"), ["kind", "ref_id"], "left_anti").unionByName(changes)
