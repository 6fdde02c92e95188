"""Reading the test and production tables by name, with the columns an operator needs and each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, root: str, table: str, *columns: str) -> DataFrame:
    """The table's rows with only the given columns (all when none is given); pruning reaches the Parquet scan."""
    df = spark.read.parquet(f"{root}/{table}.parquet")
    return df.select(*columns) if columns else df


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: rows delivered twice are byte-for-byte equal, so any of them will do."""
    return df.dropDuplicates(list(keys))
