"""Queries that run as streams: files are read as they arrive, drained, and the result is read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.session import shared_dir
from strataweave.streaming import prompts


def _source(spark: SparkSession, root: str, table: str) -> DataFrame:
    # a pattern, for a table is one file or a folder of files, and streams take a plain path for a folder
    return spark.readStream.schema(spark.read.parquet(f"{root}/{table}.parquet").schema).parquet(f"{root}/{table}.parque[t]")


def streamed_prompts(spark: SparkSession, root: str) -> DataFrame:
    """Episodes through the event path as a stream: each (scope, identity) once, with its kind of statement."""
    place = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    prompts.run(_source(spark, root, "episodes").select("id", "scope_id", "body"), f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("scope_id", F.lower(F.hex("key")).alias("key"), "salient", "masked")


QUERIES = {"streamed_prompts": streamed_prompts}
ORACLES: dict[str, str] = {}
