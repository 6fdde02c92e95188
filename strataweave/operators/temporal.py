"""Bi-temporal predicates, scopes, and the fact scan with its names resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import kept

GLOBAL_SCOPE = 1


def live() -> Column:
    """Facts that nothing has retracted or replaced, whatever their validity period."""
    return F.col("invalidated_at").isNull()


def as_of(t: int | Column) -> Column:
    """Facts known by time t that held at t: half-open periods; later retraction is not looked at."""
    t = F.lit(t) if isinstance(t, int) else t
    return (F.col("recorded_at") <= t) & (F.coalesce("valid_from", "recorded_at") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def read_set(scopes: DataFrame, id_: str = "id") -> DataFrame:
    """Rows (scope, readable): every scope reads itself and the global scope."""
    both = F.array_distinct(F.array(F.col(id_), F.lit(GLOBAL_SCOPE).cast("long")))
    return scopes.select(F.col(id_).alias("scope"), F.explode(both).alias("readable"))


def resolved(facts: DataFrame, entities: DataFrame, episodes: DataFrame) -> DataFrame:
    """facts with src_name, dst_name, source, head; facts without an end, or whose end is unknown, keep nulls."""
    names = entities.select("id", "name")
    out = facts.join(names.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src", "left")
    out = out.join(names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")
    return out.join(episodes.select(F.col("id").alias("episode_id"), "source", "head"), "episode_id", "left")


def in_caller_order(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The facts of wanted (id, rank) with their rank, for a caller that keeps an order; unknown ids are left out."""
    return facts.join(wanted, "id")


def ranked(rows: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """rows with their place, from 1, in one order of the whole table: the order must tell all rows apart.

    Rows are range-partitioned by the order, ranked within their part, and moved on by the sizes of the parts before;
    there are as few of these as partitions.
    """
    parts = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before")))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(rank, place).join(offsets, "_part").withColumn(rank, F.col(rank) + F.col("_before")).drop("_part", "_before")
