"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import kept


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least.hint("merge"), "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, root) for every node that has an edge; root is the smallest node of its component.

    Nulls and loops are ignored, repeated edges change nothing, no edges give no rows. Neighbour lists are never
    gathered: each step is an aggregation by `min` and a join on the node, so one node may have any number of edges.
    Steps go on until one leaves the edges as they were, which comes after O(log^2 n) steps at most.
    """
    pair = edges.where(F.col(a) != F.col(b))
    now = kept(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        after = kept(_star(_star(now, True), False))
        both = after.withColumn("n", F.lit(1)).unionByName(now.withColumn("n", F.lit(-1)))  # edges are distinct: those in both cancel out
        if both.groupBy("u", "v").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty():
            break
        now = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
