"""Coverage of overlapping, nested, touching and gapped validity intervals per key.

A two-level merge over time shards, the same for keys of any size. Intervals that begin together are one from the
start. Rows are range-partitioned by key and start, so that every partition is a shard of the same size, however many
rows one key has; a key that holds a third of the table simply runs through a third of the shards. Level one merges the
intervals of each (shard, key); what reaches beyond the shard is clipped and kept as one number, the shard's latest
end. Level two walks the shards of each key that has more than one: what earlier shards carry into a shard swallows
the stretches that begin before it ends, and the first stretch behind it closes the period that was open. At most two
keys of a shard go on into others, so level two has no more rows than twice the number of shards, whatever the data.

Defined results: null keys are dropped when `key_not_null` names them; a null start is replaced by the fallback; an
interval whose end is not after its start is ignored; a null end is open and is written as -1. Repeated rows change
nothing. Empty input gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import kept

OPEN = 9223372036854775807
"""Internal end of an interval that has none."""


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    """The join condition under which all keys agree, nulls included."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def in_shards(rows: DataFrame, keys: list[str], order: list[str], shards: int | None = None) -> DataFrame:
    """rows with `shard`: equal parts of the table by (keys, order); shards of one key follow each other in that order."""
    by = [F.col(c) for c in (*keys, *order)]
    parts = rows.repartitionByRange(shards, *by) if shards else rows.repartitionByRange(*by)
    return parts.withColumn("shard", F.spark_partition_id())


def borders(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of summary (keys, shard, ...) whose key stands in more than one shard: at most two rows per shard."""
    own = Window.partitionBy(*keys)
    many = (F.min("shard").over(own) != F.max("shard").over(own)).alias("_many")
    return summary.select("*", many).where("_many").drop("_many")


def coverage(
    df: DataFrame, keys: list[str], start: str | Column, end: str | Column, start_fallback: str | Column | None = None, key_not_null: list[str] | None = None, shards: int | None = None
) -> DataFrame:
    """Rows (keys, span, from_ms, to_ms): span `period` for each longest stretch without a hole, `gap` for each hole.

    `shards` is the number of shards (`spark.sql.shuffle.partitions` if not given). See the module's text.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    s = col(start) if start_fallback is None else F.coalesce(col(start), col(start_fallback))
    names = [f"_k{i}" for i in range(len(keys))]
    base = df
    for k in key_not_null or []:
        base = base.where(F.col(k).isNotNull())
    iv = base.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], s.cast("long").alias("s"), F.coalesce(col(end).cast("long"), F.lit(OPEN)).alias("e"))
    iv = iv.where(F.col("s").isNotNull() & (F.col("e") > F.col("s"))).groupBy(*names, "s").agg(F.max("e").alias("e"))

    # Level one: the stretches of each (shard, key), and the start of the next one in the shard.
    by = ["shard", *names]
    w = Window.partitionBy(*by).orderBy("s")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = in_shards(iv, names, ["s"], shards).withColumn("_new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    runs = runs.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = runs.groupBy(*by, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumn("_next", F.lead("s").over(w)).drop("_run")
    local = kept(local)

    # Level two: what is carried into each shard of a key that has several.
    w2 = Window.partitionBy(*names).orderBy("shard")
    ends = borders(local.groupBy(*by).agg(F.max("e").alias("hi")), names)
    carried = kept(ends.withColumn("carry", F.max("hi").over(w2.rowsBetween(Window.unboundedPreceding, -1))))
    at = lambda d, o: d.alias("l").join(F.broadcast(o).alias("r"), (F.col("l.shard") == F.col("r.shard")) & same_keys("l", "r", names), "left")
    is_new = F.col("carry").isNull() | (F.col("s") > F.col("carry"))
    touched = at(local, carried).select("l.*", "carry", F.col("hi").isNotNull().alias("_many"))
    stitch = touched.where("_many").groupBy(*by, "carry").agg(F.min(F.when(is_new, F.col("s"))).alias("begin"), F.max(F.when(~is_new, F.col("e"))).alias("swallowed"), F.max("e").alias("hi"))
    opens = F.when(F.col("begin").isNotNull(), F.struct(F.col("begin").alias("begin"), F.greatest("carry", "swallowed").alias("end")))
    follow = F.first(opens, ignorenulls=True).over(w2.rowsBetween(1, Window.unboundedFollowing))
    stitch = stitch.select(*by, "carry", follow.alias("follow"), F.max("hi").over(Window.partitionBy(*names)).alias("last"))
    whole = at(local, stitch).where(is_new).select(
        *[F.col(f"l.{n}").alias(n) for n in names],
        "s",
        F.when(F.col("_next").isNotNull() | F.col("last").isNull(), F.col("e")).otherwise(F.coalesce("follow.end", "last")).alias("e"),
        F.coalesce("_next", "follow.begin").alias("_next"),
    )
    spans = F.array(
        F.struct(F.lit("period").alias("span"), F.col("s").alias("from_ms"), F.when(F.col("e") == OPEN, -1).otherwise(F.col("e")).alias("to_ms")),
        F.when(F.col("_next").isNotNull(), F.struct(F.lit("gap").alias("span"), F.col("e").alias("from_ms"), F.col("_next").alias("to_ms"))),
    )
    return whole.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.inline(F.filter(spans, lambda x: x.isNotNull())))
