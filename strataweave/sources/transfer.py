"""Export of a store to JSON lines and import of them into another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.session import cut

EPISODE = "id LONG, source STRING, kind STRING, text STRING, meta STRING, hash STRING, head STRING, recorded_at LONG"
FACT = "id LONG, src STRING, rel STRING, dst STRING, statement STRING, confidence DOUBLE, valid_from LONG, valid_to LONG, recorded_at LONG, invalidated_at LONG, episode_id LONG"


FILE = "episode_id LONG, path STRING, lang STRING, line_from LONG, line_to LONG"
VERSION = 1


def export_lines(scopes: DataFrame, episodes: DataFrame, facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows (scope_key, part, id, json): one line per episode, file and fact, retracted ones included, and one envelope per scope.

    `facts` are resolved (src_name, dst_name), `files` (episode_id, path, lang, line_from, line_to) may be left out, and the
    envelopes (version, scope, label, root) with them. One line per record instead of one document per scope, so that a scope
    that holds a third of the store is written by many tasks.
    """
    key = scopes.select(F.col("id").alias("scope_id"), F.col("key").alias("scope_key"))
    e = episodes.join(key, "scope_id").select(
        "scope_key", F.lit("episode").alias("part"), "id",
        F.to_json(F.struct("id", "source", "kind", F.col("body").alias("text"), "meta", F.lower(F.hex("hash")).alias("hash"), "head", "recorded_at")).alias("json"),
    )
    f = facts.join(key, "scope_id").select(
        "scope_key", F.lit("fact").alias("part"), "id",
        F.to_json(F.struct("id", F.col("src_name").alias("src"), "rel", F.col("dst_name").alias("dst"), "statement", "confidence", "valid_from", "valid_to", "recorded_at", "invalidated_at", "episode_id")).alias("json"),
    )
    if files is None:
        return e.unionByName(f)
    r = files.join(episodes.join(key, "scope_id").select(F.col("id").alias("episode_id"), "scope_key"), "episode_id").select(
        "scope_key", F.lit("file").alias("part"), F.col("episode_id").alias("id"), F.to_json(F.struct("episode_id", "path", "lang", "line_from", "line_to")).alias("json")
    )
    head = scopes.select(F.col("key").alias("scope_key"), F.lit("envelope").alias("part"), "id", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.col("key").alias("scope"), "label", "root")).alias("json"))
    return e.unionByName(f).unionByName(r).unionByName(head)


def in_order(lines: DataFrame) -> DataFrame:
    """The lines in the order of an export: by scope, envelope first, then episodes, facts, and files by episode; any number of tasks write them."""
    kind = F.array_position(F.array(*[F.lit(p) for p in ("envelope", "episode", "fact", "file")]), F.col("part"))
    by = ["scope_key", kind, "id", "json"]
    return lines.repartitionByRange(*by).sortWithinPartitions(*by)


def write_export(lines: DataFrame, path: str) -> None:
    """Lines as JSON files, one folder per scope and part, in the order of ids."""
    in_order(lines).write.partitionBy("scope_key", "part").mode("overwrite").json(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an export."""
    return spark.read.schema("id LONG, json STRING, scope_key STRING, part STRING").json(path)


def episode_ids(lines: DataFrame, existing: DataFrame, first_id: int) -> DataFrame:
    """Rows (old_id, id, known) for every episode of the lines, those included that share their (scope_key, hash).

    An episode that exists keeps its id; new ones get ids from first_id on, given out by all tasks at once. The numbers
    are cut from their lineage, so that a lost executor doesn't hand out others.
    """
    e = lines.where("part = 'episode'").select("scope_key", F.from_json("json", EPISODE).alias("e")).select("scope_key", "e.id", F.try_to_binary("e.hash", F.lit("hex")).alias("hash"))
    known = existing.select("scope_key", "hash", F.col("id").alias("known"))
    keys = e.select("scope_key", "hash").distinct().join(known, ["scope_key", "hash"], "left")
    keys = cut(keys.withColumn("new", F.coalesce("known", F.lit(first_id) + F.monotonically_increasing_id())))
    return e.join(keys, ["scope_key", "hash"]).select(F.col("id").alias("old_id"), F.col("new").alias("id"), F.col("known").isNotNull().alias("known"))


def import_episodes(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The new episodes of the lines under the ids of `episode_ids`, one per (scope_key, hash); recorded_at is preserved."""
    e = lines.where("part = 'episode'").select("scope_key", F.from_json("json", EPISODE).alias("e")).select("scope_key", "e.*")
    first = ids.where(~F.col("known")).groupBy("id").agg(F.min("old_id").alias("old_id"))
    rows = e.withColumnRenamed("id", "old_id").join(first, "old_id")
    return rows.select("id", "scope_key", "source", "kind", F.col("text").alias("body"), "meta", F.try_to_binary("hash", F.lit("hex")).alias("hash"), "head", "recorded_at")


def import_facts(lines: DataFrame, episode_ids: DataFrame) -> DataFrame:
    """Live facts of the lines with episode ids mapped by episode_ids (old_id, id); nothing supersedes on import."""
    f = lines.where("part = 'fact'").select("scope_key", F.from_json("json", FACT).alias("f")).select("scope_key", "f.*").where("invalidated_at IS NULL")
    ids = episode_ids.select(F.col("old_id").alias("episode_id"), F.col("id").alias("_new"))
    return f.join(ids, "episode_id", "left").withColumn("episode_id", F.col("_new")).drop("_new")


def import_files(lines: DataFrame, episode_ids: DataFrame) -> DataFrame:
    """The files of the lines attached to the episodes that `episode_ids` says they belong to now; each path once per new episode, known ones keep their own."""
    r = lines.where("part = 'file'").select("scope_key", F.from_json("json", FILE).alias("r")).select("scope_key", "r.*")
    new = episode_ids.where("NOT known").select(F.col("old_id").alias("episode_id"), F.col("id").alias("_new"))
    rows = r.join(new, "episode_id").select("scope_key", F.col("_new").alias("episode_id"), "path", "lang", "line_from", "line_to")
    one = rows.groupBy("scope_key", "episode_id", "path").agg(F.min_by(F.struct("lang", "line_from", "line_to"), F.struct(F.col("line_from").isNull(), "line_from", "line_to")).alias("l"))
    return one.select("scope_key", "episode_id", "path", "l.*")
