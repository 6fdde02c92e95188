"""The fact graph: endpoints, neighbours, timelines, degrees, orphans."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.operators.render import timeline_line
from strataweave.session import cut


def endpoints(facts: DataFrame, *keep: str) -> DataFrame:
    """Rows (entity, fact columns): both ends of every fact as two equi-joinable branches, never as an OR."""
    ends = F.array(F.col("src"), F.col("dst"))
    return facts.select(*keep, F.explode(F.array_distinct(F.filter(ends, lambda x: x.isNotNull()))).alias("entity"))


def entities_of(facts: DataFrame, of: DataFrame) -> DataFrame:
    """Distinct (group, entity) of the facts listed in of (group, id)."""
    return endpoints(facts.join(of, "id"), "group").distinct()


def neighbors(facts: DataFrame, entities: DataFrame, frontier: DataFrame, exclude: DataFrame, most: int = 30) -> DataFrame:
    """Rows (group, id, rank): facts that touch an entity of frontier (group, entity), but those of exclude (group, id).

    Order: least degree of the touching entity, most hits, newest, smallest id. The degree is the entity's own, so that
    its facts stand in one order for every group: each entity is ranked once and hands on its first `most` facts and as
    many more as a group may exclude, which leaves no fact out. A hub's facts are ranked before any group meets them.
    """
    spare = exclude.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    touching = endpoints(facts, "id", "hits", "recorded_at").join(frontier.select("entity").distinct(), "entity", "left_semi")
    own = Window.partitionBy("entity").orderBy(F.desc("hits"), F.desc("recorded_at"), "id")
    first = touching.withColumn("place", F.row_number().over(own)).where(F.col("place") <= most + spare).drop("place")
    first = first.join(entities.select(F.col("id").alias("entity"), "degree"), "entity")
    found = first.join(frontier, "entity").groupBy("group", "id").agg(F.min("degree").alias("deg"), F.max("hits").alias("hits"), F.max("recorded_at").alias("rec"))
    if spare:
        found = found.join(exclude.select("group", "id"), ["group", "id"], "left_anti")
    order = Window.partitionBy("group").orderBy("deg", F.desc("hits"), F.desc("rec"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("group", "id", "rank")


def expand(facts: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int = 1, most: int = 30) -> DataFrame:
    """Rows (group, id, hop, rank): what is reached from seeds (group, id) in at most `hops` steps, each fact once."""
    seen, frontier, out = seeds.select("group", "id"), seeds.select("group", "id"), None
    for hop in range(1, hops + 1):
        found = cut(neighbors(facts, entities, entities_of(facts, frontier), seen, most).withColumn("hop", F.lit(hop)))
        out = found if out is None else out.unionByName(found)
        frontier = found.select("group", "id")
        seen = seen.unionByName(frontier)
    return out


def mentions(facts: DataFrame, names: DataFrame, block: int = 20_000) -> DataFrame:
    """Rows (entity, id): facts whose statement contains the name of an entity of names (entity, name).

    Letter case of A to Z is ignored, the name is taken literally. The names are a stated query set: blocks of at most
    `block` names become one Aho-Corasick automaton each, and every block reads all statements once.
    """
    rows, out = names.where(F.length(F.trim("name")) > 0).select("entity", F.trim("name").alias("name")).toLocalIterator(), None

    def search(part):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton, of = ahocorasick.Automaton(), {}
            for entity, name in part:
                of.setdefault("".join(c.lower() if c.isascii() else c for c in name), []).append(entity)
            for name, entities in of.items():
                automaton.add_word(name, entities)
            automaton.make_automaton()
            for b in batches:
                hits = {
                    (e, i)
                    for i, text in zip(b["id"], b["statement"])
                    for _, es in automaton.iter("".join(c.lower() if c.isascii() else c for c in text))
                    for e in es
                }
                yield pd.DataFrame(list(hits), columns=["entity", "id"])

        return run

    statements = facts.where(F.col("statement").isNotNull()).select("id", "statement")
    while part := [(r.entity, r.name) for r in islice(rows, block)]:
        got = statements.mapInPandas(search(part), "entity long, id long")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else facts.sparkSession.createDataFrame([], "entity long, id long")


def timeline(facts: DataFrame, asked: DataFrame, most: int = 40) -> DataFrame:
    """Rows (entity, rank, id, line): every fact about the entities of asked (entity, name), oldest first."""
    by_edge = endpoints(facts, "id").join(asked.select("entity"), "entity", "left_semi").select("entity", "id")
    about = by_edge.unionByName(mentions(facts, asked)).distinct()
    rows = about.join(facts.select("id", "statement", "valid_from", "valid_to", "recorded_at", "invalidated_at"), "id")
    start = F.coalesce("valid_from", "recorded_at")
    line = timeline_line(*[F.col(c) for c in ("statement", "valid_from", "valid_to", "recorded_at", "invalidated_at")])
    order = Window.partitionBy("entity").orderBy(start, "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("entity", "rank", "id", line.alias("line"))


def top_entities(entities: DataFrame, most: int = 20) -> DataFrame:
    """Rows (scope_id, rank, id, name, degree): the best connected entities of each scope."""
    order = Window.partitionBy("scope_id").orderBy(F.desc("degree"), "id")
    return entities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("scope_id", "rank", "id", "name", "degree")


def degrees(facts: DataFrame) -> DataFrame:
    """Rows (entity, degree) over all facts ever inserted: one per end, so that a loop counts twice."""
    ends = F.filter(F.array("src", "dst"), lambda x: x.isNotNull())
    return facts.select(F.explode(ends).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree"))


def orphans(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities that no fact touches."""
    return entities.join(endpoints(facts).select(F.col("entity").alias("id")).distinct(), "id", "left_anti")
