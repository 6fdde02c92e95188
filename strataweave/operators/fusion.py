"""Rank fusion, adjustment, diversification, and the recall pipeline over many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions.text import BLANKS, DAY
from strataweave.operators import graph, lexical, vectors
from strataweave.operators.temporal import live
from strataweave.session import cut, kept

K = 60
WEIGHTS = {"bm25": 1.0, "vector": 0.7, "graph": 0.5}
RELEVANCE, SAME_COSINE, SAME_WORDS = 0.72, 0.93, 0.82


def rrf(legs: DataFrame) -> DataFrame:
    """Rows (query_id, id, score, via, rank) of legs (query_id, id, leg, rank): reciprocal rank fusion, ties to the smaller id."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("leg"))
    fused = legs.groupBy("query_id", "id").agg(F.round(F.sum(weight / (K + F.col("rank"))), 12).alias("score"), F.array_sort(F.collect_set("leg")).alias("via"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def adjusted(score: Column, confidence: Column, recorded_at: Column, hits: Column, now_ts: int) -> Column:
    """A fused score weighed by confidence, age and use."""
    age = F.greatest(F.lit(0), F.lit(now_ts) - recorded_at) / DAY
    return score * (0.7 + 0.3 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))) * (0.85 + 0.15 * F.exp(-age / 90)) * (1 + 0.05 * F.log(1 + hits))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared words over all words of two texts, words of more than two bytes; 0 where a side has none."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), f"{BLANKS}+"), lambda w: F.octet_length(w) > 2))
    x, y = words(a), words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def diversify(pool: DataFrame, limit: int) -> DataFrame:
    """Rows (query_id, id, score, pick): maximal marginal relevance over pool (query_id, id, score, statement, q).

    Greedy and sequential by nature, so it runs per query on the bounded pool that oversampling leaves.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        s = g["score"].to_numpy(dtype=float)
        span = s.max() - s.min()
        relevance = (s - s.min()) / span if span > 1.2e-7 else np.ones(len(s))
        words = [{w for w in (t or "").lower().split() if len(w.encode()) > 2} for t in g["statement"]]
        vecs = [None if v is None else np.asarray(v, dtype=np.int32) for v in g["q"]]
        nearest, open_, picks = np.zeros(len(s)), np.ones(len(s), dtype=bool), []
        while open_.any() and len(picks) < limit:
            value = np.where(open_, RELEVANCE * relevance - (1 - RELEVANCE) * nearest, -np.inf)
            best = int(value.argmax())
            open_[best] = False
            picks.append(best)
            for i in np.flatnonzero(open_):
                if vecs[i] is not None and vecs[best] is not None:
                    n = min(len(vecs[i]), len(vecs[best]))
                    sim, same = float(vecs[i][:n] @ vecs[best][:n]) / vectors.UNIT, SAME_COSINE
                else:
                    a, b = words[i], words[best]
                    sim, same = (2.0 * len(a & b) / (len(a) + len(b)) if a and b else 0.0), SAME_WORDS
                nearest[i] = max(nearest[i], sim)
                if sim >= same:
                    open_[i] = False
        return pd.DataFrame({"query_id": g["query_id"][picks], "id": g["id"][picks], "score": s[picks], "pick": np.arange(1, len(picks) + 1, dtype=np.int32)})

    return pool.groupBy("query_id").applyInPandas(run, "query_id long, id long, score double, pick int")


def fuse_episodes(bm25: DataFrame, vector: DataFrame, episodes: DataFrame, limit: int) -> DataFrame:
    """Rows (query_id, id, rank): episodes that either leg found, newest first."""
    either = bm25.select("query_id", "id").unionByName(vector.select("query_id", "id")).distinct()
    rows = either.join(episodes.select("id", "recorded_at"), "id")
    order = Window.partitionBy("query_id").orderBy(F.desc("recorded_at"), F.desc("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "rank")


def legs(queries: DataFrame, facts: DataFrame, entities: DataFrame, when: Column | None = None, hops: int = 1) -> DataFrame:
    """Rows (query_id, id, leg, rank) of queries (query_id, text, scope_id): the lexical, vector and graph leg."""
    when = live() if when is None else when
    allowed = queries.select("query_id", F.explode(F.array_distinct(F.array("scope_id", F.lit(1).cast("long")))).alias("scope_id"))
    seen = facts.withColumn("scope_id", F.when(when, F.col("scope_id")))
    words = lexical.bm25(queries, seen, "id", "statement", allowed)
    index = facts.where(when).select("id", "scope_id", vectors.hashed_embedding(F.col("statement")).alias("q"))
    scopes_of = F.array_distinct(F.array("scope_id", F.lit(1).cast("long"))).alias("scopes")
    near = vectors.nearest(queries.select("query_id", scopes_of, vectors.hashed_embedding(F.col("text")).alias("q")), index).drop("rank")
    near = vectors.relative_floor(near).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")))
    two = cut(words.select("query_id", "id", F.lit("bm25").alias("leg"), "rank").unionByName(near.select("query_id", "id", F.lit("vector").alias("leg"), "rank")))
    if not hops:
        return two
    seeds = rrf(two).where(F.col("rank") <= 10).select(F.col("query_id").alias("group"), "id")
    reach = graph.expand(facts.where(when), entities, seeds, hops)
    order = Window.partitionBy("group").orderBy("hop", "rank", "id")
    reach = reach.select(F.col("group").alias("query_id"), "id", F.lit("graph").alias("leg"), F.row_number().over(order).alias("rank"))
    return two.unionByName(reach)


def recall(queries: DataFrame, facts: DataFrame, entities: DataFrame, now_ts: int, limit: int = 12, hops: int = 1, when: Column | None = None) -> DataFrame:
    """Rows (query_id, id, score, pick): the facts that answer each query, diversified, best first."""
    facts = cut(facts.select("id", "scope_id", "src", "dst", "statement", "confidence", "valid_from", "valid_to", "recorded_at", "invalidated_at", "hits"))
    queries = cut(queries)
    fused = rrf(legs(queries, facts, entities, when, hops)).where(F.col("rank") <= max(24, 4 * limit))
    rows = fused.drop("rank").join(facts.select("id", "statement", "confidence", "recorded_at", "hits"), "id")
    pool = rows.select("query_id", "id", "statement", adjusted(F.col("score"), F.col("confidence"), F.col("recorded_at"), F.col("hits"), now_ts).alias("score"))
    return diversify(pool.withColumn("q", vectors.hashed_embedding(F.col("statement"))), limit)


def recall_all(
    queries: DataFrame, facts: DataFrame, entities: DataFrame, episodes: DataFrame, refs: DataFrame, now_ts: int, limit: int = 12, hops: int = 1, when: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(picks, notes, files): the recalled facts, the episodes that words or vectors find, and the files of the facts' episodes.

    picks: query_id, id, score, pick. notes: query_id, id, rank, newest first. files: query_id, episode_id and the
    columns of refs (episode_id, path, lang, line_from, line_to), each file once per query.
    """
    picks = kept(recall(queries, facts, entities, now_ts, limit, hops, when))
    allowed = queries.select("query_id", F.explode(F.array_distinct(F.array("scope_id", F.lit(1).cast("long")))).alias("scope_id"))
    words = lexical.bm25(queries, episodes, "id", "body", allowed, most=limit)
    index = episodes.select("id", "scope_id", vectors.hashed_embedding(F.col("body")).alias("q"))
    scopes = F.array_distinct(F.array("scope_id", F.lit(1).cast("long"))).alias("scopes")
    near = vectors.nearest(queries.select("query_id", scopes, vectors.hashed_embedding(F.col("text")).alias("q")), index, k=limit)
    notes = fuse_episodes(words, near, episodes, limit)
    of = picks.join(facts.select("id", "episode_id"), "id").where("episode_id IS NOT NULL").select("query_id", "episode_id").distinct()
    return picks, notes, of.join(refs, "episode_id")
