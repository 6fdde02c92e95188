"""Queries with the write side: deduplication, resolution, supersession, retraction, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import text
from strataweave.operators import graph, temporal, writes
from strataweave.plans.common import EACH, NOW, entities, episodes, facts, inputs, sql_normalize, with_
from strataweave.tables import read


def fact_identity(spark: SparkSession, root: str) -> DataFrame:
    """Identity of every fact and whether it is the stored one."""
    f = facts(spark, root)
    key = text.identity(F.col("rel"), F.col("src"), F.col("dst"), text.normalize_text(F.col("statement")))
    return f.select("id", F.lower(F.hex(key)).alias("key"), (key == F.col("hash")).alias("as_stored"))


def episodes_once(spark: SparkSession, root: str) -> DataFrame:
    """The first episode of each (scope, identity)."""
    return writes.first_episodes(episodes(spark, root)).select("id", "scope_id")


def episodes_to_insert(spark: SparkSession, root: str) -> DataFrame:
    """Of the episodes of the last 90 days those whose identity older ones of the scope don't have, each once."""
    e = episodes(spark, root)
    new = F.col("recorded_at") >= NOW - 90 * text.DAY
    return writes.first_episodes(e.where(new), e.where(~new)).select("id", "scope_id")


def _named(spark: SparkSession, root: str) -> DataFrame:
    i = inputs(spark, root).select("input_id", "episode_id", "src", "dst").join(episodes(spark, root).select(F.col("id").alias("episode_id"), "scope_id"), "episode_id")
    both = F.filter(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("name")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("name"))), lambda x: x["name"].isNotNull())
    return i.select("input_id", "scope_id", F.inline(both))


def resolved_inputs(spark: SparkSession, root: str) -> DataFrame:
    """The entity that each name of the fact inputs stands for in its scope, by alias or by norm."""
    out = writes.resolve_entities(_named(spark, root), entities(spark, root), read(spark, root, "aliases"))
    return out.select("input_id", "side", "scope_id", "norm", "entity_id")


def entities_to_insert(spark: SparkSession, root: str) -> DataFrame:
    """Names of the fact inputs that are not in their scope yet, each once."""
    names = _named(spark, root).withColumns({"seq": F.col("input_id"), "kind": F.lit(None).cast("string")})
    return writes.new_entities(names, entities(spark, root), read(spark, root, "aliases")).select("scope_id", "norm", "name")


def _inserts(spark: SparkSession, root: str) -> DataFrame:
    i = inputs(spark, root).join(episodes(spark, root).select(F.col("id").alias("episode_id"), "scope_id"), "episode_id")
    src, dst = text.normalize_text(F.col("src")), text.normalize_text(F.col("dst"))
    return i.select(
        "scope_id", src.alias("src"), "rel", F.lower(F.hex(text.identity(F.col("rel"), src, dst, text.normalize_text(F.col("statement"))))).alias("hash"),
        F.col("input_id").alias("id"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(received_at AS TIMESTAMP_NTZ))").alias("ts"), "valid_from", "valid_to", "confidence",
        writes.supersedes(F.col("rel"), src, F.col("supersede")).alias("over"),
    )


def replayed_inputs(spark: SparkSession, root: str) -> DataFrame:
    """The facts that inserting all fact inputs in the order of their arrival leaves."""
    return writes.replay(_inserts(spark, root))


def replayed_facts(spark: SparkSession, root: str) -> DataFrame:
    """The facts of the store replayed by their relation's own rule: single-valued relations keep one value at a time."""
    f = facts(spark, root).select(
        "scope_id", F.col("src").cast("string").alias("src"), "rel", F.lower(F.hex("hash")).alias("hash"), "id", F.col("recorded_at").alias("ts"), "valid_from", "valid_to", "confidence",
        writes.supersedes(F.col("rel"), F.col("src"), F.lit(None).cast("boolean")).alias("over"),
    )
    return writes.replay(f)


def _asked(f: DataFrame) -> DataFrame:
    return f.where(F.col("id") % EACH == 0).select("id")


def facts_forgotten(spark: SparkSession, root: str) -> DataFrame:
    """All facts after the asked ones were retracted."""
    f = facts(spark, root)
    return writes.forget(f, _asked(f), NOW).select("id", "valid_to", "invalidated_at")


def facts_purged(spark: SparkSession, root: str) -> DataFrame:
    f = facts(spark, root)
    return writes.purge(f, _asked(f)).select("id")


def episodes_purged(spark: SparkSession, root: str) -> DataFrame:
    """What is left of facts and episodes after the asked episodes were purged with all that came from them."""
    f, e = facts(spark, root), episodes(spark, root)
    f2, e2 = writes.purge_episodes(f, e, _asked(e))
    return f2.select(F.lit("facts").alias("tab"), "id").unionByName(e2.select(F.lit("episodes").alias("tab"), "id"))


def hits_marked(spark: SparkSession, root: str) -> DataFrame:
    """All facts after the neighbours of the asked entities were shown."""
    f, n = facts(spark, root), entities(spark, root)
    asked = n.where(F.col("id") % EACH == 0).select(F.col("id").alias("group"), F.col("id").alias("entity"))
    shown = graph.neighbors(f.where(temporal.live()), n, asked, spark.createDataFrame([], "group long, id long")).select("id")
    return writes.mark_hits(f, shown, NOW).select("id", "hits", "last_hit")


def facts_prunable(spark: SparkSession, root: str) -> DataFrame:
    return writes.prunable(facts(spark, root), NOW).select("id", "invalidated_at")


def orphans_after_prune(spark: SparkSession, root: str) -> DataFrame:
    """Entities that no fact touches once the prunable ones are gone."""
    f = facts(spark, root)
    return graph.orphans(entities(spark, root), writes.purge(f, writes.prunable(f, NOW))).select("id")


def episodes_pending(spark: SparkSession, root: str) -> DataFrame:
    """Episodes from which no fact has come, first come first."""
    done = facts(spark, root).where("episode_id IS NOT NULL").select(F.col("episode_id").alias("id")).distinct()
    return writes.pending(episodes(spark, root), done).select("id", "recorded_at")


QUERIES = {
    q.__name__: q
    for q in (
        fact_identity, episodes_once, episodes_to_insert, resolved_inputs, entities_to_insert, replayed_inputs, replayed_facts, facts_forgotten, facts_purged,
        episodes_purged, hits_marked, facts_prunable, orphans_after_prune, episodes_pending,
    )
}

_NEW = f"recorded_at >= {NOW - 90 * text.DAY}"
_SINGLE = ", ".join(f"'{r}'" for r in writes.SINGLE_VALUED)
_FOUND = f"""v AS (SELECT i.input_id, e.scope_id, x.side, x.name, {sql_normalize('x.name')} AS norm FROM i JOIN e ON e.id = i.episode_id,
      (VALUES ('src'), ('dst')) s(side), LATERAL (SELECT s.side AS side, CASE WHEN s.side = 'src' THEN i.src ELSE i.dst END AS name) x WHERE x.name IS NOT NULL),
r AS (SELECT v.*, coalesce((SELECT max(a.entity_id) FROM aliases a WHERE a.scope_id = v.scope_id AND a.norm = v.norm), (SELECT min(n.id) FROM n WHERE n.scope_id = v.scope_id AND n.norm = v.norm)) AS entity_id FROM v)"""
_KEYTEXT = f"encode(rel || chr(0) || coalesce(CAST(src AS VARCHAR), '') || chr(0) || coalesce(CAST(dst AS VARCHAR), '') || chr(0) || {sql_normalize('statement')} || chr(0))"

ORACLES = {
    "fact_identity": with_("f") + f"SELECT id, substr(sha256({_KEYTEXT}), 1, 32) AS key, substr(sha256({_KEYTEXT}), 1, 32) = lower(hex(hash)) AS as_stored FROM f",
    "episodes_once": with_("e") + "SELECT id, scope_id FROM e QUALIFY row_number() OVER (PARTITION BY scope_id, hash ORDER BY recorded_at, id) = 1",
    "episodes_to_insert": with_("e") + f"""SELECT id, scope_id FROM e WHERE {_NEW} AND NOT EXISTS (SELECT 1 FROM e o WHERE o.scope_id = e.scope_id AND o.hash = e.hash AND NOT o.{_NEW})
QUALIFY row_number() OVER (PARTITION BY scope_id, hash ORDER BY recorded_at, id) = 1""",
    "resolved_inputs": with_("i e n", _FOUND) + "SELECT input_id, side, scope_id, norm, entity_id FROM r",
    "entities_to_insert": with_("i e n", _FOUND) + "SELECT scope_id, norm, arg_min(name, (input_id, name)) AS name FROM r WHERE entity_id IS NULL AND norm <> '' GROUP BY scope_id, norm",
    "replayed_facts": with_("f", f"""k AS (SELECT scope_id, CAST(src AS VARCHAR) AS src, rel, lower(hex(hash)) AS hash, id, recorded_at AS ts, valid_from, valid_to, confidence,
  src IS NOT NULL AND lower(rel) IN ({_SINGLE}) AS over FROM f),
a AS (SELECT *, CASE WHEN lag(hash) OVER w = hash THEN 0 ELSE 1 END AS new FROM k WHERE over WINDOW w AS (PARTITION BY scope_id, src, rel ORDER BY ts, id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY scope_id, src, rel ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT scope_id, src, rel, run, arg_min(hash, (ts, id)) AS hash, arg_min(id, (ts, id)) AS id, arg_min(struct_pack(x := coalesce(valid_from, ts)), (ts, id)).x AS valid_from,
  arg_min(struct_pack(x := valid_to), (ts, id)).x AS valid_to, max(ts) AS recorded_at, max(confidence) AS confidence, min(ts) AS born FROM b GROUP BY scope_id, src, rel, run),
d AS (SELECT scope_id, src, rel, hash, id, valid_from, coalesce(valid_to, lead(valid_from) OVER w) AS valid_to, recorded_at, confidence, lead(born) OVER w AS invalidated_at, lead(id) OVER w AS invalidated_by
  FROM c WINDOW w AS (PARTITION BY scope_id, src, rel ORDER BY run))""")
    + """SELECT * FROM d UNION ALL
SELECT scope_id, src, rel, hash, arg_min(id, (ts, id)), arg_min(struct_pack(x := coalesce(valid_from, ts)), (ts, id)).x, arg_min(struct_pack(x := valid_to), (ts, id)).x, max(ts), max(confidence), NULL, NULL
FROM k WHERE NOT over GROUP BY scope_id, src, rel, hash""",
    "facts_forgotten": with_("f") + f"""SELECT id, CASE WHEN id % {EACH} = 0 AND invalidated_at IS NULL THEN coalesce(valid_to, {NOW}) ELSE valid_to END AS valid_to,
CASE WHEN id % {EACH} = 0 AND invalidated_at IS NULL THEN {NOW} ELSE invalidated_at END AS invalidated_at FROM f""",
    "facts_purged": with_("f") + f"SELECT id FROM f WHERE id % {EACH} <> 0",
    "episodes_purged": with_("f e") + f"""SELECT 'facts' AS tab, id FROM f WHERE episode_id IS NULL OR episode_id % {EACH} <> 0 OR NOT EXISTS (SELECT 1 FROM e WHERE e.id = f.episode_id)
UNION ALL SELECT 'episodes', id FROM e WHERE id % {EACH} <> 0""",
    "hits_marked": with_("f n", f"""t AS (SELECT id, hits, recorded_at, src AS entity FROM f WHERE invalidated_at IS NULL AND src IS NOT NULL
      UNION SELECT id, hits, recorded_at, dst FROM f WHERE invalidated_at IS NULL AND dst IS NOT NULL),
s AS (SELECT t.id FROM t JOIN n ON n.id = t.entity WHERE t.entity % {EACH} = 0 QUALIFY row_number() OVER (PARTITION BY t.entity ORDER BY n.degree, t.hits DESC, t.recorded_at DESC, t.id) <= 30),
m AS (SELECT id, count(*) AS k FROM s GROUP BY id)""")
    + f"SELECT f.id, f.hits + coalesce(m.k, 0) AS hits, CASE WHEN m.k > 0 THEN {NOW} ELSE f.last_hit END AS last_hit FROM f LEFT JOIN m ON m.id = f.id",
    "facts_prunable": with_("f") + f"SELECT id, invalidated_at FROM f WHERE invalidated_at < {NOW - 90 * text.DAY} AND hits = 0",
    "orphans_after_prune": with_("f n", f"g AS (SELECT * FROM f WHERE NOT (coalesce(invalidated_at, {NOW}) < {NOW - 90 * text.DAY} AND hits = 0))")
    + "SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.src = n.id) AND NOT EXISTS (SELECT 1 FROM g WHERE g.dst = n.id)",
    "episodes_pending": with_("f e") + "SELECT id, recorded_at FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.episode_id = e.id)",
    # One fact after the other: `live` holds the facts that are open in each key after its k-th row, as a map from hash to fact.
    "replayed_inputs": with_("i e", f"""k AS (SELECT e.scope_id, {sql_normalize('i.src')} AS src, i.rel, i.input_id AS id, epoch_ms(i.received_at) AS ts, i.valid_from, i.valid_to, i.confidence,
  substr(sha256(encode(i.rel || chr(0) || coalesce({sql_normalize('i.src')}, '') || chr(0) || coalesce({sql_normalize('i.dst')}, '') || chr(0) || {sql_normalize('i.statement')} || chr(0))), 1, 32) AS hash,
  i.src IS NOT NULL AND coalesce(i.supersede, lower(i.rel) IN ({_SINGLE})) AS over FROM i JOIN e ON e.id = i.episode_id),
o AS (SELECT *, row_number() OVER (PARTITION BY scope_id, src, rel ORDER BY ts, id) AS step FROM k),
z AS (SELECT scope_id, src, rel, step, hash, id, ts, coalesce(valid_from, ts) AS begin, valid_to, confidence, over FROM o)""").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, w AS (SELECT scope_id, src, rel, step, [{'hash': hash, 'id': id, 'begin': begin, 'valid_to': valid_to, 'rec': ts, 'conf': confidence, 'inv': CAST(NULL AS BIGINT), 'by': CAST(NULL AS BIGINT)}] AS held FROM z WHERE step = 1
UNION ALL SELECT z.scope_id, z.src, z.rel, z.step,
CASE WHEN len(list_filter(w.held, lambda h: h.inv IS NULL AND h.hash = z.hash)) > 0
  THEN list_transform(w.held, lambda h: CASE WHEN h.inv IS NULL AND h.hash = z.hash THEN {'hash': h.hash, 'id': h.id, 'begin': h.begin, 'valid_to': h.valid_to, 'rec': greatest(h.rec, z.ts), 'conf': greatest(h.conf, z.confidence), 'inv': h.inv, 'by': h.by} ELSE h END)
  ELSE list_append(CASE WHEN z.over THEN list_transform(w.held, lambda h: CASE WHEN h.inv IS NULL THEN {'hash': h.hash, 'id': h.id, 'begin': h.begin, 'valid_to': coalesce(h.valid_to, z.begin), 'rec': h.rec, 'conf': h.conf, 'inv': z.ts, 'by': z.id} ELSE h END) ELSE w.held END,
    {'hash': z.hash, 'id': z.id, 'begin': z.begin, 'valid_to': z.valid_to, 'rec': z.ts, 'conf': z.confidence, 'inv': CAST(NULL AS BIGINT), 'by': CAST(NULL AS BIGINT)}) END
FROM w JOIN z ON z.scope_id = w.scope_id AND z.src IS NOT DISTINCT FROM w.src AND z.rel = w.rel AND z.step = w.step + 1),
l AS (SELECT scope_id, src, rel, unnest(arg_max(held, step)) AS h FROM w GROUP BY scope_id, src, rel)
SELECT scope_id, src, rel, h.hash AS hash, h.id AS id, h.begin AS valid_from, h.valid_to AS valid_to, h.rec AS recorded_at, h.conf AS confidence, h.inv AS invalidated_at, h.by AS invalidated_by FROM l""",
}
