"""Queries over the store: scans, time, scopes, graph, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions import text
from strataweave.operators import graph, temporal
from strataweave.operators.scopes import key_of_root, label_of_root
from strataweave.plans.common import AS_OF, EACH, NOW, SQL_NOTES, entities, episodes, facts, scopes, sql_ymd, with_

_RESOLVED = """SELECT f.id, f.rel, f.statement, s.name AS src_name, d.name AS dst_name, e.source, e.head
FROM f LEFT JOIN n s ON s.id = f.src LEFT JOIN n d ON d.id = f.dst LEFT JOIN e ON e.id = f.episode_id"""


def scan_resolved(spark: SparkSession, root: str) -> DataFrame:
    """All facts with the names of both ends and where they were learned."""
    out = temporal.resolved(facts(spark, root), entities(spark, root), episodes(spark, root))
    return out.select("id", "rel", "statement", "src_name", "dst_name", "source", "head")


def fetch_in_order(spark: SparkSession, root: str) -> DataFrame:
    """Facts asked for by id, in the caller's order (here: ids from the largest down)."""
    f = facts(spark, root)
    wanted = temporal.ranked(f.where(F.col("id") % EACH == 0).select("id"), F.desc("id"))
    return temporal.in_caller_order(f, wanted).select("rank", "id", "rel", "statement")


def facts_live(spark: SparkSession, root: str) -> DataFrame:
    return facts(spark, root).where(temporal.live()).select("id", "scope_id", "src", "rel", "dst")


def facts_as_of(spark: SparkSession, root: str) -> DataFrame:
    return facts(spark, root).where(temporal.as_of(AS_OF)).select("id", "scope_id", "src", "rel", "dst")


def facts_as_of_each_month(spark: SparkSession, root: str) -> DataFrame:
    """How many facts were known and held at the start of each 30-day month of two years, per scope."""
    start = AS_OF - 12 * 30 * text.DAY
    f = facts(spark, root).select("scope_id", "recorded_at", "valid_from", "valid_to")
    begin = F.greatest("recorded_at", F.coalesce("valid_from", "recorded_at"))
    month = lambda x: F.ceil((x - start) / (30 * text.DAY))
    low = F.greatest(F.lit(0), month(begin))
    high = F.least(F.lit(24), F.when(F.col("valid_to").isNull(), F.lit(24)).otherwise(month(F.col("valid_to")) - 1))
    ends = f.select("scope_id", F.when(low <= high, F.array(F.struct(low.alias("m"), F.lit(1).alias("d")), F.struct((high + 1).alias("m"), F.lit(-1).alias("d")))).alias("x"))
    # a fact becomes two steps, +1 and -1, not one row per month it spans
    steps = ends.select("scope_id", F.inline("x")).groupBy("scope_id", "m").agg(F.sum("d").alias("d"))
    grid = f.select("scope_id").distinct().select("scope_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long"))).alias("m"))
    held = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy("scope_id").orderBy("m"))
    return grid.join(steps, ["scope_id", "m"], "left").select("scope_id", (F.lit(start) + F.col("m") * 30 * text.DAY).alias("as_of"), held.alias("facts"))


def facts_readable(spark: SparkSession, root: str) -> DataFrame:
    """How many live facts each scope can read: its own and the global ones."""
    per = facts(spark, root).where(temporal.live()).groupBy(F.col("scope_id").alias("readable")).agg(F.count("*").alias("n"))
    reads = temporal.read_set(scopes(spark, root))
    return reads.join(per, "readable", "left").groupBy("scope").agg(F.sum(F.coalesce("n", F.lit(0))).alias("facts"))


def scope_counts(spark: SparkSession, root: str) -> DataFrame:
    """Live facts per scope, scopes without any kept."""
    live = facts(spark, root).where(temporal.live()).groupBy("scope_id").agg(F.count("*").alias("live"))
    s = scopes(spark, root).select(F.col("id").alias("scope_id"), "key", "label")
    return s.join(live, "scope_id", "left").select("scope_id", "key", "label", F.coalesce("live", F.lit(0)).alias("live"))


def store_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of the whole store in one row, each table read once."""
    f = facts(spark, root).agg(F.count_if(temporal.live()).alias("live"), F.count_if(F.col("invalidated_at").isNotNull()).alias("retired"))
    e = episodes(spark, root).agg(F.count("*").alias("episodes"))
    n = entities(spark, root).agg(F.count("*").alias("entities"))
    s = scopes(spark, root).agg(F.count("*").alias("scopes"))
    return s.crossJoin(e).crossJoin(f).crossJoin(n)  # four tables of one row


def scope_keys(spark: SparkSession, root: str) -> DataFrame:
    """Key and label of every scope, from its root."""
    return scopes(spark, root).select("id", key_of_root(F.col("root")).alias("key"), label_of_root(F.col("root")).alias("label"))


def newest_live(spark: SparkSession, root: str) -> DataFrame:
    """The 200 newest live facts with the label of their scope."""
    f = facts(spark, root).where(temporal.live()).orderBy(F.desc("recorded_at"), F.desc("id")).limit(200)
    return f.join(scopes(spark, root).select(F.col("id").alias("scope_id"), "label"), "scope_id").select("id", "label", "rel", "statement", "recorded_at")


def graph_neighbors(spark: SparkSession, root: str) -> DataFrame:
    """Facts next to each asked entity, least connected first."""
    n = entities(spark, root)
    asked = n.where(F.col("id") % EACH == 0).select(F.col("id").alias("group"), F.col("id").alias("entity"))
    none = spark.createDataFrame([], "group long, id long")
    out = graph.neighbors(facts(spark, root).where(temporal.live()), n, asked, none)
    return out.select(F.col("group").alias("entity"), "id", "rank")


def graph_two_hops(spark: SparkSession, root: str) -> DataFrame:
    """Facts that each asked fact leads to in at most two hops."""
    f = facts(spark, root).where(temporal.live())
    seeds = f.where(F.col("id") % EACH == 0).select(F.col("id").alias("group"), "id")
    return graph.expand(f, entities(spark, root), seeds, hops=2).select(F.col("group").alias("seed"), "id", "hop", "rank")


def entity_timeline(spark: SparkSession, root: str) -> DataFrame:
    """The history of each asked entity, by edge or by mention, rendered line by line."""
    asked = entities(spark, root).where(F.col("id") % EACH == 0).select(F.col("id").alias("entity"), "name")
    return graph.timeline(facts(spark, root), asked)


def top_entities(spark: SparkSession, root: str) -> DataFrame:
    return graph.top_entities(entities(spark, root))


def fact_entities(spark: SparkSession, root: str) -> DataFrame:
    """Distinct entities that live facts touch."""
    return graph.endpoints(facts(spark, root).where(temporal.live())).distinct()


def entity_degrees(spark: SparkSession, root: str) -> DataFrame:
    return graph.degrees(facts(spark, root))


def orphan_entities(spark: SparkSession, root: str) -> DataFrame:
    return graph.orphans(entities(spark, root), facts(spark, root)).select("id", "scope_id", "name")


def event_medians(spark: SparkSession, root: str) -> DataFrame:
    """Median value per type of event."""
    return spark.read.parquet(f"{root}/events.parquet").groupBy("event_type").agg(F.median("value").alias("median_value"), F.count("*").alias("n"))


def provenance(spark: SparkSession, root: str) -> DataFrame:
    """Every fact with the note on where it comes from and when it held."""
    r = temporal.resolved(facts(spark, root), entities(spark, root), episodes(spark, root))
    note = text.prov_note(F.col("valid_from"), F.col("valid_to"), F.col("invalidated_at"), F.col("recorded_at"), F.col("source"), F.col("head"), F.col("confidence"), NOW)
    return r.select("id", note.alias("note"))


_NEIGHBORS = f"""
t AS (SELECT id, hits, recorded_at, src AS entity FROM f WHERE invalidated_at IS NULL AND src IS NOT NULL
      UNION SELECT id, hits, recorded_at, dst FROM f WHERE invalidated_at IS NULL AND dst IS NOT NULL)"""
_START = "coalesce(f.valid_from, f.recorded_at)"

QUERIES = {
    q.__name__: q
    for q in (
        scan_resolved, fetch_in_order, facts_live, facts_as_of, facts_as_of_each_month, facts_readable, scope_counts, store_counts, scope_keys, newest_live,
        graph_neighbors, graph_two_hops, entity_timeline, top_entities, fact_entities, entity_degrees, orphan_entities, event_medians, provenance,
    )
}

ORACLES = {
    "scan_resolved": with_("f n e") + _RESOLVED,
    "fetch_in_order": with_("f") + f"SELECT row_number() OVER (ORDER BY id DESC) AS rank, id, rel, statement FROM f WHERE id % {EACH} = 0",
    "facts_live": with_("f") + "SELECT id, scope_id, src, rel, dst FROM f WHERE invalidated_at IS NULL",
    "facts_as_of": with_("f") + f"SELECT id, scope_id, src, rel, dst FROM f WHERE recorded_at <= {AS_OF} AND {_START} <= {AS_OF} AND (valid_to IS NULL OR valid_to > {AS_OF})",
    "facts_as_of_each_month": with_("f", f"g AS (SELECT s.scope_id, {AS_OF} - 31104000000 + m.m * 2592000000 AS as_of FROM (SELECT DISTINCT scope_id FROM f) s, (SELECT unnest(range(25)) AS m) m)")
    + f"""SELECT g.scope_id, g.as_of, count(f.id) AS facts FROM g LEFT JOIN f ON f.scope_id = g.scope_id AND f.recorded_at <= g.as_of
AND {_START} <= g.as_of AND (f.valid_to IS NULL OR f.valid_to > g.as_of) GROUP BY g.scope_id, g.as_of""",
    "facts_readable": with_("f") + """SELECT s.id AS scope, count(f.id) AS facts FROM scopes s LEFT JOIN f
ON (f.scope_id = s.id OR f.scope_id = 1) AND f.invalidated_at IS NULL GROUP BY s.id""",
    "scope_counts": with_("f") + """SELECT s.id AS scope_id, s.key, s.label, (SELECT count(*) FROM f WHERE f.scope_id = s.id AND f.invalidated_at IS NULL) AS live FROM scopes s""",
    "store_counts": with_("f n e") + """SELECT (SELECT count(*) FROM scopes) AS scopes, (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM f WHERE invalidated_at IS NULL) AS live,
(SELECT count(*) FROM f WHERE invalidated_at IS NOT NULL) AS retired, (SELECT count(*) FROM n) AS entities""",
    "newest_live": with_("f") + """SELECT f.id, s.label, f.rel, f.statement, f.recorded_at FROM f JOIN scopes s ON s.id = f.scope_id
WHERE f.invalidated_at IS NULL ORDER BY f.recorded_at DESC, f.id DESC LIMIT 200""",
    "graph_neighbors": with_("f n", _NEIGHBORS) + f"""SELECT t.entity, t.id, row_number() OVER (PARTITION BY t.entity ORDER BY n.degree, t.hits DESC, t.recorded_at DESC, t.id) AS rank
FROM t JOIN n ON n.id = t.entity WHERE t.entity % {EACH} = 0 QUALIFY rank <= 30""",
    "graph_two_hops": with_("f n", _NEIGHBORS + f""",
s AS (SELECT id AS seed, id FROM f WHERE invalidated_at IS NULL AND id % {EACH} = 0),
h1 AS (SELECT s.seed, b.id, min(n.degree) AS deg, max(b.hits) AS hits, max(b.recorded_at) AS rec
       FROM (SELECT DISTINCT s.seed, a.entity FROM s JOIN t a ON a.id = s.id) s JOIN t b ON b.entity = s.entity JOIN n ON n.id = b.entity WHERE b.id <> s.seed GROUP BY ALL),
r1 AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY deg, hits DESC, rec DESC, id) AS rank FROM h1 QUALIFY rank <= 30),
h2 AS (SELECT s.seed, b.id, min(n.degree) AS deg, max(b.hits) AS hits, max(b.recorded_at) AS rec
       FROM (SELECT DISTINCT r.seed, a.entity FROM r1 r JOIN t a ON a.id = r.id) s JOIN t b ON b.entity = s.entity JOIN n ON n.id = b.entity
       WHERE b.id <> s.seed AND NOT EXISTS (SELECT 1 FROM r1 WHERE r1.seed = s.seed AND r1.id = b.id) GROUP BY ALL),
r2 AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY deg, hits DESC, rec DESC, id) AS rank FROM h2 QUALIFY rank <= 30)""")
    + "SELECT seed, id, 1 AS hop, rank FROM r1 UNION ALL SELECT seed, id, 2, rank FROM r2",
    "entity_timeline": with_("f n", f"""q AS (SELECT id AS entity, trim(name) AS name FROM n WHERE id % {EACH} = 0),
a AS (SELECT entity, f.id FROM q JOIN f ON f.src = q.entity UNION SELECT entity, f.id FROM q JOIN f ON f.dst = q.entity
      UNION SELECT entity, f.id FROM q JOIN f ON contains(translate(f.statement, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(q.name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) WHERE q.name <> '')""")
    + f"""SELECT a.entity, row_number() OVER (PARTITION BY a.entity ORDER BY {_START}, f.id) AS rank, f.id,
{sql_ymd(_START)} || ' → ' || CASE WHEN f.invalidated_at IS NOT NULL THEN {sql_ymd('coalesce(f.valid_to, f.invalidated_at)')} ELSE 'now' END || '  ' || trim(f.statement) AS line
FROM a JOIN f ON f.id = a.id QUALIFY rank <= 40""",
    "top_entities": with_("n") + "SELECT scope_id, row_number() OVER (PARTITION BY scope_id ORDER BY degree DESC, id) AS rank, id, name, degree FROM n QUALIFY rank <= 20",
    "fact_entities": with_("f") + "SELECT src AS entity FROM f WHERE invalidated_at IS NULL AND src IS NOT NULL UNION SELECT dst FROM f WHERE invalidated_at IS NULL AND dst IS NOT NULL",
    "entity_degrees": with_("f") + "SELECT entity, count(*) AS degree FROM (SELECT src AS entity FROM f UNION ALL SELECT dst FROM f) WHERE entity IS NOT NULL GROUP BY entity",
    "orphan_entities": with_("f n") + "SELECT id, scope_id, name FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.src = n.id) AND NOT EXISTS (SELECT 1 FROM f WHERE f.dst = n.id)",
    "event_medians": "SELECT event_type, median(value) AS median_value, count(*) AS n FROM events GROUP BY event_type",
    "provenance": with_("f e", SQL_NOTES) + "SELECT id, note FROM o",
    "scope_keys": """SELECT id, CASE WHEN root IS NULL THEN 'global' ELSE 'p:' || substr(sha256(root), 1, 16) END AS key,
CASE WHEN root IS NULL THEN 'global' ELSE regexp_extract(root, '([^/\\\\]+)[/\\\\]*$', 1) END AS label FROM scopes""",
}
