"""Queries over the whole of an agent's memory: storing, forgetting, recalling with notes and files, packing, moving a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import registered, text
from strataweave.operators import fusion, graph, lexical, render, tasks, temporal, vectors, writes
from strataweave.plans import search_queries, text_queries, write_queries
from strataweave.plans.common import EACH, NOW, SQL_NOTES, entities, episodes, facts, inputs, scopes, sql_normalize, sql_tokens, sql_trim, sql_ymd, with_
from strataweave.sources import transcripts, transfer
from strataweave.tables import read

MODEL = "hashed"


def _remembered(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    e = episodes(spark, root).select(F.col("id").alias("note_id"), "scope_id", F.coalesce(text.salience(F.col("body")), F.lit("prompt")).alias("kind"), "body", "recorded_at", text.salience(F.col("body")).isNotNull().alias("derive"))
    given = inputs(spark, root).select(F.col("episode_id").alias("note_id"), F.col("input_id").alias("seq"), "src", "rel", "dst", "statement", "valid_from", "valid_to", "confidence", "supersede")
    return writes.remember(e, given, spark.createDataFrame([], "id long, scope_id long, hash binary"))


def remembered_episodes(spark: SparkSession, root: str) -> DataFrame:
    """The episodes that storing all notes into an empty store leaves."""
    return _remembered(spark, root)[0].select("id", "scope_id", "kind", F.md5("body").alias("digest"))


def remembered_facts(spark: SparkSession, root: str) -> DataFrame:
    """The facts that storing all notes writes: given ones, and those of silent salient notes; both under the episode that holds the note's text."""
    return _remembered(spark, root)[1].select("note_id", "seq", "episode_id", "scope_id", "rel", F.md5("statement").alias("digest"), "recorded_at", "over", "derived")


def aliases_upserted(spark: SparkSession, root: str) -> DataFrame:
    """The aliases after every entity took the first word of its norm as one; the last entity to take a word keeps it."""
    n = entities(spark, root)
    changes = n.select(F.col("id").alias("entity_id"), "scope_id", F.split("norm", " ")[0].alias("norm"), F.col("recorded_at").alias("seq"))
    return writes.upsert_aliases(read(spark, root, "aliases"), changes)


def facts_forgotten_in_scope(spark: SparkSession, root: str) -> DataFrame:
    """All facts after the asked ones were retracted, every second time from a scope that is not theirs."""
    f = facts(spark, root)
    asked = f.where(F.col("id") % EACH == 0).select("id", F.when(F.col("id") % (2 * EACH) == 0, F.col("scope_id")).otherwise(F.col("scope_id") + 1).alias("scope_id"))
    return writes.forget(f, asked, NOW).select("id", "valid_to", "invalidated_at")


def facts_forgotten_by_query(spark: SparkSession, root: str) -> DataFrame:
    """All facts after the best hit of each asked name was retracted, if it lies in the name's own scope."""
    f, asked = facts(spark, root), search_queries._asked(spark, root)
    best = lexical.bm25(asked, search_queries._scoped(f), "id", "statement", search_queries._allowed(asked), most=1)
    return writes.forget(f, best.join(asked, "query_id").select("id", "scope_id"), NOW).select("id", "valid_to", "invalidated_at")


def entities_from_files(spark: SparkSession, root: str) -> DataFrame:
    """The files that episodes name and no entity of their scope stands for, as entities to insert."""
    named = writes.file_ranges(episodes(spark, root), "id", "body").join(episodes(spark, root).select(F.col("id").alias("episode_id"), "scope_id"), "episode_id")
    rows = named.select("scope_id", F.col("path").alias("name"), F.col("episode_id").alias("seq"), F.lit("file").alias("kind"))
    return writes.new_entities(rows, entities(spark, root), read(spark, root, "aliases")).select("scope_id", "norm", "name", "kind")


def entities_without_live_facts(spark: SparkSession, root: str) -> DataFrame:
    """Entities that would be orphans if the retracted and the unread facts were pruned."""
    f = facts(spark, root).where(temporal.live() & (F.col("hits") > 0))
    return graph.orphans(entities(spark, root), f).select("id", "scope_id")


def file_lines(spark: SparkSession, root: str) -> DataFrame:
    """Files of every episode with the lines that are named."""
    return writes.file_ranges(episodes(spark, root), "id", "body")


def vectors_read(spark: SparkSession, root: str) -> DataFrame:
    """Point read: the quantized vectors of the asked ids."""
    v = search_queries._vectors(spark, root)
    return vectors.read(v, v.where(F.col("id") % EACH == 0).select("id")).select("id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


def worst_probe_cosine(spark: SparkSession, root: str) -> DataFrame:
    """How far eight bits turn a vector at worst, over all vectors as probes."""
    v = spark.read.parquet(f"{root}/embeddings.parquet").select(F.col("embedding").alias("a"), vectors.quantize(F.col("embedding")).alias("b"))
    return vectors.worst_cosine(v).select("probes", F.round("worst", 6).alias("worst"))


def vectors_reindexed(spark: SparkSession, root: str) -> DataFrame:
    """The index built anew over all facts and episodes: vectors per kind, and how many a reader of this model takes."""
    t = facts(spark, root).select(F.lit(1).alias("kind"), F.col("id").alias("ref_id"), F.col("statement").alias("text"))
    t = t.unionByName(episodes(spark, root).select(F.lit(2).alias("kind"), F.col("id").alias("ref_id"), F.col("body").alias("text")))
    index = vectors.reindex(t, MODEL)
    ours = vectors.of_model(index, MODEL, 64).groupBy("kind").agg(F.count("*").alias("usable"))
    return index.groupBy("kind", "model").agg(F.count("*").alias("vectors")).join(ours, "kind", "left")


def task_checkpoints(spark: SparkSession, root: str) -> DataFrame:
    """The checkpoint of each scope's task: task notes save it, those from the command line close it."""
    e = episodes(spark, root).where("kind = 'task'")
    events = e.select("scope_id", F.col("recorded_at").alias("ts"), F.when(F.col("source") == "cli", "done").otherwise("save").alias("action"), F.col("body").alias("state"), F.lit(None).cast("string").alias("goal"), F.array().cast("array<string>").alias("files"), F.col("body").alias("note"))
    return tasks.current(events).select("scope_id", F.md5("state").alias("digest"), "opened_at", "updated_at", "closed")


def last_requests(spark: SparkSession, root: str) -> DataFrame:
    """What the user asked for last in each scope, from the scope's transcript as JSON lines."""
    e = episodes(spark, root)
    turn = F.struct(F.when(F.col("kind") == "prompt", transcripts.USER_TURN).otherwise("OTHER").alias("type"), F.concat(F.lit("ctx " + transcripts.OPEN), "body", F.lit(transcripts.CLOSE)).alias("content"))
    lines = e.select(F.col("scope_id").alias("transcript"), F.struct("recorded_at", "id").alias("line_no"), F.to_json(turn).alias("line"))
    return transcripts.last_requests(lines).select(F.col("transcript").alias("scope_id"), F.md5("request").alias("digest"))


def _exported(spark: SparkSession, root: str) -> DataFrame:
    e = episodes(spark, root)
    f = temporal.resolved(facts(spark, root), entities(spark, root), e)
    return transfer.export_lines(scopes(spark, root), e, f, writes.file_ranges(e, "id", "body"))


def imported_records(spark: SparkSession, root: str) -> DataFrame:
    """Every record that exporting the store and importing it into an empty one brings, files attached to their episode again."""
    lines = _exported(spark, root)
    ids = transfer.episode_ids(lines, spark.createDataFrame([], "scope_key string, hash binary, id long"), 1)
    old = ids.groupBy("id").agg(F.min("old_id").alias("first"))
    e = transfer.import_episodes(lines, ids).join(old, "id").select("scope_key", F.lit("episode").alias("part"), F.col("first").alias("of"), F.md5("body").alias("digest"), "recorded_at")
    f = transfer.import_facts(lines, ids).join(old.withColumnRenamed("id", "episode_id"), "episode_id", "left").select("scope_key", F.lit("fact").alias("part"), F.col("first").alias("of"), F.md5("statement").alias("digest"), "recorded_at")
    r = transfer.import_files(lines, ids).join(old.withColumnRenamed("id", "episode_id"), "episode_id").select("scope_key", F.lit("file").alias("part"), F.col("first").alias("of"), F.md5("path").alias("digest"), F.lit(None).cast("long").alias("recorded_at"))
    return e.unionByName(f).unionByName(r)


def store_totals(spark: SparkSession, root: str) -> DataFrame:
    """Counts of the whole store in one row: with vectors (one per fact and episode), and episodes that no fact has come from yet."""
    from strataweave.plans.store_queries import store_counts

    waiting = write_queries.episodes_pending(spark, root).agg(F.count("*").alias("pending"))
    one = store_counts(spark, root).crossJoin(waiting)  # tables of one row
    return one.withColumn("vectors", F.col("live") + F.col("retired") + F.col("episodes"))


def packed_memories(spark: SparkSession, root: str) -> DataFrame:
    """What every scope is answered with in 300 tokens for each asked name: facts with the files they were learned against, then raw notes."""
    asked, e = search_queries._asked(spark, root), episodes(spark, root)
    base = search_queries._lines(spark, root)
    lines = base.withColumn("line", F.expr("substring(line, 1, char_length(line) - 1)")).join(facts(spark, root).select("id", "episode_id"), "id")
    lines = render.with_pointers(lines, writes.file_ranges(e, "id", "body")).withColumn("line", F.concat("line", F.lit("\n")))
    hits = lexical.bm25(asked, e, "id", "body", search_queries._allowed(asked), most=12)
    notes = hits.join(e.select("id", "body", "recorded_at"), "id").select("query_id", "rank", render.raw_note(F.col("body"), F.col("recorded_at")).alias("note"))
    heads = asked.join(scopes(spark, root).select(F.col("id").alias("scope_id"), "label"), "scope_id").select("query_id", F.concat(F.lit("## Memory — "), "label", F.lit("\n")).alias("head"))
    return render.pack(heads, lines, notes, 300)


def recalled_files(spark: SparkSession, root: str) -> DataFrame:
    """The whole recall with what hangs on it: facts, raw notes and files of each asked name."""
    f, e = facts(spark, root), episodes(spark, root)
    picks, notes, files = fusion.recall_all(search_queries._asked(spark, root), f, entities(spark, root), e, writes.file_ranges(e, "id", "body"), NOW)
    part = lambda d, name, id_, place: d.select("query_id", F.lit(name).alias("part"), id_.alias("what"), place.cast("long").alias("place"))
    return part(picks, "fact", F.col("id").cast("string"), F.col("pick")).unionByName(part(notes, "note", F.col("id").cast("string"), F.col("rank"))).unionByName(part(files, "file", F.col("path"), F.col("line_from")))


def consolidated_facts(spark: SparkSession, root: str) -> DataFrame:
    """All facts after a consolidation over the first 200 pending episodes."""
    f = facts(spark, root)
    return writes.consolidate(f, write_queries.episodes_pending(spark, root), NOW)[0].select("id", "hits", "valid_to", "invalidated_at", "invalidated_by")


def sql_functions(spark: SparkSession, root: str) -> DataFrame:
    """The registered functions, called from SQL over all entities and episodes."""
    registered.register(spark)
    entities(spark, root).createOrReplaceTempView("memory_entities")
    episodes(spark, root).createOrReplaceTempView("memory_episodes")
    return spark.sql(
        "SELECT 'entities' AS tab, id, md5(normalize_text(name)) AS digest, est_tokens(name) AS tokens, salience(name) AS salient FROM memory_entities "
        "UNION ALL SELECT 'episodes', id, md5(normalize_text(body)), est_tokens(body), salience(body) FROM memory_episodes"
    )


QUERIES = {
    q.__name__: q
    for q in (
        remembered_episodes, remembered_facts, aliases_upserted, facts_forgotten_in_scope, facts_forgotten_by_query, entities_from_files, entities_without_live_facts, file_lines,
        vectors_read, worst_probe_cosine, vectors_reindexed, task_checkpoints, last_requests, imported_records, store_totals, packed_memories, recalled_files, consolidated_facts, sql_functions,
    )
}

_SALIENT, _BODY = text_queries._sql_salience("body"), sql_trim("body")
_KEYS = f"""b AS (SELECT id, scope_id, {_BODY} AS body, recorded_at, {_SALIENT} AS salient, sha256(encode({sql_normalize('body')} || chr(0))) AS key FROM e WHERE {_BODY} <> ''),
k AS (SELECT *, first_value(id) OVER (PARTITION BY scope_id, key ORDER BY recorded_at, id) AS episode_id FROM b)"""
_SINGLE = ", ".join(f"'{r}'" for r in writes.SINGLE_VALUED)
_RANGES = r"""m AS (SELECT DISTINCT id AS episode_id, unnest(regexp_extract_all(body, '(?:^|[\s`("''])((?:[\w.-]+/)+[\w-]+\.[A-Za-z0-9]{1,10}(?::\d{1,9}(?:[-–]\d{1,9})?)?)', 1)) AS m FROM e),
l AS (SELECT episode_id, split_part(m, ':', 1) AS path, TRY_CAST(nullif(regexp_extract(m, ':(\d+)(?:[-–](\d+))?$', 1), '') AS BIGINT) AS line_from,
      coalesce(TRY_CAST(nullif(regexp_extract(m, ':(\d+)(?:[-–](\d+))?$', 2), '') AS BIGINT), TRY_CAST(nullif(regexp_extract(m, ':(\d+)(?:[-–](\d+))?$', 1), '') AS BIGINT)) AS line_to FROM m),
r AS (SELECT episode_id, path, line_from, line_to FROM l QUALIFY row_number() OVER (PARTITION BY episode_id, path ORDER BY line_from IS NULL, line_from, line_to) = 1)"""
_FORGET = """CASE WHEN {hit} AND invalidated_at IS NULL THEN coalesce(valid_to, {now}) ELSE valid_to END AS valid_to, CASE WHEN {hit} AND invalidated_at IS NULL THEN {now} ELSE invalidated_at END AS invalidated_at"""

ORACLES = {
    "remembered_episodes": with_("e", _KEYS) + "SELECT id, scope_id, coalesce(salient, 'prompt') AS kind, md5(body) AS digest FROM k WHERE id = episode_id",
    "remembered_facts": with_("e i", _KEYS) + f"""SELECT k.id AS note_id, i.input_id AS seq, k.episode_id, k.scope_id, i.rel, md5(i.statement) AS digest, k.recorded_at,
i.src IS NOT NULL AND coalesce(i.supersede, lower(i.rel) IN ({_SINGLE})) AS over, false AS derived FROM i JOIN k ON k.id = i.episode_id
UNION ALL SELECT id, 0, episode_id, scope_id, CASE salient WHEN 'preference' THEN 'prefers' WHEN 'decision' THEN 'decided' WHEN 'constraint' THEN 'requires' WHEN 'error' THEN 'failed_with' ELSE 'relates_to' END,
md5(body), recorded_at, false, true FROM k WHERE salient IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.episode_id = k.id)""",
    "aliases_upserted": with_("n", "c AS (SELECT scope_id, split_part(norm, ' ', 1) AS norm, arg_max(id, (recorded_at, id)) AS entity_id FROM n WHERE split_part(norm, ' ', 1) <> '' GROUP BY ALL)")
    + "SELECT entity_id, scope_id, norm FROM c UNION ALL SELECT entity_id, scope_id, norm FROM aliases a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.scope_id = a.scope_id AND c.norm = a.norm)",
    "facts_forgotten_in_scope": with_("f") + "SELECT id, " + _FORGET.format(hit=f"id % {2 * EACH} = 0", now=NOW) + " FROM f",
    "facts_forgotten_by_query": with_("f n", search_queries._bm25("f", "statement", "d.invalidated_at IS NULL", 1) + ", x AS (SELECT DISTINCT hits.id, q.scope_id FROM hits JOIN q ON q.qid = hits.query_id)")
    + "SELECT id, " + _FORGET.format(hit="EXISTS (SELECT 1 FROM x WHERE x.id = f.id AND x.scope_id = f.scope_id)", now=NOW) + " FROM f",
    "entities_from_files": with_("e n", _RANGES + f", u AS (SELECT e.scope_id, r.path AS name, {sql_normalize('r.path')} AS norm, r.episode_id FROM r JOIN e ON e.id = r.episode_id)")
    + """SELECT scope_id, norm, arg_min(name, (episode_id, name)) AS name, 'file' AS kind FROM u WHERE norm <> '' AND NOT EXISTS (SELECT 1 FROM n WHERE n.scope_id = u.scope_id AND n.norm = u.norm)
AND NOT EXISTS (SELECT 1 FROM aliases a WHERE a.scope_id = u.scope_id AND a.norm = u.norm) GROUP BY scope_id, norm""",
    "entities_without_live_facts": with_("f n", "g AS (SELECT * FROM f WHERE invalidated_at IS NULL AND hits > 0)")
    + "SELECT id, scope_id FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.src = n.id) AND NOT EXISTS (SELECT 1 FROM g WHERE g.dst = n.id)",
    "file_lines": with_("e", _RANGES) + f"SELECT episode_id, path, CASE {text_queries._EXT} END AS lang, line_from, line_to FROM r",
    "vectors_read": f"WITH {search_queries._Q} SELECT id, array_to_string(q, ',') AS q FROM z WHERE id % {EACH} = 0",
    "worst_probe_cosine": f"""WITH {search_queries._Q}, p AS (SELECT list_sum(list_transform(list_zip(v.embedding, z.q), lambda p: CAST(p[1] AS DOUBLE) * p[2])) AS ab, v.len AS a,
sqrt(list_sum(list_transform(z.q, lambda x: CAST(x AS DOUBLE) * x))) AS b FROM v JOIN z ON z.id = v.id)
SELECT count(*) AS probes, round(min(CASE WHEN a * b > 0 THEN ab / (a * b) ELSE 0 END), 6) AS worst FROM p""",
    "vectors_reindexed": with_("f e") + "SELECT 1 AS kind, 'hashed:64' AS model, count(*) AS vectors, count(*) AS usable FROM f UNION ALL SELECT 2, 'hashed:64', count(*), count(*) FROM e",
    "task_checkpoints": with_("e", """t AS (SELECT scope_id, recorded_at AS ts, body, source = 'cli' AS done FROM e WHERE kind = 'task'),
s AS (SELECT scope_id, arg_max(trim(body, ' '), ts) AS state, min(ts) AS opened_at, max(ts) AS updated_at FROM t WHERE NOT done GROUP BY scope_id),
d AS (SELECT s.scope_id, string_agg('[closed] ' || t.body, chr(10) || chr(10) ORDER BY t.ts) AS marks FROM s JOIN t ON t.scope_id = s.scope_id AND t.done AND t.ts > s.updated_at GROUP BY s.scope_id)""")
    + "SELECT s.scope_id, md5(s.state || coalesce(chr(10) || chr(10) || d.marks, '')) AS digest, opened_at, updated_at, d.marks IS NOT NULL AS closed FROM s LEFT JOIN d ON d.scope_id = s.scope_id",
    "last_requests": with_("e") + f"SELECT scope_id, md5(arg_max({_BODY}, (recorded_at, id))) AS digest FROM e WHERE kind = 'prompt' AND {_BODY} <> '' GROUP BY scope_id",
    "imported_records": with_("f e", _RANGES + """, k AS (SELECT *, min(id) OVER (PARTITION BY scope_id, hash) AS first FROM e)""")
    + """SELECT s.key AS scope_key, 'episode' AS part, k.id AS "of", md5(k.body) AS digest, k.recorded_at FROM k JOIN scopes s ON s.id = k.scope_id WHERE k.id = k.first
UNION ALL SELECT s.key, 'fact', k.first, md5(f.statement), f.recorded_at FROM f JOIN scopes s ON s.id = f.scope_id LEFT JOIN k ON k.id = f.episode_id WHERE f.invalidated_at IS NULL
UNION ALL SELECT DISTINCT s.key, 'file', k.first, md5(r.path), CAST(NULL AS BIGINT) FROM r JOIN k ON k.id = r.episode_id JOIN scopes s ON s.id = k.scope_id""",
    "store_totals": with_("f n e") + """SELECT (SELECT count(*) FROM scopes) AS scopes, (SELECT count(*) FROM e) AS episodes, (SELECT count(*) FROM f WHERE invalidated_at IS NULL) AS live,
(SELECT count(*) FROM f WHERE invalidated_at IS NOT NULL) AS retired, (SELECT count(*) FROM n) AS entities, (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.episode_id = e.id)) AS pending,
(SELECT count(*) FROM f) + (SELECT count(*) FROM e) AS vectors""",
    "sql_functions": with_("n e") + f"""SELECT 'entities' AS tab, id, md5({sql_normalize('name')}) AS digest, {sql_tokens('name')} AS tokens, {text_queries._sql_salience('name')} AS salient FROM n
UNION ALL SELECT 'episodes', id, md5({sql_normalize('body')}), {sql_tokens('body')}, {_SALIENT} FROM e""",
    "packed_memories": with_("f n e", search_queries._FUSED + f""",
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pick FROM u QUALIFY pick <= 12),
{SQL_NOTES},
en AS (WITH {search_queries._bm25('e', 'body', 'true', 12)} SELECT query_id, id, rank FROM hits),
rr AS (WITH {_RANGES} SELECT * FROM r),
pt AS (SELECT episode_id, string_agg(chr(10) || '    `' || path || '`' || CASE WHEN line_from IS NULL THEN '' WHEN line_to <> line_from THEN ':' || line_from || '–' || line_to ELSE ':' || line_from END, '' ORDER BY coalesce(line_from, 0), path) AS marks FROM rr GROUP BY episode_id),
hd AS (SELECT q.qid AS query_id, '## Memory — ' || s.label || chr(10) AS head FROM q JOIN scopes s ON s.id = q.scope_id),
li AS (SELECT b.query_id, b.pick, '- ' || trim(f.statement) || o.note || coalesce(pt.marks, '') || chr(10) AS line, hd.head FROM b JOIN f ON f.id = b.id JOIN o ON o.id = b.id JOIN hd ON hd.query_id = b.query_id LEFT JOIN pt ON pt.episode_id = f.episode_id),
co AS (SELECT *, {sql_tokens('head')} + sum({sql_tokens('line')}) OVER (PARTITION BY query_id ORDER BY pick ROWS UNBOUNDED PRECEDING) AS used, count(*) OVER (PARTITION BY query_id) AS total FROM li),
sh AS (SELECT query_id, string_agg(line, '' ORDER BY pick) AS lines, max(used) AS used, any_value(total) - count(*) AS left_out FROM co WHERE pick = 1 OR used <= 300 GROUP BY query_id),
nt AS (SELECT en.query_id, en.rank, '- (' || {sql_ymd('e.recorded_at')} || ') ' || trim(e.body) || chr(10) AS note FROM en JOIN e ON e.id = en.id),
nc AS (SELECT nt.query_id, nt.rank, nt.note, coalesce(sh.used, {sql_tokens('hd.head')}) + sum({sql_tokens('nt.note')}) OVER (PARTITION BY nt.query_id ORDER BY nt.rank ROWS UNBOUNDED PRECEDING) AS used
  FROM nt JOIN hd ON hd.query_id = nt.query_id LEFT JOIN sh ON sh.query_id = nt.query_id),
ra AS (SELECT query_id, chr(10) || '### Raw notes' || chr(10) || coalesce(string_agg(note, '' ORDER BY rank) FILTER (used <= 300), '') AS raw FROM nc GROUP BY query_id)""")
    + """SELECT hd.query_id, CASE WHEN sh.query_id IS NULL AND ra.query_id IS NULL THEN '' ELSE hd.head || coalesce(sh.lines || CASE WHEN left_out > 0 THEN '- … ' || left_out || ' more memories not shown (raise the budget or narrow the query)' || chr(10) ELSE '' END, '')
|| coalesce(ra.raw, '') END AS text FROM hd LEFT JOIN sh ON sh.query_id = hd.query_id LEFT JOIN ra ON ra.query_id = hd.query_id""",
}
