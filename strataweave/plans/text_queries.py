"""Queries with the store's text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions import secrets, text
from strataweave.operators import temporal
from strataweave.operators.temporal import live
from strataweave.operators.writes import derive_facts, file_references
from strataweave.plans.common import BLANK, entities, episodes, facts, inputs, scopes, sql_normalize, sql_tokens, sql_trim, sql_ymd, with_
from strataweave.sources import transfer

from strataweave.streaming.prompts import kept_prompts


def entity_norms(spark: SparkSession, root: str) -> DataFrame:
    """Normal form of every entity's name next to the stored one."""
    return entities(spark, root).select("id", text.normalize_text(F.col("name")).alias("norm"), (text.normalize_text(F.col("name")) == F.col("norm")).alias("as_stored"))


def episode_identity(spark: SparkSession, root: str) -> DataFrame:
    """Identity of every episode's body and whether it is the stored one."""
    key = text.identity(text.normalize_text(F.col("body")))
    return episodes(spark, root).select("id", F.lower(F.hex(key)).alias("key"), (key == F.col("hash")).alias("as_stored"))


def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet").select("doc_id", text.est_tokens(F.col("text")).alias("tokens"))


def prompt_skips(spark: SparkSession, root: str) -> DataFrame:
    """Why an episode's body would not be worth keeping as a prompt."""
    return episodes(spark, root).select("id", text.skip_reason(F.col("body")).alias("reason"))


def salient_statements(spark: SparkSession, root: str) -> DataFrame:
    """The kind of durable statement that each episode and fact input makes."""
    e = episodes(spark, root).select(F.lit("episodes").alias("tab"), "id", text.salience(F.col("body")).alias("salient"))
    return e.unionByName(inputs(spark, root).select(F.lit("fact_inputs").alias("tab"), F.col("input_id").alias("id"), text.salience(F.col("statement")).alias("salient")))


def validity_dates(spark: SparkSession, root: str) -> DataFrame:
    """Dates of validity, and the epochs that reading these dates gives back."""
    day = text.ymd(F.col("valid_from"))
    return facts(spark, root).where("valid_from IS NOT NULL").select("id", day.alias("day"), text.parse_when(day).alias("back"), text.parse_when(F.col("valid_from").cast("string")).alias("same"))


def clipped_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet").select("doc_id", F.char_length(text.clip(F.col("text"))).alias("chars"), F.md5(text.clip(F.col("text"))).alias("digest"))


def files_named(spark: SparkSession, root: str) -> DataFrame:
    """Files that episodes name, with their language by extension."""
    return file_references(episodes(spark, root), "id", "body")


def files_by_episode(spark: SparkSession, root: str) -> DataFrame:
    """The files of each episode as pointers in one cell, in order of their path."""
    refs = file_references(episodes(spark, root), "id", "body")
    return refs.groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("`"), "path", F.lit("`")))), " ").alias("pointers"), F.count("*").alias("files"))


def budgeted_lines(spark: SparkSession, root: str) -> DataFrame:
    """Per scope and budget the newest live facts that fit, best first, at least one, and how many are left out."""
    line = F.concat(F.lit("- "), F.trim("statement"), F.lit("\n"))
    f = facts(spark, root).where(live()).select("scope_id", "id", "recorded_at", text.est_tokens(line).alias("cost"))
    caps = spark.read.parquet(f"{root}/budgets.parquet").select("budget_id", "capacity")
    most = caps.agg(F.max("capacity")).first()[0] or 0
    # A line costs a token at least, so no more lines than the largest budget has tokens can be shown: tasks keep only
    # these before a scope is gathered, however many facts it has.
    order = Window.partitionBy("scope_id").orderBy(F.desc("recorded_at"), F.desc("id"))
    ranked = f.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, most))
    ranked = ranked.withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = scopes(spark, root).select(F.col("id").alias("scope_id"), text.est_tokens(F.concat(F.lit("## Memory — "), "label", F.lit("\n"))).alias("head"))
    caps = F.broadcast(caps.agg(F.collect_list(F.struct("budget_id", "capacity")).alias("caps")))
    rows = ranked.join(head, "scope_id").crossJoin(caps).select("scope_id", "rank", "used", "head", F.inline("caps"))  # one row of budgets
    shown = rows.groupBy("scope_id", "budget_id").agg(F.count_if((F.col("rank") == 1) | (F.col("head") + F.col("used") <= F.col("capacity"))).alias("shown"))
    total = f.groupBy("scope_id").agg(F.count("*").alias("total"))
    return shown.join(total, "scope_id").select("scope_id", "budget_id", "shown", (F.col("total") - F.col("shown")).alias("omitted"))


def redacted_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents with credentials and certain paths masked, and how many there were."""
    d = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", secrets.redact(F.col("text"), ["**/*.pem", "vault_*.toml"]).alias("r"))
    return d.select("doc_id", "r.text", "r.secrets", "r.paths")


def derived_facts(spark: SparkSession, root: str) -> DataFrame:
    """The fact that each salient episode states."""
    e = episodes(spark, root).withColumn("kind", text.salience(F.col("body"))).where("kind IS NOT NULL")
    return derive_facts(e)


def prompts_kept(spark: SparkSession, root: str) -> DataFrame:
    """Episodes through the event path: skip rules, redaction, clipping, kind of statement, identity."""
    return kept_prompts(episodes(spark, root).select("id", "scope_id", "body")).select("id", "scope_id", "salient", "masked", F.lower(F.hex("key")).alias("key"))


def task_states(spark: SparkSession, root: str) -> DataFrame:
    """The task note each scope has open: its newest one, as JSON, closed once a newer note says so."""
    e = episodes(spark, root).where("kind = 'task'").groupBy("scope_id").agg(F.max_by(F.struct("id", "recorded_at"), F.struct("recorded_at", "id")).alias("t"), F.min("recorded_at").alias("opened_at"), F.count("*").alias("notes"))
    return e.select("scope_id", "t.id", F.to_json(F.struct("opened_at", F.col("t.recorded_at").alias("updated_at"), "notes")).alias("state"))


def exported_lines(spark: SparkSession, root: str) -> DataFrame:
    """The whole store as JSON lines."""
    f = temporal.resolved(facts(spark, root), entities(spark, root), episodes(spark, root))
    return transfer.export_lines(scopes(spark, root), episodes(spark, root), f)


def export_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Per scope, the episodes and live facts that importing an export into an empty store brings."""
    lines = exported_lines(spark, root)
    none = spark.createDataFrame([], "scope_key string, hash binary, id long")
    ids = transfer.episode_ids(lines, none, 1)
    e, f = transfer.import_episodes(lines, ids), transfer.import_facts(lines, ids)
    both = e.groupBy("scope_key").agg(F.count("*").alias("episodes")).join(f.groupBy("scope_key").agg(F.count("*").alias("facts"), F.count("episode_id").alias("anchored")), "scope_key", "full")
    return both.select("scope_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("episodes", "facts", "anchored")])


QUERIES = {
    q.__name__: q
    for q in (
        entity_norms, episode_identity, token_estimates, prompt_skips, salient_statements, validity_dates, clipped_documents, files_named, files_by_episode,
        budgeted_lines, redacted_documents, derived_facts, prompts_kept, task_states, exported_lines, export_round_trip,
    )
}


def _sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _sql_salience(x: str) -> str:
    t = sql_trim(x)
    cases = " ".join(
        f"WHEN regexp_matches(lower({t}), '(?:^|[^\\p{{L}}\\p{{N}}])(?:{p.replace(chr(39), chr(39) * 2)})(?:$|[^\\p{{L}}\\p{{N}}])') THEN '{k}'" for k, p in text.SALIENT.items()
    )
    return f"CASE WHEN strlen({t}) < 20 OR {t} LIKE '%?' OR regexp_extract(lower({t}), '^(.*?)(?:{BLANK}|$)', 1) IN ({_sql_list(text.QUESTION_WORDS)}) THEN NULL {cases} END"


_EXT = " ".join(f"WHEN lower(regexp_extract(path, '([^.]*)$', 1)) IN ({_sql_list(e.split())}) THEN '{k}'" for k, e in text.LANGUAGE_OF.items())
_FILES = f"""r AS (SELECT DISTINCT id AS episode_id, unnest(regexp_extract_all(body, '(?:^|[\\s`("''])((?:[\\w.-]+/)+[\\w-]+\\.[A-Za-z0-9]{{1,10}})', 1)) AS path FROM e)"""
_LINE = "'- ' || trim(statement) || chr(10)"

ORACLES = {
    "entity_norms": with_("n") + f"SELECT id, {sql_normalize('name')} AS norm, {sql_normalize('name')} = n.norm AS as_stored FROM n",
    "episode_identity": with_("e") + f"""SELECT id, substr(sha256(encode({sql_normalize('body')} || chr(0))), 1, 32) AS key,
substr(sha256(encode({sql_normalize('body')} || chr(0))), 1, 32) = lower(hex(hash)) AS as_stored FROM e""",
    "token_estimates": f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents",
    "prompt_skips": with_("e", f"t AS (SELECT id, {sql_trim('body')} AS t FROM e)") + f"""SELECT id, CASE WHEN t = '' THEN 'empty' WHEN t LIKE '/%' AND NOT contains(t, ' ') THEN 'slash command'
WHEN t LIKE '!%' THEN 'shell passthrough' WHEN lower(regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) IN ({_sql_list(text.ACKNOWLEDGEMENTS)}) THEN 'acknowledgement'
WHEN length(t) < 12 THEN 'too short' END AS reason FROM t""",
    "salient_statements": with_("e i") + f"SELECT 'episodes' AS tab, id, {_sql_salience('body')} AS salient FROM e UNION ALL SELECT 'fact_inputs', input_id, {_sql_salience('statement')} FROM i",
    "validity_dates": with_("f") + f"""SELECT id, {sql_ymd('valid_from')} AS day, CAST(floor(valid_from / 86400000.0) AS BIGINT) * 86400000 AS back,
CASE WHEN abs(valid_from) < 100000000000 THEN valid_from * 1000 ELSE valid_from END AS same FROM f WHERE valid_from IS NOT NULL""",
    "clipped_documents": """WITH c AS (SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || ' …[truncated]' ELSE text END AS t FROM documents)
SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM c""",
    "files_named": with_("e", _FILES) + f"SELECT episode_id, path, CASE {_EXT} END AS lang FROM r",
    "files_by_episode": with_("e", _FILES) + "SELECT episode_id, string_agg('`' || path || '`', ' ' ORDER BY '`' || path || '`') AS pointers, count(*) AS files FROM r GROUP BY episode_id",
    "budgeted_lines": with_("f", f"""c AS (SELECT scope_id, id, recorded_at, {sql_tokens(_LINE)} AS cost FROM f WHERE invalidated_at IS NULL),
r AS (SELECT scope_id, row_number() OVER w AS rank, sum(cost) OVER w AS used FROM c WINDOW w AS (PARTITION BY scope_id ORDER BY recorded_at DESC, id DESC ROWS UNBOUNDED PRECEDING)),
h AS (SELECT id AS scope_id, {sql_tokens("'## Memory — ' || label || chr(10)")} AS head FROM scopes)""")
    + """SELECT r.scope_id, b.budget_id, count(*) FILTER (r.rank = 1 OR h.head + r.used <= b.capacity) AS shown, count(*) FILTER (NOT (r.rank = 1 OR h.head + r.used <= b.capacity)) AS omitted
FROM r JOIN h USING (scope_id), budgets b GROUP BY r.scope_id, b.budget_id""",
    "task_states": with_("e") + """SELECT scope_id, arg_max(id, (recorded_at, id)) AS id,
'{"opened_at":' || min(recorded_at) || ',"updated_at":' || max(recorded_at) || ',"notes":' || count(*) || '}' AS state FROM e WHERE kind = 'task' GROUP BY scope_id""",
    "export_round_trip": with_("f e", """k AS (SELECT scope_id, hash, any_value(id) AS id FROM e GROUP BY scope_id, hash)""")
    + """SELECT s.key AS scope_key, (SELECT count(*) FROM k WHERE k.scope_id = s.id) AS episodes, (SELECT count(*) FROM f WHERE f.scope_id = s.id AND f.invalidated_at IS NULL) AS facts,
(SELECT count(*) FROM f JOIN e ON e.id = f.episode_id WHERE f.scope_id = s.id AND f.invalidated_at IS NULL) AS anchored
FROM scopes s WHERE EXISTS (SELECT 1 FROM e WHERE e.scope_id = s.id) OR EXISTS (SELECT 1 FROM f WHERE f.scope_id = s.id)""",
    "exported_lines": with_("f e n") + """SELECT s.key AS scope_key, 'episode' AS part, e.id, CAST(json_merge_patch('{}', to_json({'id': e.id, 'source': e.source, 'kind': e.kind, 'text': e.body, 'meta': e.meta,
'hash': lower(hex(e.hash)), 'head': e.head, 'recorded_at': e.recorded_at})) AS VARCHAR) AS json FROM e JOIN scopes s ON s.id = e.scope_id
UNION ALL SELECT s.key, 'fact', f.id, CAST(json_merge_patch('{}', to_json({'id': f.id, 'src': a.name, 'rel': f.rel, 'dst': b.name, 'statement': f.statement, 'confidence': f.confidence, 'valid_from': f.valid_from,
'valid_to': f.valid_to, 'recorded_at': f.recorded_at, 'invalidated_at': f.invalidated_at, 'episode_id': f.episode_id})) AS VARCHAR)
FROM f JOIN scopes s ON s.id = f.scope_id LEFT JOIN n a ON a.id = f.src LEFT JOIN n b ON b.id = f.dst""",
}
