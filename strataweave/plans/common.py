"""What the query modules share: the tables with each id once, the clock, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.tables import once, read

NOW = 1_767_225_600_000
"""The clock of all queries: 2026-01-01. Operators never read the wall clock."""
AS_OF = 1_750_000_000_000
EACH = 50
"""Search queries are the rows whose id is divisible by this, held against all rows."""


def facts(spark: SparkSession, root: str) -> DataFrame:
    return once(read(spark, root, "facts"), "id")


def entities(spark: SparkSession, root: str) -> DataFrame:
    return once(read(spark, root, "entities"), "id")


def episodes(spark: SparkSession, root: str) -> DataFrame:
    return once(read(spark, root, "episodes"), "id")


def inputs(spark: SparkSession, root: str) -> DataFrame:
    return once(read(spark, root, "fact_inputs"), "input_id")


def scopes(spark: SparkSession, root: str) -> DataFrame:
    return read(spark, root, "scopes")


# The same tables in SQL, as the beginning of a WITH clause.
ONCE = {
    "f": "f AS (SELECT DISTINCT ON (id) * FROM facts)",
    "n": "n AS (SELECT DISTINCT ON (id) * FROM entities)",
    "e": "e AS (SELECT DISTINCT ON (id) * FROM episodes)",
    "i": "i AS (SELECT DISTINCT ON (input_id) * FROM fact_inputs)",
}


def with_(names: str, rest: str = "") -> str:
    """`WITH f AS (...), n AS (...)`, and `rest` as further members."""
    return "WITH " + ", ".join([ONCE[x] for x in names.split()] + ([rest] if rest else [])) + "\n"


BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def sql_normalize(x: str) -> str:
    edge = """[.,;:!?"'']"""
    return f"regexp_replace(lower(regexp_replace({sql_trim(x)}, '{BLANK}+', ' ', 'g')), '^{edge}+|{edge}+$', '', 'g')"


def sql_ymd(x: str) -> str:
    return f"strftime(DATE '1970-01-01' + CAST(floor({x} / 86400000.0) AS INTEGER), '%Y-%m-%d')"


def sql_tokens(x: str) -> str:
    return f"greatest(length({x}) // 4, length(list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')))"


_START = "coalesce(f.valid_from, f.recorded_at)"
SQL_NOTES = f"""p AS (SELECT f.id, concat_ws(', ',
CASE WHEN f.invalidated_at IS NOT NULL AND f.valid_to IS NOT NULL THEN 'was true ' || {sql_ymd(_START)} || ' → ' || {sql_ymd('f.valid_to')}
     WHEN f.invalidated_at IS NOT NULL THEN 'retracted, noted ' || {sql_ymd(_START)}
     WHEN {NOW} - {_START} > 172800000 THEN 'since ' || {sql_ymd(_START)} END,
CASE WHEN e.source <> '' AND e.source <> 'unknown' THEN 'by ' || e.source END,
CASE WHEN e.head <> '' THEN '@ ' || e.head END,
CASE WHEN f.confidence < 1 THEN 'conf ' || printf('%.2f', f.confidence) END) AS x FROM f LEFT JOIN e ON e.id = f.episode_id),
o AS (SELECT id, CASE WHEN x = '' THEN '' ELSE ' [' || x || ']' END AS note FROM p)"""
