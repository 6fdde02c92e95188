"""Queries over validity periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.operators.intervals import coverage
from strataweave.tables import read


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Continuous periods and gaps per (src, rel) of all facts with a src, retracted ones included."""
    facts = read(spark, root, "facts", "src", "rel", "valid_from", "valid_to", "recorded_at")
    return coverage(facts, ["src", "rel"], "valid_from", "valid_to", "recorded_at", ["src"])


QUERIES = {"p4_found": p4_found}

ORACLES = {
    "p4_found": """
WITH iv AS (
  SELECT DISTINCT src, rel, coalesce(valid_from, recorded_at) AS s, coalesce(valid_to, 9223372036854775807) AS e
  FROM facts WHERE src IS NOT NULL AND coalesce(valid_to, 9223372036854775807) > coalesce(valid_from, recorded_at)),
m AS (SELECT *, max(e) OVER (PARTITION BY src, rel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY src, rel ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m),
p AS (SELECT src, rel, min(s) AS s, max(e) AS e FROM g GROUP BY src, rel, run),
n AS (SELECT *, lead(s) OVER (PARTITION BY src, rel ORDER BY s) AS nxt FROM p)
SELECT src, rel, 'period' AS span, s AS from_ms, CASE WHEN e = 9223372036854775807 THEN -1 ELSE e END AS to_ms FROM n
UNION ALL
SELECT src, rel, 'gap' AS span, e AS from_ms, nxt AS to_ms FROM n WHERE nxt IS NOT NULL
""",
}
