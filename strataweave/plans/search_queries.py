"""Retrieval queries: every row whose id is divisible by EACH asks, all rows are searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataweave.functions import text
from strataweave.operators import fusion, lexical, render, temporal, vectors
from strataweave.operators.lexical import B, K1, MOST_TERMS, STOP
from strataweave.plans.common import EACH, NOW, SQL_NOTES, entities, episodes, facts, sql_tokens, with_
from strataweave.session import cut


def _asked(spark: SparkSession, root: str) -> DataFrame:
    """Queries: the names of the asked entities, in their scope."""
    return entities(spark, root).where(F.col("id") % EACH == 0).select(F.col("id").alias("query_id"), F.col("name").alias("text"), "scope_id")


def _allowed(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", F.explode(F.array_distinct(F.array("scope_id", F.lit(1).cast("long")))).alias("scope_id"))


def query_terms(spark: SparkSession, root: str) -> DataFrame:
    """Search terms of every fact input's statement, in order."""
    i = spark.read.parquet(f"{root}/fact_inputs.parquet").select("input_id", "statement").dropDuplicates(["input_id"])
    return i.select("input_id", F.posexplode(lexical.query_terms(F.col("statement"))).alias("pos", "t")).select("input_id", "pos", "t.term", "t.prefix")


def _scoped(f: DataFrame) -> DataFrame:
    return f.withColumn("scope_id", F.when(temporal.live(), F.col("scope_id")))


def bm25_facts(spark: SparkSession, root: str) -> DataFrame:
    """The 60 best live facts of the readable scopes per query; statistics over all facts."""
    asked = _asked(spark, root)
    hits = lexical.bm25(asked, _scoped(facts(spark, root)), "id", "statement", _allowed(asked))
    return hits.select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def bm25_episodes(spark: SparkSession, root: str) -> DataFrame:
    """The 12 best episodes of the readable scopes per query."""
    asked = _asked(spark, root)
    hits = lexical.bm25(asked, episodes(spark, root), "id", "body", _allowed(asked), most=12)
    return hits.select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    v = spark.read.parquet(f"{root}/embeddings.parquet")
    return v.select(F.col("vec_id").alias("id"), "label", vectors.quantize(F.col("embedding")).alias("q"))


def quantized_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Every vector in eight bits, as text, and its cosine with itself."""
    return _vectors(spark, root).select("id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"), vectors.cosine(F.col("q"), F.col("q")).alias("own"))


def _near(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    return vectors.nearest(v.where(F.col("id") % EACH == 0).select(F.col("id").alias("query_id"), "q"), v)


def vector_top(spark: SparkSession, root: str) -> DataFrame:
    """The 60 nearest vectors of each asked one, exactly."""
    return _near(spark, root)


def vector_floor(spark: SparkSession, root: str) -> DataFrame:
    """Those of the nearest that reach the relative floor."""
    return vectors.relative_floor(_near(spark, root)).select("query_id", "id", "cos")


def _legs(spark: SparkSession, root: str) -> DataFrame:
    asked = _asked(spark, root)
    f = facts(spark, root)
    words = lexical.bm25(asked, _scoped(f), "id", "statement", _allowed(asked)).select("query_id", "id", F.lit("bm25").alias("leg"), "rank")
    own = temporal.live() & (F.col("f.scope_id") == F.col("q.scope_id")) & (F.col("f.src") == F.col("q.query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("recorded_at"), "id")
    edges = f.alias("f").join(asked.alias("q"), own).select("q.query_id", "f.id", "f.recorded_at").withColumn("rank", F.row_number().over(order)).where("rank <= 30")
    return words.unionByName(edges.select("query_id", "id", F.lit("graph").alias("leg"), "rank"))


def fused_legs(spark: SparkSession, root: str) -> DataFrame:
    """Reciprocal rank fusion of a lexical and a graph leg: the 48 best per query, with what found them."""
    fused = fusion.rrf(_legs(spark, root)).where(F.col("rank") <= 48)
    return fused.select("query_id", "id", "rank", F.array_join("via", "+").alias("via"), F.round("score", 9).alias("score"))


def adjusted_scores(spark: SparkSession, root: str) -> DataFrame:
    """The factor by which confidence, age and use move every fact's score."""
    f = facts(spark, root)
    return f.select("id", F.round(fusion.adjusted(F.lit(1.0), F.col("confidence"), F.col("recorded_at"), F.col("hits"), NOW), 9).alias("factor"))


def statement_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Word overlap of each fact with the one that replaced it."""
    f = facts(spark, root)
    by = f.select(F.col("id").alias("invalidated_by"), F.col("statement").alias("other"))
    return f.join(by, "invalidated_by").select("id", "invalidated_by", F.round(fusion.dice(F.col("statement"), F.col("other")), 9).alias("overlap"))


def diversified(spark: SparkSession, root: str) -> DataFrame:
    """Maximal marginal relevance over the fused facts of each query."""
    f = facts(spark, root)
    fused = fusion.rrf(_legs(spark, root)).where(F.col("rank") <= 48).drop("rank")
    pool = fused.join(f.select("id", "statement"), "id").withColumn("q", F.lit(None).cast("array<tinyint>"))
    return fusion.diversify(pool.select("query_id", "id", "score", "statement", "q"), 12).select("query_id", "id", "pick")


def recalled(spark: SparkSession, root: str) -> DataFrame:
    """The whole recall: three legs, fusion, adjustment, diversification."""
    return fusion.recall(_asked(spark, root), facts(spark, root), entities(spark, root), NOW)


def recall_legs(spark: SparkSession, root: str) -> DataFrame:
    """What each leg of the recall finds, before fusion."""
    return fusion.legs(_asked(spark, root), facts(spark, root), entities(spark, root))


def fused_episodes(spark: SparkSession, root: str) -> DataFrame:
    """Episodes that words or vectors find for each query, newest first."""
    asked, e = _asked(spark, root), episodes(spark, root)
    words = lexical.bm25(asked, e, "id", "body", _allowed(asked), most=12)
    index = e.select("id", "scope_id", vectors.hashed_embedding(F.col("body")).alias("q"))
    scopes = F.array_distinct(F.array("scope_id", F.lit(1).cast("long"))).alias("scopes")
    near = vectors.nearest(asked.select("query_id", scopes, vectors.hashed_embedding(F.col("text")).alias("q")), index, k=12)
    return fusion.fuse_episodes(words, near, e, 12)


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """The twelve best fused facts of each query as lines with their provenance, under the scope's header."""
    asked, f, e = _asked(spark, root), facts(spark, root), episodes(spark, root)
    best = fusion.rrf(_legs(spark, root)).where(F.col("rank") <= 12).select("query_id", "id", F.col("rank").alias("pick"))
    rows = temporal.resolved(f, entities(spark, root), e).join(best, "id")
    note = text.prov_note(*[F.col(c) for c in ("valid_from", "valid_to", "invalidated_at", "recorded_at", "source", "head", "confidence")], NOW)
    line = F.concat(F.lit("- "), F.trim("statement"), note, F.lit("\n"))
    labels = spark.read.parquet(f"{root}/scopes.parquet").select(F.col("id").alias("scope_id"), "label")
    heads = asked.join(labels, "scope_id").select("query_id", F.concat(F.lit("## Memory — "), "label", F.lit("\n")).alias("title"))
    return rows.select("query_id", "pick", "id", line.alias("line")).join(heads, "query_id").withColumnRenamed("title", "head")


def rendered_memories(spark: SparkSession, root: str) -> DataFrame:
    """What each query is answered with in 120 tokens: header, lines, note on what is left out."""
    return render.render(_lines(spark, root), 120).select("query_id", "text")


def rendered_ids(spark: SparkSession, root: str) -> DataFrame:
    """The facts that stand in the answers."""
    return render.within_budget(_lines(spark, root), 120).select("query_id", "id")


def explained(spark: SparkSession, root: str) -> DataFrame:
    """Every vector leg hit with the query's floor and whether it is kept."""
    top = F.max("cos").over(Window.partitionBy("query_id"))
    floor = F.greatest(F.lit(vectors.FLOOR_LEAST), vectors.FLOOR_SHARE * top)
    return _near(spark, root).select("query_id", "id", "cos", floor.alias("floor"), (F.col("cos") >= floor).alias("kept"))


def explained_facts(spark: SparkSession, root: str) -> DataFrame:
    """The cosine of every live fact of the readable scopes with each query, its floor, whether it is kept, and the full-text expression."""
    asked = _asked(spark, root)
    scopes = F.array_distinct(F.array("scope_id", F.lit(1).cast("long"))).alias("scopes")
    queries = asked.select("query_id", scopes, vectors.hashed_embedding(F.col("text")).alias("q"), lexical.match_string(F.col("text")).alias("match"))
    f = facts(spark, root).where(temporal.live())
    return vectors.explain(cut(queries), cut(f.select("id", "scope_id", vectors.hashed_embedding(F.col("statement")).alias("q"))))


def vector_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every vector whose cosine with an asked one of the same label is a quarter or more."""
    v = _vectors(spark, root).withColumn("scope_id", F.col("label").cast("long"))
    asked = v.where(F.col("id") % EACH == 0).select(F.col("id").alias("query_id"), "q", F.array("scope_id").alias("scopes"))
    return vectors.within(asked, v, 0.25)


def merged_facts(spark: SparkSession, root: str) -> DataFrame:
    """Live facts that say nearly the same as another of their scope, merged into the newer one; all live facts are candidates."""
    f = facts(spark, root).where(temporal.live())
    index = cut(f.select("id", "scope_id", "recorded_at", "hits", vectors.hashed_embedding(F.col("statement")).alias("q")))
    return vectors.merge_equal_and_near(index, NOW)


QUERIES = {
    q.__name__: q
    for q in (
        query_terms, bm25_facts, bm25_episodes, quantized_vectors, vector_top, vector_floor, fused_legs, adjusted_scores, statement_overlap, diversified, recalled, recall_legs,
        fused_episodes, vector_pairs, merged_facts, rendered_memories, rendered_ids, explained, explained_facts,
    )
}

_STOP = ", ".join(f"'{w}'" for w in STOP)
_FOLD = "strip_accents(lower({}))"


def _terms(table: str, id_: str, text: str) -> str:
    """Members raw, terms(query_id, pos, term, prefix): the search terms of a table's texts."""
    return f"""raw AS (SELECT {id_} AS query_id, unnest(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}\\p{{M}}_./@]+')) AS w, unnest(range(len(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}\\p{{M}}_./@]+')))) AS p FROM {table}),
cut AS (SELECT query_id, p, regexp_replace(w, '^[./]+|[./]+$', '', 'g') AS w FROM raw),
kept AS (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS pos FROM cut WHERE strlen(w) >= 2 AND lower(w) NOT IN ({_STOP})),
terms AS (SELECT query_id, pos, {_FOLD.format('w')} AS term, length(w) >= 3 AS prefix FROM kept WHERE pos < {MOST_TERMS})"""


def _bm25(docs: str, text: str, allowed: str, most: int) -> str:
    """Members up to hits(query_id, id, score, rank)."""
    return f"""q AS (SELECT id AS qid, name, scope_id FROM n WHERE id % {EACH} = 0),
{_terms('q', 'qid', 'name')},
tok AS (SELECT id, unnest(regexp_extract_all({_FOLD.format(text)}, '[\\p{{L}}\\p{{N}}_.@/]+')) AS tok FROM {docs}),
post AS (SELECT id, tok, count(*) AS tf FROM tok GROUP BY id, tok),
size AS (SELECT d.id, len(regexp_extract_all({_FOLD.format(text)}, '[\\p{{L}}\\p{{N}}_.@/]+')) AS dl FROM {docs} d),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM size),
ask AS (SELECT DISTINCT term, prefix FROM terms),
hit AS (SELECT term, prefix, id, sum(tf) AS tf FROM post JOIN ask ON CASE WHEN prefix THEN starts_with(tok, term) ELSE tok = term END GROUP BY term, prefix, id),
df AS (SELECT term, prefix, ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS raw, avgdl FROM hit, st GROUP BY term, prefix, n_docs, avgdl),
w AS (SELECT hit.term, hit.prefix, hit.id, CASE WHEN raw <= 0 THEN 1e-6 ELSE raw END * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / avgdl)) AS w FROM hit JOIN df USING (term, prefix) JOIN size ON size.id = hit.id),
sc AS (SELECT t.query_id, w.id, round(sum(w.w), 9) AS score FROM terms t JOIN w ON w.term = t.term AND w.prefix = t.prefix JOIN q ON q.qid = t.query_id JOIN {docs} d ON d.id = w.id
       WHERE {allowed} AND (d.scope_id = q.scope_id OR d.scope_id = 1) GROUP BY t.query_id, w.id),
hits AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= {most})"""


_Q = """v AS (SELECT vec_id AS id, label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS len, embedding FROM embeddings),
z AS (SELECT id, label, list_transform(embedding, lambda x: CASE WHEN len > 0 THEN CAST(greatest(-127, least(127, round(CAST(x AS DOUBLE) / len * 127))) AS INTEGER) ELSE 0 END) AS q FROM v)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
_TOP = (
    _Q
    + f""",
d AS (SELECT a.id AS query_id, b.id, {_DOT.format(a='a.q', b='b.q')} AS dot FROM z a, z b WHERE a.id % {EACH} = 0),
t AS (SELECT query_id, id, dot / 16129.0 AS cos, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, id) AS rank FROM d QUALIFY rank <= 60)"""
)
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda w: strlen(w) > 2))"

_FUSED = _bm25("f", "statement", "d.invalidated_at IS NULL", 60) + """,
g AS (SELECT q.qid AS query_id, f.id, row_number() OVER (PARTITION BY q.qid ORDER BY f.recorded_at DESC, f.id) AS rank FROM q JOIN f ON f.src = q.qid AND f.scope_id = q.scope_id WHERE f.invalidated_at IS NULL QUALIFY rank <= 30),
l AS (SELECT query_id, id, 'bm25' AS leg, 1.0 / (60 + rank) AS s FROM hits UNION ALL SELECT query_id, id, 'graph', 0.5 / (60 + rank) FROM g),
u AS (SELECT query_id, id, round(sum(s), 12) AS score, string_agg(leg, '+' ORDER BY leg) AS via FROM l GROUP BY query_id, id)"""
_LINES = (
    _FUSED
    + f""",
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pick FROM u QUALIFY pick <= 12),
{SQL_NOTES},
li AS (SELECT b.query_id, b.pick, b.id, '- ' || trim(f.statement) || o.note || chr(10) AS line, '## Memory — ' || s.label || chr(10) AS head
       FROM b JOIN f ON f.id = b.id JOIN o ON o.id = b.id JOIN q ON q.qid = b.query_id JOIN scopes s ON s.id = q.scope_id),
co AS (SELECT *, {sql_tokens('head')} + sum({sql_tokens('line')}) OVER (PARTITION BY query_id ORDER BY pick ROWS UNBOUNDED PRECEDING) AS used FROM li),
sh AS (SELECT * FROM co WHERE pick = 1 OR used <= 120)"""
)

ORACLES = {
    "query_terms": with_("i", _terms("i", "input_id", "statement")) + "SELECT query_id AS input_id, pos, term, prefix FROM terms",
    "bm25_facts": with_("f n", _bm25("f", "statement", "d.invalidated_at IS NULL", 60)) + "SELECT query_id, id, rank, round(score, 5) AS score FROM hits",
    "bm25_episodes": with_("e n", _bm25("e", "body", "true", 12)) + "SELECT query_id, id, rank, round(score, 5) AS score FROM hits",
    "quantized_vectors": f"WITH {_Q} SELECT id, array_to_string(q, ',') AS q, {_DOT.format(a='q', b='q')} / 16129.0 AS own FROM z",
    "vector_top": f"WITH {_TOP} SELECT query_id, id, cos, rank FROM t",
    "vector_floor": f"WITH {_TOP} SELECT query_id, id, cos FROM t QUALIFY cos >= greatest(0.02, 0.65 * max(cos) OVER (PARTITION BY query_id))",
    "fused_legs": with_("f n", _FUSED) + "SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, via, round(score, 9) AS score FROM u QUALIFY rank <= 48",
    "rendered_ids": with_("f n e", _LINES) + "SELECT query_id, id FROM sh",
    "rendered_memories": with_("f n e", _LINES) + """SELECT sh.query_id, any_value(sh.head) || string_agg(sh.line, '' ORDER BY sh.pick) || CASE WHEN any_value(t.n) > count(*)
THEN '- … ' || (any_value(t.n) - count(*)) || ' more memories not shown (raise the budget or narrow the query)' || chr(10) ELSE '' END AS text
FROM sh JOIN (SELECT query_id, count(*) AS n FROM li GROUP BY query_id) t ON t.query_id = sh.query_id GROUP BY sh.query_id""",
    "explained": f"WITH {_TOP}, x AS (SELECT *, greatest(0.02, 0.65 * max(cos) OVER (PARTITION BY query_id)) AS floor FROM t) SELECT query_id, id, cos, floor, cos >= floor AS kept FROM x",
    "vector_pairs": f"WITH {_Q} SELECT a.id AS query_id, b.id, {_DOT.format(a='a.q', b='b.q')} / 16129.0 AS cos FROM z a JOIN z b ON a.label = b.label WHERE a.id % {EACH} = 0 AND {_DOT.format(a='a.q', b='b.q')} >= 0.25 * 16129",
    "adjusted_scores": with_("f") + f"""SELECT id, round((0.7 + 0.3 * greatest(0, least(1, confidence))) * (0.85 + 0.15 * exp(-(greatest(0, {NOW} - recorded_at) / 86400000.0) / 90)) * (1 + 0.05 * ln(1 + hits)), 9) AS factor FROM f""",
    "statement_overlap": with_("f", f"o AS (SELECT a.id, a.invalidated_by, {_WORDS.format('a.statement')} AS x, {_WORDS.format('b.statement')} AS y FROM f a JOIN f b ON b.id = a.invalidated_by)")
    + "SELECT id, invalidated_by, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 9) AS overlap FROM o",
    # One pick after the other: `held` is the pool of a query in order, with what is still open and how near each is to the picks.
    "diversified": with_("f n", _FUSED + f""",
t AS (SELECT query_id, id, score FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 48),
x AS (SELECT t.query_id, t.id, t.score, CASE WHEN max(t.score) OVER v - min(t.score) OVER v > 1.2e-7 THEN (t.score - min(t.score) OVER v) / (max(t.score) OVER v - min(t.score) OVER v) ELSE 1.0::DOUBLE END AS rel,
  {_WORDS.format('f.statement')} AS words FROM t JOIN f ON f.id = t.id WINDOW v AS (PARTITION BY t.query_id)),
pool AS (SELECT query_id, 0 AS step, list({{'id': id, 'rel': rel::DOUBLE, 'words': words, 'near': 0.0::DOUBLE, 'open': true, 'pick': 0}} ORDER BY score DESC, id) AS held FROM x GROUP BY query_id)""").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, r AS (SELECT query_id, step, held FROM pool UNION ALL
SELECT query_id, step + 1, list_transform(held, lambda h, j: {'id': h.id, 'rel': h.rel, 'words': h.words, 'near': CASE WHEN h.open AND j <> i THEN greatest(h.near, d[j]) ELSE h.near END, 'open': h.open AND j <> i AND d[j] < 0.82::DOUBLE, 'pick': CASE WHEN j = i THEN step + 1 ELSE h.pick END})
FROM (SELECT query_id, step, held, i, list_transform(held, lambda h: CASE WHEN len(h.words) = 0 OR len(held[i].words) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(h.words, held[i].words)) / (len(h.words) + len(held[i].words)) END) AS d
  FROM (SELECT query_id, step, held, list_position(w, list_max(w)) AS i FROM (SELECT query_id, step, held, list_transform(held, lambda h: CASE WHEN h.open THEN 0.72::DOUBLE * h.rel - (1 - 0.72::DOUBLE) * h.near ELSE -1e9 END) AS w
    FROM r WHERE step < 12 AND len(list_filter(held, lambda h: h.open)) > 0)))),
last AS (SELECT query_id, unnest(arg_max(held, step)) AS h FROM r GROUP BY query_id)
SELECT query_id, h.id AS id, h.pick AS pick FROM last WHERE h.pick > 0""",
}
