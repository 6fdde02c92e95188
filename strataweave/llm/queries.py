"""The subpackage's queries by name."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import forms, languages, leakage, names, neardup, packing, personal, reading
from strataweave.tables import once, read


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    episodes = read(spark, root, "episodes", "id", "body", "meta")
    inputs = read(spark, root, "fact_inputs", "input_id", "statement", "lang")
    return episodes.select(F.concat(F.lit("episodes:"), "id").alias("key"), F.col("body").alias("text"), F.get_json_object("meta", "$.lang").alias("label")).unionByName(
        inputs.select(F.concat(F.lit("fact_inputs:"), "input_id").alias("key"), F.col("statement").alias("text"), F.col("lang").alias("label"))
    )


def _record(found: DataFrame, *columns: str) -> DataFrame:
    part = F.split("key", ":")
    return found.select(part[0].alias("tab"), part[1].cast("long").alias("rec_id"), *columns)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Segments by language of the episodes and fact inputs whose label is missing or wrong, or that mix languages."""
    return _record(languages.label_cases(_labelled(spark, root), "key", "text", "label"), "seg_no", "lang")


def p1_segments(spark: SparkSession, root: str) -> DataFrame:
    """Every record and every stretch of it with its language and a confidence."""
    texts = _labelled(spark, root)
    model = languages.train(languages.sample(texts, "key", "text", languages.label_language(F.col("label")), 1500))
    return _record(languages.segments(texts, "key", "text", model), "seg_no", "lang", "confidence", "words").distinct()


def _names(spark: SparkSession, root: str) -> tuple:
    entities = once(read(spark, root, "entities", "id", "scope_id", "name", "norm", "kind", "degree"), "id")
    given = personal.learn_given(entities, "name", "kind")
    return entities, "scope_id", "id", "name", "degree", given


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of entities of one scope whose names stand for the same person or organisation."""
    return names.same_entity(*_names(spark, root))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    """The group of every entity whose name is a person's or an organisation's."""
    return names.groups(*_names(spark, root))


def _free_text(spark: SparkSession, root: str) -> DataFrame:
    episodes = read(spark, root, "episodes", "id", "body").select(F.lit("episodes").alias("tab"), F.col("id").alias("rec_id"), F.col("body").alias("text"))
    inputs = read(spark, root, "fact_inputs", "input_id", "statement")
    return episodes.unionByName(inputs.select(F.lit("fact_inputs").alias("tab"), F.col("input_id").alias("rec_id"), F.col("statement").alias("text")))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Each piece of personal information in episode bodies and statements of fact inputs."""
    given = personal.learn_given(read(spark, root, "entities", "name", "kind"), "name", "kind")
    return personal.findings(_free_text(spark, root), given).select("tab", "rec_id", "pii_type", "val_key").distinct()


def p3_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The same texts with typed placeholders in place of the personal information."""
    given = personal.learn_given(read(spark, root, "entities", "name", "kind"), "name", "kind")
    return personal.redact(once(_free_text(spark, root), "tab", "rec_id"), given).select("tab", "rec_id", "redacted")


def _looks(spark: SparkSession, root: str) -> DataFrame:
    entities = read(spark, root, "entities", "id", "scope_id", "norm")
    episodes = read(spark, root, "episodes", "id", "scope_id", "body")
    return entities.select(F.lit("entities").alias("tab"), "scope_id", "id", F.col("norm").alias("text")).unionByName(
        episodes.select(F.lit("episodes").alias("tab"), "scope_id", "id", F.col("body").alias("text"))
    )


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of entities (by norm) and of episodes (by body) of one scope that look the same but differ in characters."""
    return forms.alike(_looks(spark, root), ["tab", "scope_id"], "id", "text").select("tab", "id_a", "id_b")


def p5_forms(spark: SparkSession, root: str) -> DataFrame:
    """The consistent form of every norm and body."""
    texts = once(_looks(spark, root), "tab", "id")
    return forms.canonical(texts, ["tab", "id"], "text").select("tab", "id", "form")


def p5_classes(spark: SparkSession, root: str) -> DataFrame:
    """The class of every norm and body that reads like others of its scope: its smallest id and how many there are."""
    return forms.classes(_looks(spark, root), ["tab", "scope_id"], "id", "text").select("tab", "id", "class_id", "members")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of episodes in one group of near copies: three-word runs, 60 %, bodies of 15 words or more."""
    return neardup.group_pairs(p6_groups(spark, root))


def p6_groups(spark: SparkSession, root: str) -> DataFrame:
    """The group of every episode that takes part."""
    episodes = read(spark, root, "episodes", "id", "body")
    return neardup.groups(episodes, "id", "body", width=3, share=0.6, least_words=15)


def _packed(spark: SparkSession, root: str) -> DataFrame:
    sizes = packing.token_counts(read(spark, root, "documents", "doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, read(spark, root, "budgets", "budget_id", "capacity"))


def p7_bins(spark: SparkSession, root: str) -> DataFrame:
    """Every document, or part of one, in its container, for each capacity of budgets."""
    return _packed(spark, root)


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are, per capacity."""
    return packing.fill(_packed(spark, root), read(spark, root, "budgets", "budget_id", "capacity"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that reproduce 15 or more successive words of a held-out item, one word in ten changed at most."""
    docs = read(spark, root, "documents", "doc_id", "text")
    return leakage.leaks(docs, "doc_id", "text", read(spark, root, "eval_items", "item_id", "text"), "item_id", "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The reading level, on the raters' scale, of every document with 60 words of prose or more."""
    docs = read(spark, root, "documents", "doc_id", "text", "source")
    return reading.levels(docs, "doc_id", "text", "source", read(spark, root, "ratings", "doc_id", "grade"))


def p9_agreement(spark: SparkSession, root: str) -> DataFrame:
    """How often the levels of held-out documents are the raters', by source."""
    docs = read(spark, root, "documents", "doc_id", "text", "source")
    return reading.agreement(docs, "doc_id", "text", "source", read(spark, root, "ratings", "doc_id", "grade"))


QUERIES = {
    q.__name__: q
    for q in (p1_found, p1_segments, p2_found, p2_groups, p3_found, p3_redacted, p5_found, p5_forms, p5_classes, p6_found, p6_groups, p7_bins, p7_fill, p8_found, p9_found, p9_agreement)
}

_FROM = "".join(forms.SAME_SHAPE) + "".join(chr(0xFF01 + i) for i in range(94)) + forms.HYPHENS.replace("－", "")
_TO = "".join(forms.SAME_SHAPE.values()) + "".join(chr(0x21 + i) for i in range(94)) + "-" * (len(forms.HYPHENS) - 1)


def _sql_form(x: str) -> str:
    """The table form in SQL, as far as the test tables need it: shapes, wide forms, ligatures, hyphens, blanks, ignorables, accents."""
    accented = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x386, 0x460) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    for joined, parts in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("…", "..."), *accented):
        x = f"replace({x}, '{joined}', '{parts}')"
    quoted = [t.replace("'", "''") for t in (_FROM, _TO)]
    return f"nfc_normalize(regexp_replace(regexp_replace(translate({x}, '{quoted[0]}', '{quoted[1]}'), '\\p{{Cf}}', '', 'g'), '\\p{{Zs}}', ' ', 'g'))"


ORACLES: dict[str, str] = {
    "p5_found": f"""
WITH t AS (SELECT DISTINCT 'entities' AS tab, id, scope_id, norm AS text FROM entities UNION SELECT DISTINCT 'episodes', id, scope_id, body FROM episodes),
u AS (SELECT *, {_sql_form('text')} AS form FROM t)
SELECT a.tab, a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.tab = b.tab AND a.scope_id = b.scope_id AND a.form = b.form AND a.text <> b.text AND a.id < b.id""",
    "p5_classes": f"""
WITH t AS (SELECT DISTINCT 'entities' AS tab, id, scope_id, norm AS text FROM entities UNION SELECT DISTINCT 'episodes', id, scope_id, body FROM episodes),
u AS (SELECT tab, id, scope_id, {_sql_form('text')} AS form FROM t WHERE text IS NOT NULL),
c AS (SELECT tab, id, min(id) OVER w AS class_id, count(*) OVER w AS members FROM u WINDOW w AS (PARTITION BY tab, scope_id, form))
SELECT tab, id, class_id, members FROM c WHERE members > 1""",
    "p6_found": f"""
WITH RECURSIVE w AS (SELECT id, regexp_extract_all(lower({_sql_form('body')}), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT DISTINCT id, body FROM episodes)),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 15),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
e AS (SELECT x, y FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE k >= 0.6 * (p.n + q.n - k) - 1e-9),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT DISTINCT a AS id_a, b AS id_b FROM r WHERE a < b""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
