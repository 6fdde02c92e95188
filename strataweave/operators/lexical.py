"""Full-text search: query terms, postings, BM25 with prefix terms, for many queries in one job."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import cut, kept

# Words without retrieval signal, English and Spanish.
STOP = (
    "the a an and or of to in on for is are was were be do does did how what when why which that this it with at by from as we i you my our "
    "el la los las un una de del y o que es son en con para por como se lo al mi nuestro cual cuando"
).split()
MOST_TERMS = 24
K1, B = 1.2, 0.75
_ACCENTED = [chr(c) for c in range(0xC0, 0x180) if unicodedata.normalize("NFD", chr(c))[0].isascii()]


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), "".join(_ACCENTED), "".join(unicodedata.normalize("NFD", c)[0].lower() for c in _ACCENTED))


def tokens(text: Column) -> Column:
    """Index tokens of a text: runs of letters, digits and `_.@/`, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}_.@/]+"), F.lit(0))


def _kept(text: Column) -> Column:
    raw = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}\p{M}_./@]+"), F.lit(0))
    cut = F.transform(raw, lambda t: F.regexp_replace(t, r"^[./]+|[./]+$", ""))
    return F.slice(F.filter(cut, lambda t: (F.octet_length(t) >= 2) & ~F.lower(t).isin(*STOP)), 1, MOST_TERMS)


def query_terms(text: Column) -> Column:
    """Array of structs (term, prefix): at most 24 terms, repeated ones kept; terms of three characters match by prefix."""
    return F.transform(_kept(text), lambda t: F.struct(folded(t).alias("term"), (F.char_length(t) >= 3).alias("prefix")))


def match_string(text: Column) -> Column:
    """The full-text expression of the query terms as they are written, such as `"Cache"* OR "no"`; null where there are none."""
    terms = F.transform(_kept(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'), F.when(F.char_length(t) >= 3, "*").otherwise("")))
    return F.when(F.size(terms) > 0, F.array_join(terms, " OR "))


def postings(docs: DataFrame, id_: str, text: str, *keep: str) -> DataFrame:
    """Rows (doc, tok, dl, tf, keep...): how often a token stands in a document of dl tokens."""
    split = docs.select(F.col(id_).alias("doc"), tokens(F.col(text)).alias("toks"), *keep)
    return split.select("doc", F.size("toks").alias("dl"), F.explode("toks").alias("tok"), *keep).groupBy("doc", "tok", "dl", *keep).agg(F.count("*").alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, id_: str, text: str, allowed: DataFrame | None = None, most: int = 60) -> DataFrame:
    """Rows (query_id, id, score, rank) for queries (query_id, text).

    Statistics cover all docs; `allowed` (query_id, id) or, more cheaply, (query_id, scope_id) with a scope_id in docs,
    only filters what is returned: a query meets the hits of its own scopes alone. Ties go to the smaller id; scores are rounded to nine decimals before ranking.
    """
    terms = queries.select("query_id", F.inline(query_terms(F.col("text"))))
    by_scope = ["scope_id"] if allowed is not None and "scope_id" in allowed.columns else []
    # The index is written once and read for its words, its lengths and its hits.
    post = kept(postings(docs, id_, text, *by_scope))
    sizes = docs.agg(F.count("*").alias("n_docs"), F.count(text).alias("n_texts"))
    stats = F.broadcast(post.agg(F.sum("tf").alias("n_toks")).crossJoin(sizes).select("n_docs", F.try_divide("n_toks", "n_texts").alias("avgdl")))  # one row
    asked = terms.select("term", "prefix").distinct()
    words = post.select("tok").distinct()
    # A prefix term has three characters or more and agrees in them with its words: an equi-join, then a check.
    key = lambda c: F.substring(c, 1, 3)
    begun = words.withColumn("k", key("tok")).join(asked.where("prefix").withColumn("k", key("term")), "k").where(F.col("tok").startswith(F.col("term")))
    whole = asked.where(~F.col("prefix")).join(words, F.col("tok") == F.col("term"))
    match = begun.select("term", "prefix", "tok").unionByName(whole.select("term", "prefix", "tok"))
    hits = cut(post.join(match, "tok").groupBy("term", "prefix", "doc", "dl", *by_scope).agg(F.sum("tf").alias("tf")))
    spread = hits.groupBy("term", "prefix").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    spread = spread.crossJoin(stats).select("term", "prefix", "avgdl", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))  # one row of statistics
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    weighed = hits.join(spread, ["term", "prefix"]).select("term", "prefix", "doc", *by_scope, (F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("w"))
    times = terms.groupBy("query_id", "term", "prefix").agg(F.count("*").alias("times"))
    if by_scope:
        times = times.join(allowed.select("query_id", "scope_id").distinct(), "query_id")
    found = weighed.join(times, ["term", "prefix", *by_scope])
    if not by_scope and allowed is not None:
        found = found.join(allowed.select("query_id", F.col("id").alias("doc")), ["query_id", "doc"])
    scored = found.groupBy("query_id", F.col("doc").alias("id")).agg(F.round(F.sum(F.col("w") * F.col("times")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
