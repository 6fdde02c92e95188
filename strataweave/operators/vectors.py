"""Eight-bit vectors: quantization, cosine, exact top-k for a stated set of queries, near-duplicate merging."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import cut

UNIT = 127 * 127
MERGE_AT = 0.96
FLOOR_LEAST, FLOOR_SHARE = 0.02, 0.65


def quantize(vector: Column) -> Column:
    """The vector scaled to length one, times 127, rounded half away from zero; a zero vector stays zero."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    length = F.sqrt(squares)
    scaled = F.transform(vector, lambda x: F.round(x.cast("double") / length * 127, 0))
    return F.when(length > 0, F.transform(scaled, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x)).cast("tinyint"))).otherwise(
        F.transform(vector, lambda x: F.lit(0).cast("tinyint"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two quantized vectors over the shorter one's length, in units of one; not normalized again."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("int") * y.cast("int"))
    return F.aggregate(products, F.lit(0), lambda s, x: s + x) / UNIT


def _search(queries: DataFrame, vectors: DataFrame, block: int, dim: int | None, pick) -> DataFrame:
    """Rows (query_id, id, dot): of every batch of vectors what `pick(dots, ids)` keeps per query.

    The queries are a stated set, taken in blocks of at most `block`; each batch of vectors keeps its own hits before
    anything is shuffled. Vectors of another dimension than `dim` (default: the first query's) are left out. Where queries have a column `scopes` (array of
    ids) and vectors a `scope_id`, a query sees the vectors of its scopes only.
    """
    scoped = "scopes" in queries.columns
    rows, out = queries.select("query_id", "q", *["scopes"] * scoped).where("q IS NOT NULL").toLocalIterator(), None
    while part := list(islice(rows, block)):
        width = dim or len(part[0].q)
        part = [r for r in part if len(r.q) == width]
        ids = np.array([r.query_id for r in part], dtype=np.int64)
        matrix = np.array([list(r.q) for r in part], dtype=np.float32).reshape(len(part), width)
        sees: dict[frozenset, list[int]] | None = {} if scoped else None  # the queries that see the same scopes
        for i, r in enumerate(part if scoped else ()):
            sees.setdefault(frozenset(r.scopes), []).append(i)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, sees))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked, m, sees = shared.value
            for b in batches:
                own = b["id"].to_numpy()
                scope = b["scope_id"].to_numpy() if sees else None
                dots = m @ np.stack(b["q"].to_numpy()).astype(np.float32).T  # exact: sums of products of small integers
                if sees:
                    for scopes, mine in sees.items():
                        dots[np.ix_(mine, ~np.isin(scope, list(scopes)))] = -np.inf
                for lo in range(0, dots.shape[1], 20_000):
                    d, o = dots[:, lo : lo + 20_000], own[lo : lo + 20_000]
                    row, col = pick(d, o)
                    seen = d[row, col] > -np.inf
                    row, col = row[seen], col[seen]
                    yield pd.DataFrame({"query_id": asked[row], "id": o[col], "dot": d[row, col].astype(np.int64)})

        if len(part):
            got = vectors.where(F.size("q") == width).select("id", "q", *["scope_id"] * scoped).mapInPandas(run, "query_id long, id long, dot long")
            out = got if out is None else out.unionByName(got)
    return vectors.sparkSession.createDataFrame([], "query_id long, id long, dot long") if out is None else out


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 60, block: int = 4096, dim: int | None = None) -> DataFrame:
    """Rows (query_id, id, cos, rank): for queries (query_id, q) the k nearest of vectors (id, q), exactly.

    A query finds its own vector too; ties go to the smaller id. See `_search` for blocks, dimensions and scopes.
    """

    def best(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        least = np.partition(d, -k, axis=1)[:, -k] if d.shape[1] > k else np.full(len(d), -np.inf)
        row, col = np.nonzero(d >= least[:, None])  # the k best and what ties with the last of them
        order = np.lexsort((ids[col], -d[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], col[place < k]

    order = Window.partitionBy("query_id").orderBy(F.desc("dot"), "id")
    hits = _search(queries, vectors, block, dim, best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return hits.select("query_id", "id", (F.col("dot") / UNIT).alias("cos"), "rank")


def within(queries: DataFrame, vectors: DataFrame, least: float, block: int = 4096, dim: int | None = None) -> DataFrame:
    """Rows (query_id, id, cos): all of vectors (id, q) whose cosine with a query is at least `least`, its own included; with -inf all."""
    floor = max(least * UNIT, float(np.finfo(np.float32).min))  # what a query does not see has -inf
    hits = _search(queries, vectors, block, dim, lambda d, ids: np.nonzero(d >= floor))
    return hits.select("query_id", "id", (F.col("dot") / UNIT).alias("cos"))


def relative_floor(hits: DataFrame) -> DataFrame:
    """Hits (query_id, cos) that reach 0.65 of the query's best cosine, and 0.02."""
    top = F.max("cos").over(Window.partitionBy("query_id"))
    return hits.withColumn("_top", top).where(F.col("cos") >= F.greatest(F.lit(FLOOR_LEAST), FLOOR_SHARE * F.col("_top"))).drop("_top")


def read(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors (id, q) of ids (id); unknown ids have no row."""
    return vectors.join(ids.select("id").distinct(), "id", "left_semi").select("id", "q")


def worst_cosine(probes: DataFrame) -> DataFrame:
    """One row (probes, worst): the least cosine between the two vectors (a, b) of a probe; a zero vector counts 0, no probes give null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
    return probes.agg(F.count("*").alias("probes"), F.min(F.when(length > 0, dot(F.col("a"), F.col("b")) / length).otherwise(0.0)).alias("worst"))


def reindex(texts: DataFrame, model: str, embed=None) -> DataFrame:
    """Rows (kind, ref_id, q, model): every text (kind, ref_id, text) embedded anew and stamped with the model and dimension it comes from."""
    q = (embed or hashed_embedding)(F.col("text"))
    return texts.select("kind", "ref_id", q.alias("q")).withColumn("model", F.concat(F.lit(f"{model}:"), F.size("q").cast("string")))


def of_model(index: DataFrame, model: str, dim: int) -> DataFrame:
    """The vectors of an index that come from this model and dimension; those of another are never compared."""
    return index.where((F.col("model") == f"{model}:{dim}") & (F.size("q") == dim))


def explain(queries: DataFrame, vectors: DataFrame, block: int = 512) -> DataFrame:
    """Rows (query_id, match, id, cos, floor, kept): every vector that a query (query_id, q, scopes, match) sees, whether kept or not.

    The floor hangs on the query's best cosine, which a first search finds; then each block of queries meets the vectors
    again, so that the rows, as many as queries times the vectors they see, are never shuffled.
    """
    tops = nearest(queries, vectors, k=1).select("query_id", F.greatest(F.lit(FLOOR_LEAST), FLOOR_SHARE * F.col("cos")).alias("floor"))
    asked = cut(queries.join(tops.hint("merge"), "query_id"))
    parts, out = max(1, -(-asked.count() // block)), None
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        hits = within(mine, vectors, float("-inf"), block).join(F.broadcast(mine.select("query_id", "match", "floor")), "query_id")  # a block of stated queries
        out = hits if out is None else out.unionByName(hits)
    return out.select("query_id", "match", "id", "cos", "floor", (F.col("cos") >= F.col("floor")).alias("kept"))


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Quantized mean of pseudo-random word vectors: a static embedding that needs no model file."""

    def run(texts: pd.Series) -> pd.Series:
        import xxhash

        known: dict[str, np.ndarray] = {}

        def word(w: str) -> np.ndarray:
            if w not in known:
                if len(known) > 200_000:
                    known.clear()
                seed = xxhash.xxh64(w).intdigest()
                known[w] = np.random.default_rng(seed).standard_normal(dim)
            return known[w]

        out = []
        for t in texts:
            words = t.lower().split() if t else []
            v = np.mean([word(w.strip(".,;:!?\"'()")) for w in words], axis=0) if words else np.zeros(dim)
            n = np.linalg.norm(v)
            scaled = v / n * 127 if n > 0 else v
            out.append(np.clip(np.trunc(scaled + np.copysign(0.5, scaled)), -127, 127).astype(np.int8) if n > 0 else np.zeros(dim, dtype=np.int8))
        return pd.Series(out)

    return F.pandas_udf(run, "array<tinyint>")(text)


def equal_vectors(facts: DataFrame, least: float = MERGE_AT) -> DataFrame:
    """Rows (scope_id, q, rep, own): the distinct vectors of facts (id, scope_id, q) per scope, named by their smallest id.

    A vector whose cosine with itself is below `least` (such as the zero vector) is near none of its copies: `own` is
    then the fact's id, else null, and each such fact stands alone.
    """
    own = F.when(cosine(F.col("q"), F.col("q")) < least, F.col("id"))
    return facts.where(F.col("q").isNotNull() & F.col("scope_id").isNotNull()).withColumn("own", own).groupBy("scope_id", "q", "own").agg(F.min("id").alias("rep"))


def near_pairs(classes: DataFrame, least: float = MERGE_AT, block: int = 4096) -> DataFrame:
    """Rows (a, b), a < b: all pairs of vectors (rep, scope_id, q) of one scope whose cosine is at least `least`, exactly.

    Scopes are cut into blocks of about `block` vectors, every two blocks of a scope (and each with itself) meet in one
    group, so that no task holds more than two blocks. Vectors of different lengths do not meet.
    """
    sized = classes.withColumn("dim", F.size("q"))
    parts = sized.groupBy("scope_id", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = sized.join(parts.hint("merge"), ["scope_id", "dim"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = placed.select("rep", "q", "scope_id", "dim", "mine", other.alias("other"))
    met = met.select("rep", "q", "scope_id", "dim", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        left, right = (group[group["mine"] == group[c].iloc[0]] for c in ("lo", "hi"))
        out = []
        if len(left) and len(right):
            a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
            x, y = (np.stack(g["q"].to_numpy()).astype(np.float32) for g in (left, right))
            for at in range(0, len(a), 512):
                row, col = np.nonzero(x[at : at + 512] @ y.T >= least * UNIT)  # exact: sums of products of small integers
                row, col = a[at : at + 512][row], b[col]
                keep = row < col if len(left) == len(group) else row != col
                out.append(np.stack([np.minimum(row, col)[keep], np.maximum(row, col)[keep]], axis=1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64), columns=["a", "b"])

    return met.groupBy("scope_id", "dim", "lo", "hi").applyInPandas(run, "a long, b long")


def merge_near_duplicates(pairs: DataFrame, facts: DataFrame, now_ts: int) -> DataFrame:
    """Rows (keep, gone, hits, invalidated_at): greedy merging of near-duplicate facts (id, recorded_at, hits).

    Every fact is a candidate, in the order of ids, and meets the facts near it in that order: the newer one survives,
    the candidate on a tie, and a fact that has gone takes part in no later merge. `pairs` (a, b) are near each other,
    in either order; where facts have a column `rep` (the smallest id of those with an equal vector), pairs are of reps
    and equal facts are near each other too, without a pair. Each connected component is swept once by id: of equal
    facts at most one is a candidate that still looks for others, so a fact costs as much as its vector has neighbours,
    and a component holds its distinct vectors only, however many copies they have.
    """
    from strataweave.operators.components import components

    info = facts.select("id", "recorded_at", "hits", (F.col("rep") if "rep" in facts.columns else F.col("id")).alias("rep"))
    roots = components(pairs, "a", "b").select(F.col("node").alias("rep"), "root")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b")
    near = both.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("near"))
    copies = info.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    walked = roots.join(copies.hint("merge"), "rep", "full").select("rep", F.coalesce("root", "rep").alias("root"))
    rows = info.join(walked.hint("merge"), "rep").join(near.hint("merge"), "id", "left")  # the neighbours come with the first of equal facts

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, looking, known = None, {}, {}
        for b in batches:
            out = []
            for root, x, rep, t, hits, others in b[["root", "id", "rep", "recorded_at", "hits", "near"]].itertuples(index=False):
                if root != at:
                    at, looking, known = root, {}, {}
                if others is not None:
                    known[rep] = [int(o) for o in others]
                for a, ta, ha, of in sorted(looking[o] for o in (rep, *known.get(rep, ())) if o in looking):
                    if ta >= t:
                        out.append((a, x, hits))
                        break
                    out.append((x, a, ha))
                    del looking[of]
                else:
                    looking[rep] = (x, t, hits, rep)
            yield pd.DataFrame(out, columns=["keep", "gone", "hits"])

    merged = rows.select("root", "id", "rep", "recorded_at", "hits", "near").repartition("root").sortWithinPartitions("root", "id").mapInPandas(walk, "keep long, gone long, hits long")
    return merged.withColumn("invalidated_at", F.lit(now_ts))


def merge_equal_and_near(index: DataFrame, now_ts: int, least: float = MERGE_AT, block: int = 4096) -> DataFrame:
    """Rows (keep, gone, hits, invalidated_at) of `merge_near_duplicates` over all facts (id, scope_id, recorded_at, hits, q) of an index."""
    classes = cut(equal_vectors(index, least))
    own = F.when(cosine(F.col("q"), F.col("q")) < least, F.col("id"))
    same = (F.col("f.scope_id") == F.col("c.scope_id")) & (F.col("f.q") == F.col("c.q")) & F.col("f.own").eqNullSafe(F.col("c.own"))
    facts = index.withColumn("own", own).alias("f").join(classes.hint("merge").alias("c"), same).select("f.id", "f.recorded_at", "f.hits", "c.rep")
    return merge_near_duplicates(cut(near_pairs(classes, least, block)), cut(facts), now_ts)
