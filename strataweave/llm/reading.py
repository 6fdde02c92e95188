"""Problem 9: the reading level of each document, by gradient-boosted regression trees.

Every document becomes one row of features: distributions (means, spread and quantiles over its sentences) of length,
vocabulary, syntax and cohesion, read from its prose only. Trees are boosted on the rated documents, a bounded sample
of at most `most_rated` documents chosen by a hash of their id. Rated documents are held out by source: the out-of-fold
predictions give the calibration, the cut points between grades that agree best with the raters, and an honest figure
of how far the levels can be trusted. Training sees the sample only; features and levels cover all documents.

Defined results: null texts, rows without an id and documents with fewer than `least_words` words of prose get no level; repeated rows get
equal levels; without ratings there is no result; ratings of unknown documents are ignored. Texts are read whole.
Further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.languages import split
from strataweave.session import cut

# Frequent function words that tell the five languages apart.
MARKERS = {
    "en": "the of and to that which",
    "es": "el los una que del y",
    "fr": "le les des une et du",
    "de": "der die das und nicht ein",
    "pt": "o os uma não do um",
}
_MARK = {w: i for i, words in enumerate(MARKERS.values()) for w in words.split()}
_MARKS = frozenset(_MARK)
_WORD = re.compile(r"[^\W\d_][\w'’-]*")
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
_AT = np.array(QUANTILES)
PARTS = ("words", "letters", "long", "longest", "commas", "rare")
FEATURES = [f"{p}_{s}" for p in PARTS for s in ("mean", "sd", *(f"q{int(100 * q)}" for q in QUANTILES))] + [
    "simple", "complex", "types", "carry", "repeat", "colon", *(f"lang_{k}" for k in MARKERS)
]


def describe(text: str) -> tuple[int, np.ndarray | None]:
    """(words of prose, features) of a text; no features where it has no sentence of three words."""
    rows, total, bags = [], 0, []
    marks = [0.0] * len(MARKERS)
    colons = 0
    for piece, prose in split(text):
        if not prose or piece.startswith(("#", "==")):
            continue
        tokens = piece.split()
        total += len(tokens)
        words = _WORD.findall(piece.lower())
        if len(words) < 3:
            continue
        sizes = list(map(len, words))
        n = len(words)
        bags.append({w for w, s in zip(words, sizes) if s > 4})
        sizes.sort()
        rows.append((n, sum(sizes) / n, (n - bisect_left(sizes, 9)) / n, sizes[-1], piece.count(",") + piece.count(";"), n - bisect_left(sizes, 12)))
        colons += ":" in piece
        for w in _MARKS.intersection(words):
            marks[_MARK[w]] += 1
    if not rows:
        return total, None
    m = np.array(rows, dtype=float)
    out = []
    mean = m.sum(axis=0) / len(m)
    sd = np.sqrt(((m - mean) ** 2).sum(axis=0) / len(m))
    place = _AT * (len(m) - 1)
    low = place.astype(int)
    ranked = np.sort(m, axis=0)
    quantiles = ranked[low] + (ranked[np.minimum(low + 1, len(m) - 1)] - ranked[low]) * (place - low)[:, None]
    for k in range(len(PARTS)):
        out += [mean[k], sd[k], *quantiles[:, k]]
    shared = [len(a & b) for a, b in zip(bags, bags[1:])]
    carry = sum(k / max(1, len(a) + len(b) - k) for k, a, b in zip(shared, bags, bags[1:])) / len(shared) if shared else 0.0
    every = set().union(*bags)
    out += [float(((m[:, 4] == 0) & (m[:, 0] <= 12)).mean()), float((m[:, 4] >= 2).mean()), len(every) / max(1, sum(map(len, bags))), carry, len(rows), colons / len(rows)]
    seen = max(1.0, sum(marks))
    out += [x / seen for x in marks]
    return total, np.array(out)


class Boosted:
    """Gradient-boosted regression trees of depth `depth` on quantile bins, squared error."""

    def __init__(self, rounds: int = 150, depth: int = 3, rate: float = 0.08, least: int = 5, bins: int = 32) -> None:
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        n, width = b.shape
        flat = b + np.arange(width) * self.bins
        self.base, self.trees = float(y.mean()), []
        now = np.full(n, self.base)
        for _ in range(self.rounds):
            left = y - now
            node = np.zeros(n, dtype=np.int64)
            splits = []
            for level in range(self.depth):
                count = 1 << level
                at = (node[:, None] * (width * self.bins) + flat).ravel()
                size = np.bincount(at, minlength=count * width * self.bins).reshape(count, width, self.bins).cumsum(axis=2)
                total = np.bincount(at, weights=np.repeat(left, width), minlength=count * width * self.bins).reshape(count, width, self.bins).cumsum(axis=2)
                n_all, s_all = size[:, :, -1:], total[:, :, -1:]
                other, rest = n_all - size, s_all - total
                gain = total**2 / np.maximum(size, 1) + rest**2 / np.maximum(other, 1) - s_all**2 / np.maximum(n_all, 1)
                gain[(size < self.least) | (other < self.least)] = 0
                best = gain.reshape(count, -1).argmax(axis=1)
                feature, border = best // self.bins, best % self.bins
                none = gain.reshape(count, -1).max(axis=1) <= 1e-9
                border = np.where(none, self.bins, border)
                splits.append((feature, border))
                node = 2 * node + (b[np.arange(n), feature[node]] > border[node])
            leaves = np.bincount(node, weights=left, minlength=1 << self.depth) / (np.bincount(node, minlength=1 << self.depth) + 1.0)
            self.trees.append((splits, leaves))
            now += self.rate * leaves[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The expected grade of each row of features."""
        b = self._binned(x)
        row, out = np.arange(len(b)), np.full(len(b), self.base)
        for splits, leaves in self.trees:
            node = np.zeros(len(b), dtype=np.int64)
            for feature, border in splits:
                node = 2 * node + (b[row, feature[node]] > border[node])
            out += self.rate * leaves[node]
        return out


def cut_points(score: np.ndarray, grade: np.ndarray, grades: np.ndarray) -> list[float]:
    """Between each two neighbouring grades, the border of the scores that misplaces the fewest rated documents."""
    out = []
    for low, high in zip(grades, grades[1:]):
        tries = np.linspace(low + 0.1, high - 0.1, 33)
        wrong = [((score > t) & (grade <= low)).sum() + ((score <= t) & (grade >= high)).sum() + abs(t - (low + high) / 2) for t in tries]
        out.append(float(tries[int(np.argmin(wrong))]))
    return out


class Levels:
    """A fitted model with its calibration from held-out scores (null where none could be held out)."""

    def __init__(self, rated: pd.DataFrame) -> None:
        x, y, held = np.stack(rated["features"].to_numpy()).astype(float), rated["grade"].to_numpy(dtype=float), rated["held"].to_numpy(dtype=float)
        self.model = Boosted().fit(x, y)
        known = ~np.isnan(held)
        self.grades = np.unique(np.round(y)).astype(int)
        self.borders = cut_points(held[known], y[known], self.grades) if known.sum() >= 20 else [(a + b) / 2 for a, b in zip(self.grades, self.grades[1:])]

    def level(self, score: np.ndarray) -> np.ndarray:
        return self.grades[np.searchsorted(self.borders, score)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The level of each row of features."""
        return self.level(self.model.predict(x))


FOLDS = 4


def _hold_out(group: pd.DataFrame) -> pd.DataFrame:
    """Scores of the documents of one fold by trees that were grown on the others."""
    k = group["k"].iloc[0]
    out, rest = group[group["fold"] == k], group[group["fold"] != k]
    score = np.full(len(out), np.nan)
    if len(out) and len(rest) >= 20:
        of = lambda g: np.stack(g["features"].to_numpy()).astype(float)
        score = Boosted().fit(of(rest), rest["grade"].to_numpy(dtype=float)).predict(of(out))
    return pd.DataFrame({"doc_id": out["doc_id"], "held": score})


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(i, *describe(t)) for i, t in zip(b["doc_id"], b["text"])]
        yield pd.DataFrame([r for r in rows if r[2] is not None], columns=["doc_id", "words", "features"])


def features(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, words, features) for every document with a sentence of prose; the names are in FEATURES."""
    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(_describe, "doc_id long, words int, features array<double>")


def rated_sample(ratings: DataFrame, most_rated: int = 6000) -> DataFrame:
    """Rows (doc_id, grade): the mean grade of at most `most_rated` rated documents."""
    rated = ratings.where(F.col("grade").isNotNull()).groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    return rated.orderBy(F.xxhash64("doc_id")).limit(most_rated)


def rated_rows(described: DataFrame, sources: DataFrame, rated: DataFrame) -> DataFrame:
    """Rows (doc_id, features, grade, source, fold, held) of the rated sample; `sources` has (doc_id, source).

    All documents of a source are in one fold; the folds are fitted by tasks of their own.
    """
    fold = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")
    few = F.broadcast(rated)  # at most `most_rated` rows
    rows = sources.join(few, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "grade", "source", fold)
    rows = cut(described.select("doc_id", "features").join(F.broadcast(rows), "doc_id").dropDuplicates(["doc_id"]))
    each = rows.select("doc_id", "features", "grade", "fold", F.explode(F.array([F.lit(k) for k in range(FOLDS)])).alias("k"))
    held = each.repartition(FOLDS, "k").groupBy("k").applyInPandas(_hold_out, "doc_id long, held double")
    return rows.join(held.hint("merge"), "doc_id")


def fit(described: DataFrame, sources: DataFrame, rated: DataFrame) -> Levels | None:
    """The model from the rated sample; `sources` has (doc_id, source)."""
    rows = rated_rows(described, sources, rated).select("doc_id", "features", "grade", "held").orderBy("doc_id").toPandas()
    return Levels(rows) if len(rows) else None


def agreement(docs: DataFrame, doc_id: str, text: str, source: str, ratings: DataFrame) -> DataFrame:
    """Rows (source, rated, right, share): how many held-out documents of each source of the rated sample get the raters' level.

    A document's score comes from trees that saw no document of its source; the cut points between levels are those of all
    held-out scores. Sources that could not be held out have no row.
    """
    spark = docs.sparkSession
    rated = cut(rated_sample(ratings))
    some = docs.join(F.broadcast(rated.select(F.col("doc_id").alias(doc_id))), doc_id, "left_semi")
    sources = some.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    rows = rated_rows(cut(features(some, doc_id, text)), sources, rated).select("doc_id", "features", "grade", "source", "held").orderBy("doc_id").toPandas()
    out = "source string, rated long, right long, share double"
    if not len(rows):
        return spark.createDataFrame([], out)
    model, known = Levels(rows), rows[rows["held"].notna()]
    right = model.level(known["held"].to_numpy()) == np.round(known["grade"].to_numpy())
    each = spark.createDataFrame(pd.DataFrame({"source": known["source"].astype(object).where(known["source"].notna(), None), "right": right.astype(bool)}), "source string, right boolean")
    return each.groupBy("source").agg(F.count("*").alias("rated"), F.count_if("right").alias("right"), F.avg(F.col("right").cast("double")).alias("share"))


def levels(docs: DataFrame, doc_id: str, text: str, source: str, ratings: DataFrame, least_words: int = 60) -> DataFrame:
    """Rows (doc_id, level) for every document with enough prose. See the module's text."""
    spark = docs.sparkSession
    described = cut(features(docs, doc_id, text))
    sources = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"))
    model = fit(described, sources, cut(rated_sample(ratings)))
    if model is None:
        return spark.createDataFrame([], "doc_id long, level int")
    shared = spark.sparkContext.broadcast(model)

    def score(column: pd.Series) -> pd.Series:
        return pd.Series(shared.value.predict(np.stack(column.to_numpy())).astype(np.int32)) if len(column) else pd.Series([], dtype=np.int32)

    return described.where(F.col("words") >= least_words).select("doc_id", F.pandas_udf(score, "int")("features").alias("level"))
