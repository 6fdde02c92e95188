"""Problem 1: the language of each document and of each stretch of it, with a confidence, by language-bitmask filters.

A Bloom filter is kept bit-sliced: one byte per slot, one bit per language, so that reading a slot answers for all
languages at once. Every character n-gram of a sentence reads its slots and yields a mask of the languages that hold
it; the popcounts per language, less the false positives expected from the filter's fill, decide. N-grams that every
language holds say nothing and are not counted. The filter is built from a bounded sample of rows whose label names a
language (`sample` rows per language at most), in two rounds: the first trusts the labels, the second only those
sentences that the first round reads as labelled, so that wrong labels do not get into the filter.

The share by which a language leads becomes a confidence by calibration: a filter from one half of the sample reads the
other half, and how often it agrees with the labels at a share is the confidence at that share.

Sentences that follow one another in one language are one segment. Code, paths, logs and sentences without evidence
have no language and do not end a segment.

Defined results: a null or empty text, one without prose, and a row without a key have no segments; repeated rows give repeated segments
only where the caller does not drop them; an empty table gives an empty result. Texts are read whole. Further columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.llm.forms import table_form

LANGUAGES = ["en", "es", "fr", "de", "pt"]
# Ways to name the languages (codes of ISO 639, names in English and in the language itself).
NAMES = {
    "en": "en eng english anglais inglés ingles englisch inglês",
    "es": "es spa spanish español espanol castellano",
    "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch",
    "pt": "pt por portuguese português portugues",
}
# Frequent function words, so that sentences are told whose other words the sample does not hold.
FUNCTION_WORDS = {
    "en": "the of and to in that is was for with as his her they have this from not are were which their would there been when will more who what your about could them then some these our into",
    "es": "el la de que y en los se del las por un con no una su para es al lo como más pero sus le ya este muy sin sobre también hasta hay donde desde nos cuando todo mi dónde",
    "fr": "le de et les des en un du une que est pour qui dans par plus pas au sur ne se avec son elle mais nous comme ou leur sont aux cette ses je il ai où mes très",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am ich mein wo unter",
    "pt": "o de a e que do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também pelo onde nós são",
}
_NAMED = {name: lang for lang, names in NAMES.items() for name in names.split()}
NOTHING = {"", "und", "unknown", "xx", "xxx", "zxx", "mul", "n/a", "na", "none", "null", "-", "--", "?", "other", "auto", "default"}
_EDGE = ".,;:!?()[]\"'«»“”…¿¡`*#-_"
N = 4
SEEDED = 20  # how often the function words count in a sample
BREAK = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n+")
NOT_LETTERS = re.compile(r"[^a-zà-öø-ÿœ'\n]+")


def label_language(label: Column) -> Column:
    """The language that a label names; null when it names none of LANGUAGES."""
    head = F.split(F.lower(F.trim(label)), "[-_ ]").getItem(0)
    pairs = [F.lit(x) for kv in _NAMED.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), head)


def label_says_nothing(label: Column) -> Column:
    """Whether a label is missing or tells no language."""
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return text.isin(*NOTHING) | ~text.rlike(r"\p{L}")


class Filter:
    """Bit-sliced Bloom filters of the languages' n-grams."""

    def __init__(self, grams: list[np.ndarray], bits: int = 18) -> None:
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, dtype=np.uint8)
        for i, g in enumerate(grams):
            for slot in self.places(g):
                self.slots[slot] |= 1 << i
        fill = np.array([((self.slots >> i) & 1).mean() for i in range(len(grams))])
        self.false = fill**2
        self.shares, self.truth = np.array([0.5, 1.0]), np.array([0.5, 1.0])

    def calibrate(self, sure: np.ndarray, right: np.ndarray, parts: int = 10) -> None:
        """Learns from held-out sentences how often a lead of a certain share is right; never falling with the share."""
        order = np.argsort(sure, kind="stable")
        bins = [b for b in np.array_split(order, parts) if len(b)]
        if bins:
            self.shares = np.array([sure[b].mean() for b in bins])
            self.truth = np.maximum.accumulate([(right[b].sum() + 0.5) / (len(b) + 1) for b in bins])

    def confidence(self, sure: np.ndarray) -> np.ndarray:
        """How likely the language is the right one, from the share of the lead."""
        return np.interp(sure, self.shares, self.truth)

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two slots of each n-gram."""
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> self.shift, (grams * np.uint64(0xC2B2AE3D27D4EB4F)) >> self.shift

    def counts(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Popcounts per sentence and language, less the expected false positives; -1-grams (0) are no n-grams."""
        a, b = self.places(grams)
        mask = self.slots[a] & self.slots[b]
        every = (1 << len(self.false)) - 1
        told = (grams != 0) & (mask != 0) & (mask != every)
        mask = np.where(told, mask, 0).astype(np.uint8)
        real = np.add.reduceat(told.astype(np.float64), starts)
        out = np.stack([np.add.reduceat(((mask >> i) & 1).astype(np.float64), starts) for i in range(len(self.false))], axis=1)
        return np.maximum(0, (out - self.false * real[:, None]) / (1 - self.false))


def split(text: str) -> list[tuple[str, int]]:
    """Sentences of a text with the number of their words of prose; lines of code and logs have none."""
    out = []
    for piece in BREAK.split(table_form(text)):
        if piece and (tokens := piece.split()):
            prose = sum(map(str.isalpha, tokens))
            if prose < len(tokens):
                prose += sum(t.strip(_EDGE).replace("'", "").replace("-", "").isalpha() for t in tokens if not t.isalpha())
            out.append((piece, prose if 2 * prose > len(tokens) else 0))
    return out


def grams_of(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words (0 where none begins) and where each sentence starts."""
    text = NOT_LETTERS.sub(" ", "\n".join(f" {s} " for s in sentences).lower().replace("’", "'")) + "\n" * N
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 10)
    n = len(codes) - N + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(N):
        h = h * np.uint64(0x100000001B3) + codes[k : k + n]
    bad = np.zeros(len(codes) + 1, dtype=np.int32)
    np.cumsum(codes == 10, out=bad[1:])
    h[bad[N : N + n] - bad[:n] > 0] = 0
    starts = np.concatenate([[0], ends[: len(sentences) - 1] + 1]).astype(np.int64)
    return h, np.minimum(starts, n - 1)


def decide(counts: np.ndarray, least: float, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """(language number or -1, confidence) for each row of corrected counts.

    A language needs `least` n-grams and must lead the next one by `spread` standard deviations of their difference.
    """
    order = np.argsort(counts, axis=1)
    best, second = (np.take_along_axis(counts, order[:, -k : (-k + 1) or None], axis=1)[:, 0] for k in (1, 2))
    both = best + second
    return np.where((best >= least) & (best - second >= spread * np.sqrt(both)), order[:, -1], -1), best / np.maximum(both, 1e-9)


def _tables(labels: np.ndarray, grams: np.ndarray, starts: np.ndarray, ratio: float) -> list[np.ndarray]:
    """The n-grams of each language: at least `ratio` of the largest relative frequency that any language has."""
    owner = np.repeat(labels, np.diff(np.append(starts, len(grams))))
    kinds, inverse = np.unique(grams, return_inverse=True)
    freq = np.stack([np.bincount(inverse[owner == i], minlength=len(kinds)) for i in range(len(LANGUAGES))], axis=1).astype(float)
    share = freq / np.maximum(freq.sum(axis=0), 1)
    top = share.max(axis=1)
    return [kinds[(kinds != 0) & (freq[:, i] >= 2) & (share[:, i] >= ratio * top)] for i in range(len(LANGUAGES))]


def train(rows: pd.DataFrame) -> Filter:
    """The filter from labelled texts (lang, text)."""
    pieces, labels = [], []
    for lang, text in zip(rows["lang"], rows["text"]):
        for piece, prose in split(text):
            if prose >= 3:
                pieces.append(piece)
                labels.append(LANGUAGES.index(lang))
    if not pieces:
        return Filter([np.zeros(0, dtype=np.uint64)] * len(LANGUAGES))
    model = _grown(pieces, labels)
    if len(pieces) >= 200:
        half = np.arange(len(pieces)) % 2 == 0
        grams, starts = grams_of([p for p, h in zip(pieces, half) if not h])
        got, sure = decide(_grown([p for p, h in zip(pieces, half) if h], [k for k, h in zip(labels, half) if h]).counts(grams, starts), 4, 1.2)
        model.calibrate(sure[got >= 0], got[got >= 0] == np.array(labels)[~half][got >= 0])
    return model


def _grown(pieces: list[str], labels: list[int]) -> Filter:
    """The filter from sentences and the numbers of their languages, wrong ones among them."""
    pieces, labels = list(pieces), list(labels)
    for lang, known in FUNCTION_WORDS.items():
        pieces += [known] * SEEDED
        labels += [LANGUAGES.index(lang)] * SEEDED
    grams, starts = grams_of(pieces)
    labels = np.array(labels)
    first = Filter(_tables(labels, grams, starts, 0.5))
    got, _ = decide(first.counts(grams, starts), 3, 1.0)
    for _ in range(2):
        again = Filter(_tables(np.where(got == labels, labels, -1), grams, starts, 0.25))
        got, _ = decide(again.counts(grams, starts), 3, 1.0)
    return again


def sample(df: DataFrame, key: str, text: str, lang: Column, rows: int, most_chars: int = 20_000) -> pd.DataFrame:
    """About `rows` rows per language, chosen by a hash of the key, as the bounded sample that the filter is built from.

    Texts of more than `most_chars` characters are not drawn, so that the sample has a bound in bytes too.
    """
    known = df.where(F.char_length(text) <= most_chars).select(F.col(key).alias("key"), F.col(text).alias("text"), lang.alias("lang")).where(F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "text": []})
    limit = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, int(1e6 * rows / n)))])
    return known.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < limit[F.col("lang")]).select("lang", "text").toPandas()


SEGMENTS = "key string, seg_no int, lang string, confidence double, words int, sentences int, prose int"


def _segment(model, least: float, spread: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Filter = model.value
        for b in batches:
            pieces, prose, owner = [], [], []
            for i, text in enumerate(b["text"]):
                for piece, n in split(text):
                    pieces.append(piece)
                    prose.append(n)
                    owner.append(i)
            out = []
            if pieces:
                grams, starts = grams_of(pieces)
                counts = known.counts(grams, starts)
                counts[np.array(prose) == 0] = 0
                lang, sure = decide(counts, least, spread)
                sure = known.confidence(sure)
                total: dict[int, int] = {}
                for i, n in zip(owner, prose):
                    total[i] = total.get(i, 0) + n
                at, seg = -1, None
                for i, n, k, c in zip(owner, prose, lang.tolist(), sure.tolist()):
                    if i != at:
                        at, seg = i, None
                    if k < 0:
                        continue
                    if seg is None or seg[1] != k:
                        seg = [i, k, 0.0, 0, 0, (seg[5] + 1) if seg else 1]
                        out.append(seg)
                    seg[2] += c * n
                    seg[3] += n
                    seg[4] += 1
            keys = b["key"].to_numpy()
            yield pd.DataFrame(
                {
                    "key": [keys[s[0]] for s in out],
                    "seg_no": np.array([s[5] for s in out], dtype=np.int32),
                    "lang": [LANGUAGES[s[1]] for s in out],
                    "confidence": [s[2] / max(1, s[3]) for s in out],
                    "words": np.array([s[3] for s in out], dtype=np.int32),
                    "sentences": np.array([s[4] for s in out], dtype=np.int32),
                    "prose": np.array([total[s[0]] for s in out], dtype=np.int32),
                }
            )

    return run


def segments(df: DataFrame, key: str, text: str, model: Filter, least: float = 4, spread: float = 1.2) -> DataFrame:
    """Rows (key, seg_no, lang, confidence, words, sentences, prose): the segments of every text in reading order."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(_segment(shared, least, spread), SEGMENTS)


def label_cases(df: DataFrame, key: str, text: str, label: str, sample_rows: int = 1500, least_words: int = 6) -> DataFrame:
    """Segments (key, seg_no, lang, confidence) of the texts whose label is missing or wrong, or that mix languages."""
    model = train(sample(df, key, text, label_language(F.col(label)), sample_rows))
    code = F.when(label_says_nothing(F.col(label)), "").otherwise(F.coalesce(label_language(F.col(label)), F.lit("??")))
    tagged = df.where(F.col(key).isNotNull()).select(F.concat_ws("\t", F.col(key), code).alias("key"), text)
    found = segments(tagged, "key", text, model)
    found = found.where(F.col("prose") >= least_words).withColumn("label", F.element_at(F.split("key", "\t"), -1)).withColumn("key", F.regexp_replace("key", "\t[^\t]*$", ""))
    # One shuffle by key: a text in one language under its own label is no case.
    each = found.groupBy("key").agg(F.collect_set(F.struct("seg_no", "lang", "confidence")).alias("segs"), F.first("label").alias("label"))
    wrong = (F.size(F.array_distinct("segs.lang")) > 1) | (F.get("segs.lang", F.lit(0)) != F.col("label"))
    return each.where(wrong).select("key", F.inline("segs"))
