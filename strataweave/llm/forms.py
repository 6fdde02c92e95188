"""Problem 5: one consistent form for text that looks the same but is stored with different characters.

Two parts. `table_form` maps one text by character rules. `canonical` is the operator: the words of the whole table
make one vocabulary trie, cut below its first letters into parts that are spread over buckets; every word with unusual
characters walks the part it begins in with a weighted edit automaton in which look-alikes and ignorable characters
cost nothing, and takes the spelling it ends at: the cheapest, Latin before other scripts, then the most frequent, then
the smallest. A word of another script that stands in the vocabulary as such keeps its letters where the table would
make Latin ones of them. Only words that match nothing, and what stands between words, go by the table. Letter case,
words and visible accents are kept at the usual budget of 0; a larger one lets words take a spelling that differs behind
its first letters.

Defined results: a null text has a null form, an empty text an empty one; repeated rows are kept; an empty table gives
an empty result; very long texts are read whole. Further columns of the input are kept as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.session import kept

# Letters of other alphabets drawn like a Latin letter (pairs "other letter, Latin letter").
SAME_SHAPE = dict(
    pair
    for pair in (
        "аa еe оo сc рp уy хx іi јj ѕs һh ԁd ԛq ԝw АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЈJ ЅS ҮY ԌG ԚQ ԜW "  # Cyrillic
        "οo νv αa ιi ρp υu ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "  # Greek
        "օo ոn սu ցg հh ՕO ՍU ՏS "  # Armenian
        "ɑa ɡg ıi ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
    ).split()
)
HYPHENS = "‐‑‒–−﹘﹣－⁃"
PLAIN_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")

FIRST_LETTERS = 4
BROADCAST_WORDS = 200_000

# A text without any of these is its own form. Java and Python read the pattern alike.
ODD_CLASS = r"[^\x00-ž]|[\xa0\xadĲĳĿŀŉ]"
_ODD = re.compile(ODD_CLASS)
LATIN_WORD = r"[A-Za-zªºÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž]+"
_LATIN = re.compile(LATIN_WORD)
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{Cf}]*")


class _Table(dict):
    """Character to its plain form, by rule, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        tag = unicodedata.decomposition(ch).partition(" ")[0]
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or code in (0x034F, 0x115F, 0x1160, 0x3164, 0x17B4, 0x17B5):
            out = ""
        elif kind == "Zs":
            out = " "
        elif ch in HYPHENS:
            out = "-"
        elif ch in SAME_SHAPE:
            out = SAME_SHAPE[ch]
        elif tag in PLAIN_TAGS or (tag == "<compat>" and kind[0] in "LNP"):  # ligatures, joined digits and dots
            out = "".join(x if x == ch else self[ord(x)] for x in unicodedata.normalize("NFKD", ch))
        else:
            out = ch
        self[code] = out
        return out


_TABLE = _Table()


def table_form(text: str) -> str:
    """The text by the table alone: equal for any two texts that look the same."""
    if text.isascii() or not _ODD.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))


class Trie:
    """Spellings by their decomposed characters; a walk allows look-alikes and ignorables at no cost."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for ch in unicodedata.normalize("NFD", word):
            node = node.setdefault(ch, {})
        node[""] = (word, count)

    def walk(self, word: str, budget: float = 0) -> list[tuple[float, str, int]]:
        """(cost, spelling, count) of the spellings within `budget`: look-alikes and ignorables cost nothing, another case or
        an accent more or less half a point, another, missing or further letter one point."""
        states = _skips({id(self.root): (self.root, 0)}, budget)
        for folded in unicodedata.normalize("NFD", word).translate(_TABLE):
            after: dict[int, tuple[dict, float]] = {}
            for node, cost in states.values():
                steps = [(child, cost + _swap(ch.translate(_TABLE), folded)) for ch, child in node.items() if ch]
                if budget:
                    steps.append((node, cost + _weight(folded)))
                for child, total in steps:
                    if total <= budget and total < after.get(id(child), (None, budget + 1))[1]:
                        after[id(child)] = (child, total)
            states = _skips(after, budget)
        return [(cost, *node[""]) for node, cost in states.values() if "" in node]


def _weight(ch: str) -> float:
    """Cost of a character that one of two spellings lacks."""
    return 0.5 if unicodedata.combining(ch[:1] or "x") else 1 if ch else 0


def _swap(a: str, b: str) -> float:
    return 0 if a == b else 0.5 if a.lower() == b.lower() or (unicodedata.combining(a[:1] or "x") and unicodedata.combining(b)) else 1


def _skips(states: dict[int, tuple[dict, float]], budget: float) -> dict[int, tuple[dict, float]]:
    """The states with those that are reached by characters of the trie alone."""
    open_ = list(states.values()) if budget else []
    while open_:
        node, cost = open_.pop()
        for ch, child in node.items():
            if ch and (total := cost + _weight(ch.translate(_TABLE))) <= budget and total < states.get(id(child), (None, budget + 1))[1]:
                states[id(child)] = (child, total)
                open_.append((child, total))
    return states


def choose(found: list[tuple[int, str, int]]) -> str | None:
    """Lowest cost, Latin first, then the most frequent, then the smallest spelling."""
    return min(found, key=lambda x: (x[0], not _LATIN.fullmatch(x[1]), -x[2], x[1]))[1] if found else None


def is_odd(text: Column) -> Column:
    """Whether a text has unusual characters; one of ASCII letters only is told by its length in bytes."""
    return (F.octet_length(text) != F.char_length(text)) & text.rlike(ODD_CLASS)


def _odd_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for row, text in zip(b["_row"], b["_text"]):
            for word in {w for w in _WORD.findall(text)}:
                odd = not _LATIN.fullmatch(word)
                if not odd:
                    continue
                look = table_form(word)
                own = (unicodedata.normalize("NFC", word) == word and not any(_TABLE[ord(c)] == "" for c in word) and _one_script(word))
                rows.append((row, word, look, own))
        yield pd.DataFrame(rows, columns=["_row", "word", "look", "own"])


def _one_script(word: str) -> bool:
    return len({unicodedata.name(c, "?").split()[0] for c in word if c.isalpha()}) == 1 and not any(unicodedata.decomposition(c).startswith("<") for c in word)


def _match(budget: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket, spellings before the words that look for one."""
        at, trie = None, Trie()
        for b in batches:
            out = []
            for bucket, word, look, odd, own, count in zip(b["bucket"], b["word"], b["look"], b["odd"], b["own"], b["count"]):
                if bucket != at:
                    at, trie = bucket, Trie()
                if own:
                    trie.add(word, count)
                if odd:
                    out.append((word, choose(trie.walk(word, budget)) or look))
            yield pd.DataFrame(out, columns=["word", "form"])

    return run


def vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """Latin words of the texts and in how many places each stands, over all rows."""
    word = F.explode(F.regexp_extract_all(F.col(column), F.lit(LATIN_WORD), F.lit(0))).alias("word")
    return texts.select(word).groupBy("word").agg(F.count("*").alias("count"))


def _rebuild(text: pd.Series, words: pd.Series, forms: pd.Series) -> pd.Series:
    out = []
    for t, w, f in zip(text, words, forms):
        known = dict(zip(w, f)) if w is not None else {}
        parts, at = [], 0
        for m in _WORD.finditer(t):
            parts += [table_form(t[at : m.start()]), known.get(m[0]) or table_form(m[0])]
            at = m.end()
        out.append("".join(parts) + table_form(t[at:]))
    return pd.Series(out, dtype=object)


def canonical(df: DataFrame, key: list[str], text: str, out: str = "form", buckets: int = 4096, budget: float = 0) -> DataFrame:
    """df with the column `out`: the text in its canonical form. `key` names the columns that tell the rows apart."""
    rebuild = F.pandas_udf(_rebuild, "string")
    base = df.where(F.col(text).isNotNull())
    odd_text = is_odd(F.col(text))
    row = F.struct(*key) if len(key) > 1 else F.col(key[0])
    odd_rows = base.where(odd_text).select(row.alias("_row"), F.col(text).alias("_text"))
    row_type = odd_rows.schema["_row"].dataType.simpleString()
    words = odd_rows.select(F.to_json(F.struct("_row")).alias("_row"), "_text").mapInPandas(_odd_words, "_row string, word string, look string, own boolean")
    words = kept(words)
    odd = words.groupBy("word", "look", "own").agg(F.count("*").alias("count"))
    # Only spellings that share their first letters with some unusual word can be met on a walk; the rest stays out of the tries.
    bucket = F.pmod(F.xxhash64(F.substring("look", 1, FIRST_LETTERS)), F.lit(buckets)).alias("bucket")
    latin = vocabulary(base, text)
    wanted = odd.select(bucket).distinct()
    latin = latin.select("word", F.col("word").alias("look"), F.lit(False).alias("odd"), F.lit(True).alias("own"), "count").withColumn("bucket", bucket).join(F.broadcast(wanted), "bucket", "left_semi")  # no more rows than buckets
    odd = odd.select("word", "look", F.lit(True).alias("odd"), "own", "count").withColumn("bucket", bucket)
    seekers = odd.withColumn("own", F.lit(False))
    spellings = odd.where("own").withColumn("odd", F.lit(False))
    cols = ["bucket", "word", "look", "odd", "own", "count"]
    entries = latin.select(*cols).unionByName(spellings.select(*cols)).unionByName(seekers.select(*cols))
    mapping = kept(entries.repartition("bucket").sortWithinPartitions("bucket", "odd").mapInPandas(_match(budget), "word string, form string"))
    # A word that stands in very many texts is no problem while the mapping is small enough to go to every task.
    mapping = F.broadcast(mapping) if mapping.count() <= BROADCAST_WORDS else mapping.hint("merge")
    found = words.select("_row", "word").join(mapping, "word").groupBy("_row").agg(F.collect_list("word").alias("_words"), F.collect_list("form").alias("_forms"))
    found = found.select(F.from_json("_row", f"_row {row_type}").getField("_row").alias("_row"), "_words", "_forms")
    plain = df.where(F.col(text).isNull() | ~odd_text).withColumn(out, F.col(text))
    changed = base.where(odd_text).withColumn("_row", row).join(found.hint("merge"), "_row", "left").withColumn(out, rebuild(F.col(text), F.col("_words"), F.col("_forms")))
    return plain.unionByName(changed.drop("_row", "_words", "_forms"))


def alike(df: DataFrame, within: list[str], id_: str, text: str) -> DataFrame:
    """Pairs (within, id_a, id_b) of rows that agree in `within` and look the same but are not the same characters.

    Equal texts are gathered first, so that a group of copies costs one variant: variants are paired, then members.
    """
    texts = df.where(F.col(text).isNotNull() & F.col(id_).isNotNull()).select(*within, id_, text)
    forms = canonical(texts, [*within, id_], text, "_form")
    # 128 bits of hash stand for a form and for a text
    two = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), c))
    hashes = [h.alias(n) for n, h in zip(("class", "form", "raw", "text"), (*two(F.col("_form")), *two(F.col(text))))]
    rows = forms.select(*within, F.col(id_).alias("id"), *hashes, is_odd(F.col(text)).alias("odd"))
    rows = kept(rows.dropDuplicates([*within, "id"]))
    classes = rows.where("odd").select(*within, "class").distinct()
    rows = kept(rows.join(classes, [*within, "class"], "left_semi").drop("odd"))
    variants = rows.groupBy(*within, "class", "form", "raw", "text").agg(F.count("*").alias("n"))
    on = [*within, "class", "form"]
    other = variants.select(*on, F.col("raw").alias("raw_b"), F.col("text").alias("text_b"))
    pairs = variants.join(other.hint("merge"), on).where(F.struct("raw", "text") < F.struct("raw_b", "text_b")).drop("n")
    a = rows.select(*on, "raw", "text", F.col("id").alias("id_1"))
    b = rows.select(*on, F.col("raw").alias("raw_b"), F.col("text").alias("text_b"), F.col("id").alias("id_2"))
    both = pairs.select(*on, "raw", "text", "raw_b", "text_b").join(a.hint("merge"), [*on, "raw", "text"]).join(b.hint("merge"), [*on, "raw_b", "text_b"])
    return both.select(*within, F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"))


def classes(df: DataFrame, within: list[str], id_: str, text: str) -> DataFrame:
    """Rows (within, id, class_id, members): the class of every row that looks like others, named by its smallest id, and its size."""
    texts = df.where(F.col(text).isNotNull() & F.col(id_).isNotNull()).select(*within, F.col(id_).alias("id"), text)
    rows = kept(canonical(texts, [*within, "id"], text, "_form").select(*within, "id", F.xxhash64("_form").alias("h1"), F.xxhash64(F.lit(1), "_form").alias("h2")).dropDuplicates([*within, "id"]))
    sizes = rows.groupBy(*within, "h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("members")).where(F.col("members") > 1)
    return rows.join(sizes.hint("merge"), [*within, "h1", "h2"]).select(*within, "id", "class_id", "members")
