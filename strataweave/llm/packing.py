"""Problem 7: documents packed into containers of a token capacity by minimum bin slack.

Items of one length are interchangeable, so the packing is solved on the histogram of lengths, which has at most as
many rows as the capacity, whatever the number of documents. For each capacity one task repeats: seed a container
with the longest length left, find by a bitset subset-sum dynamic programme over the lengths left the fullest feasible
combination, and use that pattern for as many containers as the counts allow. Every pattern uses up a length, so
there are few patterns. The documents are then dealt to the patterns' places by their rank within their length, which
is counted in two levels (within parts of a length, as many as its count asks for, then by the parts' offsets), so that
no length is gathered in one task.

A document longer than the capacity is divided: as many full containers as it fills, and its rest as one more item.

Defined results: null texts and rows without an id are left out; a text without tokens needs no room and stands in container 0; capacities
that are null or below one are left out; a repeated id is packed as often as it stands; empty tables give an empty
result. Texts are read whole. A long text is handed to the tokenizer in slices, cut only at single blanks between two
visible characters: a token of PATTERN can begin there, but none can reach across, so the counts are the same; other
patterns get whole texts. Further columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this public byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SLICE = 200_000
_BORDER = re.compile(r"(?<=\S) (?=\S)")
BROADCAST_ROWS = 1_000_000
_ENCODERS: dict[tuple[str, str], object] = {}


def encoder(path: str, pattern: str):
    """The tokenizer at `path`, loaded once per worker process."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def _slices(text: str, pattern: str) -> Iterator[str]:
    at = 0
    while pattern == PATTERN and len(text) - at > SLICE and (border := _BORDER.search(text, at + SLICE)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


def token_counts(docs: DataFrame, doc_id: str, text: str, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Rows (doc_id, tokens), by the tokenizer whose file the driver has at `path`; the file is handed to all executors."""
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(SparkFiles.get(name), pattern)
        return pd.Series([sum(len(enc.encode_ordinary(s)) for s in _slices(t, pattern)) for t in texts], dtype=np.int64)

    rows = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    return rows.select(F.col(doc_id).alias("doc_id"), F.pandas_udf(count, "long")(F.col(text)).alias("tokens"))


def fullest(room: int, lengths: list[int], left: list[int]) -> dict[int, int]:
    """How many of each length fill `room` best: a bitset of reachable sums, read back from the best one."""
    reach, steps, goal = 1, [], 1 << room
    every = (goal << 1) - 1
    for length, count in zip(lengths, left):
        if length > room or not count:
            continue
        many, k = min(count, room // length), 1
        while many > 0:
            k = min(k, many)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & every
            many, k = many - k, 2 * k
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return used


def patterns(capacity: int, counts: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """(lengths in one container, number of such containers) until all items are placed."""
    lengths = sorted((x for x, n in counts.items() if n > 0 and x > 0), reverse=True)
    left = [counts[x] for x in lengths]
    where = {x: i for i, x in enumerate(lengths)}
    out, first = [], 0
    while True:
        while first < len(lengths) and not left[first]:
            first += 1
        if first == len(lengths):
            return out
        left[first] -= 1
        use = fullest(capacity - lengths[first], lengths[first:], left[first:])
        left[first] += 1
        use[lengths[first]] = use.get(lengths[first], 0) + 1
        times = min(left[where[x]] // n for x, n in use.items())
        for x, n in use.items():
            left[where[x]] -= n * times
        out.append((use, times))


PLACES = "budget_id int, length int, from_rank long, to_rank long, per_bin int, first_bin long"


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    capacity = int(group["capacity"].iloc[0])
    rank: dict[int, int] = {}
    rows, next_bin = [], 1
    for use, times in patterns(capacity, dict(zip(group["length"].tolist(), group["n"].tolist()))):
        for length, n in use.items():
            low = rank.get(length, 0)
            rank[length] = low + n * times
            rows.append((int(group["budget_id"].iloc[0]), length, low, rank[length], n, next_bin))
        next_bin += times
    return pd.DataFrame(rows, columns=["budget_id", "length", "from_rank", "to_rank", "per_bin", "first_bin"])


def _bounded(table: DataFrame) -> DataFrame:
    """The table to be broadcast if it is counted to be small, else to be joined by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def pack(sizes: DataFrame, budgets: DataFrame, per_part: int = 100_000) -> DataFrame:
    """Rows (budget_id, bin_no, doc_id, part_no, tokens): every document, or part of one, in its container.

    sizes: (doc_id, tokens); budgets: (budget_id, capacity), a stated small list; its capacities bound how many lengths and
    patterns there are, and these tables are counted before they are broadcast.
    """
    sizes = cut(sizes)
    caps = budgets.where("capacity >= 1").select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity").cast("int").alias("capacity")).distinct()
    parts = F.array(
        F.when(F.col("tokens") >= F.col("capacity"), F.struct(F.lit(True).alias("full"), F.floor(F.col("tokens") / F.col("capacity")).cast("int").alias("many"), F.col("capacity").alias("length"))),
        F.when((F.col("tokens") % F.col("capacity") > 0) | (F.col("tokens") == 0), F.struct(F.lit(False).alias("full"), F.lit(1).alias("many"), (F.col("tokens") % F.col("capacity")).cast("int").alias("length"))),
    )
    # every document is an item of every budget: the budgets are a stated, bounded list
    named = F.broadcast(caps.agg(F.collect_list(F.struct("budget_id", "capacity")).alias("caps")))
    items = sizes.withColumn("_one", F.lit(1)).join(named.withColumn("_one", F.lit(1)), "_one").select("doc_id", "tokens", F.inline("caps"))
    items = items.select("budget_id", "capacity", "doc_id", "tokens", F.inline(F.filter(parts, lambda p: p.isNotNull())))
    items = items.select("budget_id", "capacity", "doc_id", "length", F.explode(F.sequence(F.lit(1), F.col("many"))).alias("k"), "full", F.floor(F.col("tokens") / F.col("capacity")).cast("int").alias("before"))
    items = items.withColumn("part_no", F.when(F.col("full"), F.col("k")).otherwise(F.col("before") + 1)).drop("k", "full", "before")

    some = items.where("length > 0")
    counts = cut(some.groupBy("budget_id", "capacity", "length").agg(F.count("*").alias("n")))
    places = cut(counts.groupBy("budget_id").applyInPandas(_solve, PLACES))

    parts_of = counts.select("budget_id", "length", F.ceil(F.col("n") / per_part).alias("many"))
    salted = some.join(_bounded(parts_of), ["budget_id", "length"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part_no"), F.col("many")))
    key = ["budget_id", "length", "salt"]
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "part_no")) - 1)
    offsets = salted.groupBy(*key).agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("budget_id", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = offsets.select(*key, F.coalesce(before, F.lit(0)).alias("o"))
    placed = ranked.join(offsets, key).withColumn("rank", F.col("r") + F.col("o"))
    # A range join within each length: the pattern whose places take the rank in.
    placed = placed.join(_bounded(places), ["budget_id", "length"]).where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    bin_no = F.col("first_bin") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("per_bin"))
    placed = placed.select("budget_id", bin_no.alias("bin_no"), "doc_id", "part_no", F.col("length").alias("tokens"))
    empty = items.where("length = 0").select("budget_id", F.lit(0).cast("long").alias("bin_no"), "doc_id", "part_no", F.col("length").alias("tokens"))
    return placed.unionByName(empty)


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows (budget_id, capacity, bins, tokens, least_bins, fill): how full the containers are and how few could do."""
    used = packed.where("bin_no > 0").groupBy("budget_id").agg(F.max("bin_no").alias("bins"), F.sum("tokens").alias("tokens"))
    out = used.join(F.broadcast(budgets.select(F.col("budget_id").cast("int").alias("budget_id"), F.col("capacity").cast("int").alias("capacity"))), "budget_id")
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return out.select("budget_id", "capacity", "bins", "tokens", least.alias("least_bins"), (F.col("tokens") / (F.col("bins") * F.col("capacity"))).alias("fill"))
