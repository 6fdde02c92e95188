"""Problem 8: passages of held-out test items inside a corpus, by a distributed positional inverted index.

The index is built once and stored in the shared folder: documents are cut into shards of about `SHARD` words, and every
shard has a row for each of its terms with the sorted places where the term stands. So no posting is shuffled to build
it, and no list is longer than a shard. How often each term stands in the corpus is an aggregation over the lists.

A test item is read as overlapping phrases of four words. In every shard a phrase starts from the list of the term that
is the rarest in the whole corpus; that list, moved by the term's offset, is intersected with the lists of the other
three, the next rarest first, by binary search. Phrase matches of one document and item that lie near one diagonal are
then aligned word by word (proximity match), on the places that the lists of the item's terms give, and a passage counts
when at least `least_words` successive item words are reproduced with at most one word in `per_edit` changed, dropped or
added. Any such passage holds several unbroken phrases of four words, so the phrases lose none.

Items are a stated query set: they are taken in blocks of at most `block` words, each a broadcast of bounded size, and
every block reads the lists of its own terms from the stored index.

Defined results: null and empty texts match nothing, nor do rows without an id; items shorter than `least_words` words cannot leak; a document
that is stored twice under two ids is two cases; repeated rows of one id are reported once per row; empty tables give
an empty result. Documents are read whole. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.neardup import _form, _pieces, word_hashes
from strataweave.session import kept

PHRASE = 4
SHARD = 1 << 20
POSTINGS = "shard long, term long, n int, places array<int>, docs array<bigint>"


def words(text: str | None) -> list[int]:
    """Words of a text as they are compared, as numbers: in one character form, lower case, without punctuation and quoting."""
    return word_hashes([_form(text)])[0].view(np.int64).tolist() if text else []


class Probes:
    """The phrases of a block of test items, as term numbers; `often` tells how often terms stand in the corpus."""

    def __init__(self, items: list[tuple[int, list[Hashable]]], often: dict[Hashable, int] | None = None) -> None:
        self.ids = [i for i, _ in items]
        self.terms: dict[Hashable, int] = {}
        self.items = [[self.terms.setdefault(w, len(self.terms)) for w in ws] for _, ws in items]
        at = [(tuple(ws[q : q + PHRASE]), k, q) for k, ws in enumerate(self.items) for q in range(len(ws) - PHRASE + 1)]
        at.sort()
        phrases = np.array([p for p, _, _ in at], dtype=np.int64).reshape(-1, PHRASE)
        self.item = np.array([k for _, k, _ in at], dtype=np.int32)
        self.place = np.array([q for _, _, q in at], dtype=np.int32)
        new = np.ones(len(at), dtype=bool)
        new[1:] = (phrases[1:] != phrases[:-1]).any(axis=1)
        self.first = np.flatnonzero(new)  # each distinct phrase is probed once
        self.times = np.diff(np.append(self.first, len(at)))
        self.phrases = phrases[self.first]
        counts = np.array([(often or {}).get(t, 0) for t in self.terms], dtype=np.int64)
        self.order = np.argsort(counts[self.phrases], axis=1, kind="stable") if len(counts) else self.phrases  # offsets of a phrase's terms, the rarest first


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] times, for all i."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts - starts, counts)


class ShardIndex:
    """The lists of one shard for the terms of the probes: pairs (term, place) in order, and where its documents start."""

    def __init__(self, term: np.ndarray, place: np.ndarray, start: np.ndarray) -> None:
        self.lists = np.sort((term.astype(np.int64) << 32) | place)
        self.start = start
        by_place = np.argsort(place)
        self.place, self.term = place[by_place], term[by_place]

    @classmethod
    def of_documents(cls, docs: list[list[Hashable]], terms: dict[Hashable, int]) -> ShardIndex:
        start = np.cumsum([0] + [len(d) + PHRASE for d in docs])
        at = [(terms[w], start[d] + j) for d, ws in enumerate(docs) for j, w in enumerate(ws) if w in terms]
        return cls(np.array([t for t, _ in at], dtype=np.int64), np.array([p for _, p in at], dtype=np.int64), start)

    def phrase_hits(self, probes: Probes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the shard, item number, place in the item) of every phrase match."""
        which = np.arange(len(probes.phrases))
        if not len(which) or not len(self.lists):
            return (np.zeros(0, np.int64),) * 3
        offset = probes.order[:, 0]
        term = probes.phrases[which, offset]
        begin, end = np.searchsorted(self.lists, term << 32), np.searchsorted(self.lists, (term + 1) << 32)
        owner = np.repeat(which, end - begin)
        p = (self.lists[_spread(begin, end - begin)] & 0xFFFFFFFF) - offset[owner]
        p, owner = p[p >= 0], owner[p >= 0]
        for k in range(1, PHRASE):
            offset = probes.order[owner, k]
            sought = (probes.phrases[owner, offset] << 32) | (p + offset)
            same = self.lists[np.minimum(np.searchsorted(self.lists, sought), len(self.lists) - 1)] == sought
            p, owner = p[same], owner[same]
        times = probes.times[owner]
        slot = _spread(probes.first[owner], times)
        return np.repeat(p, times), probes.item[slot], probes.place[slot]

    def window(self, low: int, high: int) -> list[int]:
        """The terms at the places from low up to high; -1 where another word stands."""
        out = np.full(max(0, high - low), -1, dtype=np.int64)
        a, b = np.searchsorted(self.place, [low, high])
        out[self.place[a:b] - low] = self.term[a:b]
        return out.tolist()


def reproduces(item: list[int], window: list[int], least_words: int, per_edit: int) -> bool:
    """Whether the window holds `least_words` successive item words in order with one edit per `per_edit` words at most."""
    blocks = [b for b in SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks() if b.size]
    for i, first in enumerate(blocks):
        edits = 0
        for j in range(i, len(blocks)):
            if j > i:
                edits += max(blocks[j].a - blocks[j - 1].a - blocks[j - 1].size, blocks[j].b - blocks[j - 1].b - blocks[j - 1].size)
            span = blocks[j].a + blocks[j].size - first.a
            if span >= least_words and edits * per_edit <= span:
                return True
    return False


def _search(probes, least_words: int, per_edit: int, near: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        known: Probes = probes.value
        head = shard["n"].to_numpy() == 0
        ids, start = shard["docs"][head].iloc[0], shard["places"][head].iloc[0].astype(np.int64)
        lists = shard[~head]
        number = np.fromiter((known.terms[t] for t in lists["term"]), np.int64, len(lists))
        index = ShardIndex(np.repeat(number, lists["n"].to_numpy()), np.concatenate([np.zeros(0, np.int64), *lists["places"]]).astype(np.int64), start)
        p, item, q = index.phrase_hits(known)
        doc = np.searchsorted(index.start, p, side="right") - 1
        order = np.lexsort((p, p - q, item, doc))
        p, item, q, doc = p[order], item[order], q[order], doc[order]
        # clusters of phrase matches of one (document, item) whose diagonals follow each other closely
        new = np.ones(len(p), dtype=bool)
        diagonal = p - q
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > near)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(p)))
        out = set()
        for c, n in zip(begin[size >= PHRASE], size[size >= PHRASE]):
            d, k = int(doc[c]), int(item[c])
            if (d, k) in out:
                continue
            at = p[c : c + n]
            low = max(int((at - q[c : c + n]).min()) - near, int(index.start[d]))
            high = min(int((at - q[c : c + n]).max()) + len(known.items[k]) + near, int(index.start[d + 1]))
            if reproduces(known.items[k], index.window(low, high), least_words, per_edit):
                out.add((d, k))
        return pd.DataFrame({"doc_id": [ids[d] for d, _ in out], "item_id": [known.ids[k] for _, k in out]}, dtype="int64")

    return run


def _shards(most: int):
    """Rows (POSTINGS) of rows (doc, text): one for each term of a shard, and one with n = 0 for its documents and where they start."""

    def write(shard: int, docs: list, hashes: list, counts: list) -> Iterator[pd.DataFrame]:
        term, count = np.concatenate(hashes).view(np.int64), np.concatenate(counts)
        start = np.concatenate([[0], np.cumsum(count + PHRASE)]).astype(np.int32)
        yield pd.DataFrame({"shard": [shard], "term": [0], "n": [0], "places": [start], "docs": [np.array(docs, dtype=np.int64)]})
        if len(term):
            place = (np.arange(len(term)) + np.repeat(np.arange(len(count)) * PHRASE, count)).astype(np.int32)
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            begin = np.flatnonzero(np.diff(term, prepend=term[0] - 1))
            yield pd.DataFrame({"shard": shard, "term": term[begin], "n": np.diff(np.append(begin, len(term))), "places": np.split(place, begin[1:]), "docs": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = TaskContext.get().partitionId() << 32
        docs, hashes, counts = [], [], []
        for b in batches:
            forms, ids = [_form(t) for t in b["text"]], b["doc"].tolist()
            for part in _pieces(forms):
                h, c = word_hashes(forms[part])
                docs, hashes, counts = docs + ids[part], [*hashes, h], [*counts, c]
                if sum(map(len, hashes)) >= most:
                    yield from write(shard, docs, hashes, counts)
                    shard, docs, hashes, counts = shard + 1, [], [], []
        if docs:
            yield from write(shard, docs, hashes, counts)

    return run


def index(docs: DataFrame, doc_id: str, text: str, shard: int = SHARD) -> DataFrame:
    """The positional index (POSTINGS) of the documents, stored in the shared folder; it serves any number of test items."""
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL AND doc IS NOT NULL")
    # Sorted places are stored as differences.
    return kept(corpus.mapInPandas(_shards(shard), POSTINGS), **{"parquet.writer.version": "PARQUET_2_0", "compression": "zstd"})


def _blocks(items: Iterator, least_words: int, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items as words, in lists of at most `most` words together (one longer item stands alone)."""
    part, size = [], 0
    for row in items:
        ws = words(row.text)
        if row.item is None or len(ws) < least_words:
            continue
        if part and size + len(ws) > most:
            yield part
            part, size = [], 0
        part.append((row.item, ws))
        size += len(ws)
    if part:
        yield part


def leaks(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least_words: int = 15, per_edit: int = 10, near: int = 8, block: int = 1_000_000, shard: int = SHARD
) -> DataFrame:
    """Rows (doc_id, item_id): the document reproduces a passage of the item. See the module's text."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long"
    out, postings = None, None
    rows = items.selectExpr(f"`{item_id}` AS item", f"`{item_text}` AS text").toLocalIterator()
    for part in _blocks(rows, max(least_words, PHRASE), block):
        postings = index(docs, doc_id, text, shard) if postings is None else postings
        asked = F.broadcast(spark.createDataFrame(pd.DataFrame({"term": list({w for _, ws in part for w in ws})}, dtype="int64")))
        lists = postings.where("n > 0").join(asked, "term", "left_semi")
        often = {r.term: r.n for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # no more terms than the block has
        probes = spark.sparkContext.broadcast(Probes(part, often))
        of_block = postings.where("n = 0").unionByName(lists.select(postings.columns))
        got = of_block.groupBy("shard").applyInPandas(_search(probes, least_words, per_edit, near), schema)
        out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out
