"""Problem 6: groups of texts that are near copies, by T-occurrence search over inverted lists.

A text is the set of its distinct runs of `width` successive words. Two texts whose sets agree to `share` (Jaccard)
must have T shingles in common, T following from the two sizes. One aggregation counts exactly how often every
shingle stands in the table, and the counts are joined back: the shingles of a text are ordered from rare to frequent by one order
for the whole table, and those that stand in one place only are dropped, for nobody can share them.

The short lists of a text are its first n - T + `hits` ones, the rest are its long lists. Short lists are merged: they
are shuffled by shingle, sorted by size, and all entries of sizes that fit meet in one pass per list. A list is cut
into blocks by its own count, so none falls to one task. Merging counts how often two texts met; of T common shingles
at least `hits` lie on the short lists of both, so that only pairs counted that often are candidates. Two bounds drop
pairs before they are counted and lose none: the places of the shingle in both orders, and a bitmap of 128 bits. The
candidates' lists are probed by binary search for all T. Near copies of near copies are joined by connected components.

A list that grows with the table is not merged as such, for the pairs on it grow with the square. Two texts with fewer
than `hits` common shingles on other lists have T - `hits` + 1 on those; the shingles fall into c colours by their hash, so
that of 2 c + 1 common ones three have one colour. The texts meet in the list of two shingles of one colour, and where
these two are often found together, by a sample, in the list of three. Which ones a sample calls frequent changes the
work, never the result. Pairs that need too few shingles for this are merged on the single lists.

Equal texts (128 bits of hash over their words) are one node from the start: copies are never paired before the result.

Defined results: null texts and texts of fewer than `least_words` words take no part, nor do rows without an id; repeated
ids count once; an empty table gives an empty result; texts are read whole. Further columns are not read. Ids are whole
numbers.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.forms import _ODD, table_form
from strataweave.operators.components import components
from strataweave.session import cut, kept

CHUNK = 1 << 22  # pairs that are worked on at once
CHARACTERS = 1 << 18  # characters that are worked on at once, few enough for the processor's cache
LONG = 10
"""Shingles that stand in 2^LONG texts or more are looked up with others, not alone."""
COLOURS = (3, 8)
"""Colours of long lists for pairs of texts that need few and many common shingles."""
SAMPLE = 30_000
"""About as many texts tell which shingles are often found together."""
BROADCAST_ROWS = 4_000_000
"""Tables of shared shingles up to this size (about 36 MB) go to every task; larger ones are joined."""
BROADCAST_NODES = 1_000_000
"""Candidates' nodes up to this number (8 MB) are told to every task; more are joined."""
HASH_BITS = 58
_U = np.uint64
_LETTER = np.full(0x110000, 2, dtype=np.uint8)  # 1 for letters and digits, filled as characters are met
_POWERS: dict[int, np.ndarray] = {}
_BASES = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(which: int, n: int) -> np.ndarray:
    """1, b, b^2, ... of a base, modulo 2^64."""
    known = _POWERS.get(which)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1024), _BASES[which], dtype=np.uint64)
        steps[0] = 1
        _POWERS[which] = known = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """The polynomial hash of every stretch values[begin:end]."""
    size = end - begin
    place = np.arange(len(values)) - np.repeat(begin, size) if len(begin) and size.sum() == len(values) else None
    assert place is not None or not len(values)
    total = np.concatenate([[_U(0)], np.cumsum(values * _powers(which, int(size.max(initial=0)) + 1)[place], dtype=np.uint64)]) if len(values) else np.zeros(1, dtype=np.uint64)
    return total[end] - total[begin]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, how many words each text has); words are runs of letters and digits."""
    chars = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _LETTER[chars]
    for c in np.unique(chars[kind == 2]):
        _LETTER[c] = unicodedata.category(chr(c))[0] in "LN"
    inside = np.concatenate([[0], _LETTER[chars] == 1, [0]]).astype(np.int8)
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    letters = chars[inside[1:-1] == 1].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(end - begin)])
    hashes = _mix(_sums(_mix(letters + _U(1)), at[:-1], at[1:], 0) + (end - begin).astype(np.uint64))
    stop = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(begin, stop)]))


def _pieces(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about `CHARACTERS` characters; a longer text is one run."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARACTERS:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def _form(text: str) -> str:
    return (table_form(text) if not text.isascii() and _ODD.search(text) else text).lower()


def _identities(least: int):
    """Rows (id, h1, h2) of the texts with at least `least` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            forms, ids = [_form(t) for t in b["text"]], b["id"].to_numpy()
            for part in _pieces(forms):
                hashes, count = word_hashes(forms[part])
                at = np.concatenate([[0], np.cumsum(count)])
                h1 = _mix(_sums(hashes, at[:-1], at[1:], 1) + count.astype(np.uint64)).view(np.int64)
                yield pd.DataFrame({"id": ids[part], "h1": h1, "h2": _mix(_sums(_mix(hashes), at[:-1], at[1:], 2)).view(np.int64)})[count >= least]

    return run


Flat = tuple[np.ndarray, np.ndarray, np.ndarray]
"""Sets of a batch: their nodes, how many members stand there for each, and the members, one set after the other; a member may be repeated."""


def of_arrays(b: pd.DataFrame) -> Flat:
    """The sets of rows (node, shingles)."""
    members = b["shingles"].to_list()
    return b["node"].to_numpy(), np.fromiter(map(len, members), np.int64, len(members)), np.concatenate([np.zeros(0, np.int64), *members])


def of_texts(width: int) -> Callable[[pd.DataFrame], Flat]:
    """The sets of rows (node, text): the hashes of the runs of `width` successive words."""

    def read(b: pd.DataFrame) -> Flat:
        forms, sizes, members = [_form(t) for t in b["text"]], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in _pieces(forms):
            hashes, count = word_hashes(forms[part])
            doc = np.repeat(np.arange(len(count)), count)
            last = max(0, len(hashes) - width + 1)
            runs = np.zeros(last, dtype=np.uint64)
            for k in range(width):
                runs = _mix(runs * _U(3) + hashes[k : k + last])
            whole = doc[:last] == doc[width - 1 :][:last]
            sizes.append(np.bincount(doc[:last][whole], minlength=len(count)))
            members.append(runs[whole].view(np.int64))
        return b["node"].to_numpy(), np.concatenate(sizes), np.concatenate(members)

    return read


def _lists(sizes: np.ndarray, members: np.ndarray) -> list[np.ndarray]:
    return np.split(members, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _counted(read):
    """How often each shingle stands in a batch; the rest of the counting is Spark's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, n = np.unique(read(b)[2], return_counts=True)
            yield pd.DataFrame({"s": s, "n": n})

    return run


def frequencies(sets: DataFrame, read: Callable[[pd.DataFrame], Flat] = of_arrays) -> DataFrame:
    """Rows (s, n): the shingles that stand in more than one place, with their exact counts."""
    return sets.mapInPandas(_counted(read), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def _keys(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number per shingle that orders it from rare to frequent (the count's power of two) and tells it from others (58 bits of hash)."""
    rare = np.minimum(np.floor(np.log2(n)), 31).astype(np.int64)
    return (rare << HASH_BITS) | (s & ((1 << HASH_BITS) - 1))


def ordered(shared: DataFrame, read: Callable[[pd.DataFrame], Flat], most: int = BROADCAST_ROWS) -> Callable[..., DataFrame]:
    """A function (sets, use, fields, short) that hands sets in order to `use`, batch by batch, and gives its rows.

    `use` gets the nodes, the sizes of their sets, the numbers of their shared shingles, and these from rare to frequent,
    as keys or, if `short` says so and the table is at hand, as their ranks in it, which are smaller numbers.
    The table of shared shingles (s, n) goes to all tasks if it is counted to have at most `most` rows; a larger one is joined.
    """
    if shared.count() > most:
        rare = F.least(F.floor(F.log2("n")), F.lit(31)).cast("long")
        key = F.shiftleft(rare, HASH_BITS).bitwiseOR(F.col("s").bitwiseAND((1 << HASH_BITS) - 1))
        by_key = shared.select("s", key.alias("key")).hint("merge")

        def as_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                node, n, s = read(b)
                yield pd.DataFrame({"node": np.repeat(node, n), "s": s})

        def joined(part: DataFrame, use, fields: str, short: bool = False) -> DataFrame:
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    keys = b["keys"].to_list()
                    yield use(b["node"].to_numpy(), b["n"].to_numpy(), np.fromiter(map(len, keys), np.int64, len(keys)), np.concatenate([np.zeros(0, np.int64), *keys]))

            rows = part.mapInPandas(as_rows, "node long, s long").join(by_key, "s", "left").groupBy("node")
            rows = rows.agg(F.count_if(F.col("key").isNull()).alias("alone"), F.array_sort(F.collect_set("key")).alias("keys"))
            return rows.select("node", (F.col("alone") + F.size("keys")).alias("n"), "keys").mapInPandas(run, fields)

        return joined
    table = shared.toPandas().sort_values("s")
    keys = _keys(table["s"].to_numpy(), table["n"].to_numpy())
    by_rank = np.argsort(keys)
    rank = np.empty(len(keys), dtype=np.int64)
    rank[by_rank] = np.arange(len(keys))
    known = shared.sparkSession.sparkContext.broadcast((table["s"].to_numpy(), rank, keys[by_rank]))

    def looked_up(part: DataFrame, use, fields: str, short: bool = False) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            s, rank, key = known.value
            for b in batches:
                node, count, members = read(b)
                if not len(members) or not len(s):
                    continue
                at = np.minimum(np.searchsorted(s, members), len(s) - 1)
                is_shared = s[at] == members
                of = np.repeat(np.arange(len(node)), count)
                alone = np.bincount(of[~is_shared], minlength=len(node))
                each = np.sort((of[is_shared] << 32) | rank[at[is_shared]])
                each = each[np.diff(each, prepend=-1) != 0]
                m = np.bincount(each >> 32, minlength=len(node))
                each &= 0xFFFFFFFF
                yield use(node, alone + m, m, each if short else key[each])

        return part.mapInPandas(run, fields)

    return looked_up


def _least(share: float, sizes):
    """How many shingles two sets of `sizes` together must share."""
    return np.ceil(share / (1 + share) * sizes - 1e-9).astype(np.int64)


def _short(share: float, n: np.ndarray, hits: int, as_smaller: bool) -> np.ndarray:
    """How many lists of a set of n shingles are short, as the larger or the smaller text of a pair."""
    least = _least(share, 2 * n) if as_smaller else np.ceil(share * n - 1e-9).astype(np.int64)
    return np.minimum(n, n - least + hits)


POSTINGS = "key long, node long, sizes long, place int, b0 long, b1 long"
Kinds = tuple[np.ndarray, np.ndarray, np.ndarray]
"""Of lists of rare shingles, of single long ones, and of combinations by few and many colours: the places reached beyond n - T, the least and the largest T."""
NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))
"""No shingles that are often found together: their combinations' hashes, sorted, and the power of two of how often."""


def _kinds(hits: int) -> Kinds:
    reach = np.array([hits, hits, *(hits + 2 * c for c in COLOURS)])
    least = np.array([1, 1, *reach[2:]])
    return reach, least, np.array([1 << 31, reach[2] - 1, reach[3] - 1, 1 << 31])


def _joint(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return (_mix(a.view(np.uint64) * _U(3) + b.view(np.uint64) + _U(kind)) & _U((1 << HASH_BITS) - 1)).view(np.int64)


def _often(joint: np.ndarray, together: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The power of two of how often combinations are found, 0 where the sample doesn't say often."""
    known, power = together
    if not len(known):
        return np.zeros(len(joint), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, joint), len(known) - 1)
    return np.where(known[at] == joint, power[at], 0)


def _combined(keys: np.ndarray, of: np.ndarray, chosen: np.ndarray, kind: int, together: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(keys of two or three chosen shingles of one text and colour, where the last of them stands in `keys`)."""
    colours = COLOURS[kind - 2]
    at = np.flatnonzero(chosen)
    cell = of[at] * colours + ((keys[at] >> 14) & 0xFFFFFF) % colours
    by_cell = np.argsort(cell, kind="stable")
    at, cell = at[by_cell], cell[by_cell]
    k, end = keys[at], np.searchsorted(cell, cell, "right")

    def later(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = end[x] - x - 1
        which = np.repeat(np.arange(len(x)), c)
        return which, x[which] + 1 + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)

    first, second = later(np.arange(len(at)))
    two = _joint(k[first], k[second], kind)
    power = _often(two, together)
    alone = power == 0
    first, pair, middle, power = first[~alone], two[~alone], second[~alone], power[~alone]
    which, third = later(middle)
    ok = (_often(_joint(k[first[which]], k[third], kind), together) > 0) & (_often(_joint(k[middle[which]], k[third], kind), together) > 0)
    which, third = which[ok], third[ok]
    three = (power[which] << HASH_BITS) | _joint(pair[which], k[third], kind)
    return np.concatenate([two[alone], three]), at[np.concatenate([second[alone], third])]


def _placed(share: float, hits: int, long: int, n: np.ndarray, m: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of which set each key is, its place there, and for each kind of list which keys go there."""
    of = np.repeat(np.arange(len(n)), m)
    place = np.arange(len(keys)) + (n - np.cumsum(m))[of]
    is_long = keys >> HASH_BITS >= long
    fewest = np.ceil(share * n - 1e-9)
    longs, chosen = np.bincount(of[is_long], minlength=len(n)), []
    for kind, (reach, least, largest) in enumerate(zip(*_kinds(hits))):
        taken = (fewest <= largest) & (n >= least)
        if kind > 1:
            taken &= longs >= fewest - hits + 1  # else `hits` common ones stand on short lists
        chosen.append((is_long == (kind > 0)) & (place < _short(share, n, reach, False)[of]) & taken[of])
    return of, place, chosen


def _postings(share: float, hits: int, long: int = LONG, together=None):
    """Rows (POSTINGS): the short lists and combinations of every set; sizes holds the size with and without the shingles that nobody shares, place also the kind of list."""

    def use(node: np.ndarray, n: np.ndarray, m: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        of, place, chosen = _placed(share, hits, long, n, m, keys)
        bit = (keys >> 7) & 127
        signs = np.zeros((2, len(node)), dtype=np.uint64)
        for half in (0, 1):
            mine = (bit >> 6) == half
            np.bitwise_or.at(signs[half], of[mine], _U(1) << (bit[mine] & 63).astype(np.uint64))
        known = NONE if together is None else together.value
        lists = [(keys[c], np.flatnonzero(c)) for c in chosen[:2]] + [_combined(keys, of, chosen[kind], kind, known) for kind in (2, 3)]
        at = np.concatenate([x[1] for x in lists])
        kind = np.repeat(np.arange(4), [len(x[1]) for x in lists])
        of = of[at]
        return pd.DataFrame({
            "key": np.concatenate([x[0] for x in lists]), "node": node[of], "sizes": ((n << 32) | m)[of], "place": (place[at] << 2 | kind).astype(np.int32),
            "b0": signs[0].view(np.int64)[of], "b1": signs[1].view(np.int64)[of],
        })

    return use


def _found_together(share: float, hits: int, long: int):
    """Rows (key, k): how often two long shingles of one colour stand in a batch's short parts."""

    def use(node: np.ndarray, n: np.ndarray, m: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
        of, _, chosen = _placed(share, hits, long, n, m, keys)
        key, k = np.unique(np.concatenate([_combined(keys, of, chosen[kind], kind, NONE)[0] for kind in (2, 3)]), return_counts=True)
        return pd.DataFrame({"key": key, "k": k})

    return use


def _key_lists(node: np.ndarray, n: np.ndarray, m: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"node": node, "keys": _lists(m, keys)})


def _met(f: pd.DataFrame, share: float, hits: int) -> pd.DataFrame:
    """Rows (x, y, need, hits): how often a larger text x and a smaller one y meet on the lists of f, which are whole and sorted; a combination is `hits` at once."""
    key, cell, node, place = (f[c].to_numpy() for c in ("key", "cell", "node", "place"))
    cell, side = cell >> 2, cell & 3  # which two chunks meet, and which of them the entry is from; 2 where a chunk meets itself
    kind, place = place & 3, place >> 2
    reach, least, largest = (x[kind] for x in _kinds(hits))
    n, m = (f["sizes"].to_numpy() >> 32), (f["sizes"].to_numpy() & 0xFFFFFFFF)
    signs = [f[c].to_numpy().view(np.uint64) for c in ("b0", "b1")]
    new = np.ones(len(f), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    run = np.cumsum(new)
    # An entry meets the indexed ones before it in its list whose size is large enough; lists are sorted by size.
    indexed = np.flatnonzero(place < _short(share, n, reach, True))
    lowest = np.searchsorted((run << 32) + n, (run << 32) + np.ceil(share * n - 1e-9).astype(np.int64))
    first, last = np.searchsorted(indexed, lowest), np.searchsorted(indexed, np.arange(len(f)))
    count = np.maximum(last - first, 0)
    total = np.cumsum(count)
    out, at = [], 0
    while at < len(f):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK)))
        c = count[at:upto]
        x = np.repeat(np.arange(at, upto), c)
        y = indexed[np.arange(len(x)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:upto], c)]
        need = _least(share, n[x] + n[y])
        ok = (np.minimum(n[x] - place[x], n[y] - place[y]) >= need - (reach[x] - 1)) & (need >= least[x]) & (need <= largest[x]) & (node[x] != node[y]) & ((side[x] != side[y]) | (side[x] == 2))
        x, y, need = x[ok], y[ok], need[ok]
        apart = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in signs)
        ok = apart <= m[x] + m[y] - 2 * need
        out.append(pd.DataFrame({"x": node[x[ok]], "y": node[y[ok]], "need": need[ok], "hits": np.where(kind[x[ok]] > 1, hits, 1)}))
        at = upto
    return pd.concat(out).groupby(["x", "y", "need"], as_index=False)["hits"].sum()


def _merge(share: float, hits: int):
    """Merges lists that come sorted; the list at the end of a batch waits for its rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            same = (b["key"].to_numpy() == b["key"].iloc[-1]) & (b["cell"].to_numpy() >> 2 == b["cell"].iloc[-1] >> 2)
            rest = b[same]
            if not same.all():
                yield _met(b[~same], share, hits)
        if rest is not None:
            yield _met(rest, share, hits)

    return run


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the candidates whose lists hold T common shingles."""
    for b in batches:
        ok = []
        for x, y, need in zip(b["kx"], b["ky"], b["need"]):
            at = np.searchsorted(y, x) if len(y) else None
            ok.append(at is not None and int((y[np.minimum(at, len(y) - 1)] == x).sum()) >= need)
        yield b.loc[np.array(ok, dtype=bool), ["x", "y"]]


def near_pairs(sets: DataFrame, share: float, block: int = 4000, hits: int = 3, most: int = BROADCAST_ROWS, read: Callable[[pd.DataFrame], Flat] = of_arrays, long: int = LONG, often: int = 1 << LONG) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose sets (node, shingles) have a Jaccard similarity of at least `share`.

    `read` takes the sets from a batch of rows, if these hold something else next to node. Shingles of 2^long texts or more
    are combined by two, or by three where two are found together `often`.
    """
    shared = kept(frequencies(sets, read))
    order, together = ordered(shared, read, most), None
    if not shared.where(F.col("n") >= 1 << long).isEmpty():
        step = max(1, sets.count() // SAMPLE)
        counts = order(sets.where(F.pmod(F.xxhash64("node"), F.lit(step)) == 0), _found_together(share, hits, long), "key long, k long")
        seen = counts.groupBy("key").agg(F.sum("k").alias("k")).where(F.col("k") >= max(min(6, often), often // step)).toPandas().sort_values("key")
        together = sets.sparkSession.sparkContext.broadcast((seen["key"].to_numpy(), np.clip(np.log2(seen["k"].to_numpy() * float(step)).astype(np.int64), 1, 31)))
    short = order(sets, _postings(share, hits, long, together), POSTINGS)
    # A list longer than a block is cut into chunks, and every two chunks meet in a cell of their own.
    chunks = F.ceil(F.pow(F.lit(2), F.shiftright("key", HASH_BITS) + 1) / block)
    mine = F.when(chunks > 1, F.pmod(F.xxhash64("node"), chunks)).otherwise(0)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda o: (
        (F.least(mine, o) * (1 << 29) + F.greatest(mine, o)) * 4 + F.when(mine == o, 2).otherwise((mine > o).cast("int"))))
    lists = short.select("*", F.explode(F.when(chunks > 1, cells).otherwise(F.array(F.lit(2).cast("long")))).alias("cell"))
    cell = F.shiftright("cell", 2)
    lists = lists.repartition("key", cell).sortWithinPartitions("key", cell, F.shiftright("sizes", 32), "node")
    met = lists.mapInPandas(_merge(share, hits), "x long, y long, need long, hits long")
    met = met.groupBy("x", "y", "need").agg(F.sum("hits").alias("hits")).where(F.col("hits") >= F.least(F.lit(hits), "need"))
    met = kept(met)
    asked = kept(met.select(F.explode(F.array("x", "y")).alias("node")).distinct())
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_NODES else asked.hint("merge")
    keys = order(sets.join(asked, "node", "left_semi"), _key_lists, "node long, keys array<bigint>", short=True)
    of = lambda node, k: keys.select(F.col("node").alias(node), F.col("keys").alias(k)).hint("merge")
    found = met.join(of("x", "kx"), "x").join(of("y", "ky"), "y").mapInPandas(_probe, "x long, y long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(df: DataFrame, id_: str, text: str, width: int = 5, share: float = 0.8, least_words: int = 1) -> DataFrame:
    """Rows (id, root): the group of every text that takes part; a text without near copies is a group of its own."""
    rows = df.where(F.col(text).isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    ids = kept(rows.mapInPandas(_identities(max(least_words, width)), "id long, h1 long, h2 long").dropDuplicates(["id"]))
    nodes = ids.groupBy("h1", "h2").agg(F.min("id").alias("node"))
    members = kept(ids.join(nodes.hint("merge"), ["h1", "h2"]).select("id", "node"))
    first = rows.join(members.where("id = node").select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    texts = kept(first.select(F.col("id").alias("node"), "text"))
    roots = components(near_pairs(texts, share, read=of_texts(width)), "a", "b")
    return members.join(roots.hint("merge"), "node", "left").select("id", F.coalesce("root", "node").alias("root"))


def group_pairs(grouped: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of one group, as the result asks for; groups of one are left out first."""
    grouped = cut(grouped)
    many = grouped.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("root")
    rows = grouped.join(many.hint("merge"), "root", "left_semi")
    a, b = rows.select("root", F.col("id").alias("id_a")), rows.select("root", F.col("id").alias("id_b"))
    return a.join(b.hint("merge"), "root").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
