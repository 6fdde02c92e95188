import random
from collections import defaultdict

from strataweave.llm import neardup


def brute(rows, width, share, least):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if len(w) >= max(least, width):
            sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        text = [rnd.choice(words) for _ in range(rnd.randrange(8, 70))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rnd.randrange(4)):
            copy = list(text)
            for _ in range(rnd.randrange(6)):
                k = rnd.randrange(len(copy))
                rnd.choice([lambda: copy.pop(k), lambda: copy.insert(k, rnd.choice(words)), lambda: copy.__setitem__(k, rnd.choice(words))])()
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows) + k, "the same text " * 6) for k in range(30)] + [(5000, None), (5001, ""), (5002, "one two")]


LOST = [(None, "the same text " * 6), (None, None)]


def pairs(spark, rows, **kw):
    df = spark.createDataFrame(rows + LOST, "id long, body string").selectExpr("id", "body", "id AS node", "body AS words")
    got = [tuple(r) for r in neardup.group_pairs(neardup.groups(df, "id", "body", **kw)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_groups_equal_brute_force(spark):
    for seed, width, share, least in ((1, 3, 0.6, 15), (2, 5, 0.8, 1), (3, 2, 0.4, 4)):
        rows = corpus(seed)
        assert pairs(spark, rows, width=width, share=share, least_words=least) == brute(rows, width, share, least)
    assert pairs(spark, [], width=3, share=0.6) == set()


def test_frequent_shingles_meet_in_blocks(spark):
    rows = [r for r in corpus(9) if len((r[1] or "").split()) >= 3]
    df = spark.createDataFrame(rows, "id long, body string")
    from pyspark.sql import functions as F

    runs = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.slice("w", i + 1, 3)))
    sets = df.select(F.col("id").alias("node"), F.split("body", " ").alias("w")).select("node", F.array_distinct(runs).alias("shingles"))
    known = {r.node: set(r.shingles) for r in sets.collect()}
    whole = {(a, b) for a in known for b in known if a < b and len(known[a] & known[b]) >= 0.5 * len(known[a] | known[b])}
    for hits in (1, 3, 6):
        assert {tuple(r) for r in neardup.near_pairs(sets, 0.5, hits=hits).collect()} == whole
    # lists in blocks of five; shared shingles joined instead of handed to all tasks
    assert sorted(tuple(r) for r in neardup.near_pairs(sets, 0.5, block=5, most=0).collect()) == sorted(whole)


def test_words_are_hashed_as_they_stand():
    texts = ["a b\u00e9 c1", "", "b\u00e9!!a  x", "\U0001d400\U0001d401 a"]
    hashes, count = neardup.word_hashes(texts)
    assert count.tolist() == [3, 0, 3, 2]
    assert hashes[0] == hashes[4] == hashes[7] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 5


def test_long_lists_are_combined(spark):
    import numpy as np
    import pandas as pd

    rnd = random.Random(4)
    clauses = [[f"c{c}w{k}" for k in range(6)] for c in range(25)]
    rows = []
    for _ in range(60):
        text = sum((rnd.choice(clauses) for _ in range(rnd.randrange(3, 16))), [])
        rows.append((len(rows), text))
        copy = list(text)
        for _ in range(rnd.randrange(4)):
            copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(9)}"
        rows.append((len(rows), copy))
    known = {i: {hash(tuple(w[j : j + 3])) for j in range(len(w) - 2)} for i, w in rows}
    sets = spark.createDataFrame([(i, sorted(s)) for i, s in known.items()], "node long, shingles array<bigint>")
    for share, hits, long, often in ((0.6, 3, 2, 1024), (0.6, 3, 1, 2), (0.5, 1, 3, 3), (0.4, 2, 2, 4)):
        whole = {(a, b) for a in known for b in known if a < b and len(known[a] & known[b]) >= share * len(known[a] | known[b]) - 1e-9}
        assert {tuple(r) for r in neardup.near_pairs(sets, share, hits=hits, long=long, often=often).collect()} == whole
    assert {tuple(r) for r in neardup.near_pairs(sets, 0.4, block=5, most=0, hits=2, long=2, often=4).collect()} == whole

    # texts of random clauses: shingles of all texts meet in lists of two and three, which are shorter than theirs
    texts = [np.concatenate([np.arange(6) + 6 * c for c in sorted(rnd.sample(range(300), 12))]) for _ in range(3000)]
    keys = (np.int64(12) << neardup.HASH_BITS) | (neardup._mix(np.concatenate(texts).astype(np.uint64)) >> np.uint64(6)).view(np.int64)
    n = np.full(3000, 72)
    of = np.repeat(np.arange(3000), 72)
    keys = keys[np.lexsort((keys, of))]
    seen = neardup._found_together(0.6, 3, 10)(n, n, n, keys)
    seen = seen[seen["k"] >= 20].sort_values("key")
    lists = neardup._postings(0.6, 3, 10, type("Known", (), {"value": (seen["key"].to_numpy(), np.full(len(seen), 5))}))(n, n, n, keys)
    length = lambda key: pd.Series(key).value_counts().pow(2).sum()
    assert length(lists["key"]) < length(keys) / 10
