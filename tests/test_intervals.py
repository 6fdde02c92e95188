import random
from collections import defaultdict

import pytest

from strataweave.operators.intervals import coverage

SCHEMA = "src long, rel string, vf long, vt long, rec long"


def brute(rows):
    by = defaultdict(list)
    for src, rel, vf, vt, rec in rows:
        s, e = (rec if vf is None else vf), (1 << 62 if vt is None else vt)
        if src is not None and s is not None and e > s:
            by[src, rel].append((s, e))
    out = set()
    for (src, rel), iv in by.items():
        merged = []
        for s, e in sorted(iv):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        for i, (s, e) in enumerate(merged):
            out.add((src, rel, "period", s, -1 if e == 1 << 62 else e))
            if i + 1 < len(merged):
                out.add((src, rel, "gap", e, merged[i + 1][0]))
    return out


def run(spark, rows, **kw):
    df = coverage(spark.createDataFrame(rows, SCHEMA), ["src", "rel"], "vf", "vt", "rec", ["src"], **kw)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_small_cases(spark):
    rows = [(1, "a", 0, 10, 0), (1, "a", 10, 20, 0), (1, "a", 30, None, 0), (1, "a", 5, 5, 0), (1, "a", 9, 3, 0), (None, "a", 0, 1, 0), (2, None, None, 8, 3), (2, None, None, 8, 3), (3, "b", None, None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:0]) == set()


@pytest.mark.parametrize("seed", range(4))
def test_huge_keys_are_sharded_with_the_same_result(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(900):
        s = rnd.randrange(3000)
        length = rnd.choice([0, 1, 2, 3, 5, -4, 40, 300 if seed % 2 else 4])
        rows.append((1 if i % 3 else rnd.randrange(2, 9), rnd.choice("ab"), s if rnd.random() < 0.9 else None, s + length if rnd.random() < (0.99 if seed else 1) else None, s))
    for shards in (1, 3, 40):
        assert run(spark, rows, shards=shards) == brute(rows)


def test_more_keys_than_shards_and_one_key_in_all_shards(spark):
    rows = [(k, "a", i * 10, i * 10 + (k % 12), 0) for k in range(2500) for i in range(3)] + [(9999, "b", i * 3, i * 3 + i % 5, 0) for i in range(6000)] + [(9999, "b", 100, 900, 0)] * 500
    assert run(spark, rows, shards=16) == brute(rows)
