import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strataweave.operators import fusion, lexical, vectors


def test_query_terms(spark):
    df = spark.createDataFrame([("how does --no-verify work in src/main.rs?",), ("the of ?!",), (None,), ("x.. café 42 a",), (" ".join(f"w{i}" for i in range(40)),)], "t string")
    got = [r[0] for r in df.select(F.transform(lexical.query_terms(F.col("t")), lambda x: F.concat(x["term"], F.when(x["prefix"], "*").otherwise(""))).alias("x")).collect()]
    assert got[0] == ["no", "verify*", "work*", "src/main.rs*"]
    assert got[1:4] == [[], None, ["cafe*", "42"]]
    assert len(got[4]) == 24


def test_bm25_against_plain_python(spark):
    rnd = random.Random(3)
    words = ["deploy", "deploys", "queue", "node", "no", "café", "cache", "cacher", "42"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 12)))) for i in range(60)] + [(60, ""), (61, None)]
    queries = [(1, "deploy the cache"), (2, "no"), (3, "CAFE 42 queue queue"), (4, "the"), (5, "zebra")]
    split = {i: (t or "").replace("é", "e").split() for i, t in docs}
    n, avg = len(docs), sum(map(len, split.values())) / (len(docs) - 1)  # the null text has no length
    want = {}
    for q, t in queries:
        scores = Counter()
        for term in [x.lower().replace("é", "e") for x in t.split() if x != "the"]:
            tf = {i: sum(w.startswith(term) if len(term) > 2 else w == term for w in ws) for i, ws in split.items()}
            df = sum(v > 0 for v in tf.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
            idf = 1e-6 if df and math.log((n - df + 0.5) / (df + 0.5)) <= 0 else idf
            for i, v in tf.items():
                if v:
                    scores[i] += idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(split[i]) / avg))
        want[q] = sorted(((-round(s, 9), i) for i, s in scores.items()))[:5]
    got = {}
    hits = lexical.bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "id long, t string"), "id", "t", most=5)
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    for q in want:
        assert [i for _, i in want[q]] == [i for _, i in got.get(q, [])]
        assert np.allclose([s for s, _ in want[q]], [s for s, _ in got.get(q, [])], atol=2e-6)


def test_quantize_and_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([3.0, 4.0],), ([-1.0, 1.0],)], "v array<float>")
    q = [list(r[0]) for r in df.select(vectors.quantize(F.col("v"))).collect()]
    assert q == [[127, 0], [0, 0], [76, 102], [-90, 90]]
    pairs = spark.createDataFrame([([127, 0], [127, 0]), ([127, 0], [0, 127]), ([127, 0], [127])], "a array<tinyint>, b array<tinyint>")
    assert [r[0] for r in pairs.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(-127, 128, (300, 16))
    rows = [(i, m[i].tolist(), i % 3) for i in range(300)] + [(900, [1, 2], 0), (901, None, 0)]
    v = spark.createDataFrame(rows, "id long, q array<tinyint>, scope_id long")
    q = v.where("id < 10").selectExpr("id AS query_id", "q")
    got = vectors.nearest(q, v.drop("scope_id"), k=7, block=4).collect()
    for i in range(10):
        want = sorted(((-int(m[i] @ m[j]), j) for j in range(300)))[:7]
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [j for _, j in want]
    scoped = vectors.nearest(q.withColumn("scopes", F.array(F.lit(1).cast("long"))), v, k=5).collect()
    assert len(scoped) == 50 and all(r.id % 3 == 1 for r in scoped)
    close = {(r.query_id, r.id) for r in vectors.within(q, v.drop("scope_id"), 0.2).collect()}
    assert close == {(i, j) for i in range(10) for j in range(300) if m[i] @ m[j] >= 0.2 * vectors.UNIT}
    assert vectors.nearest(q.where("query_id < 0"), v).count() == 0


def test_floor(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.5), (2, 1, 0.01), (3, 5, 0.025)], "query_id long, id long, cos double")
    assert {(r.query_id, r.id) for r in vectors.relative_floor(df).collect()} == {(1, 1), (1, 2), (3, 5)}


def test_rrf_rewards_agreement(spark):
    legs = [(1, i, "bm25", r) for r, i in enumerate([1, 2, 3], 1)] + [(1, i, "vector", r) for r, i in enumerate([3, 4, 5], 1)]
    rows = fusion.rrf(spark.createDataFrame(legs, "query_id long, id long, leg string, rank int")).orderBy("rank").collect()
    assert rows[0].id == 3 and rows[0].via == ["bm25", "vector"] and abs(rows[0].score - (1 / 63 + 0.7 / 61)) < 1e-9
    assert [r.id for r in rows] == [3, 1, 2, 4, 5]


def test_diversify_drops_rephrasings(spark):
    pool = [(1, 1, 0.03, "always run the linter before a commit", None), (1, 2, 0.029, "always run the linter before every commit", None), (1, 3, 0.028, "the cache lives on the second node", None), (2, 9, 0.01, None, None)]
    rows = fusion.diversify(spark.createDataFrame(pool, "query_id long, id long, score double, statement string, q array<tinyint>"), 6).collect()
    assert [r.id for r in sorted((r for r in rows if r.query_id == 1), key=lambda r: r.pick)] == [1, 3]
    assert [r.id for r in rows if r.query_id == 2] == [9]


def test_dice_and_adjust(spark):
    df = spark.createDataFrame([("the quick fox", "The QUICK dog"), ("a b", "a b"), ("", "word")], "a string, b string")
    assert [r[0] for r in df.select(fusion.dice(F.col("a"), F.col("b"))).collect()] == [2 * 2 / 6, 0.0, 0.0]
    day = 86_400_000
    df = spark.createDataFrame([(1.0, 0, 0), (0.0, 0, 0), (2.0, -90 * day, 3), (1.0, day, 0)], "c double, r long, h long")
    got = [r[0] for r in df.select(fusion.adjusted(F.lit(1.0), F.col("c"), F.col("r"), F.col("h"), 0)).collect()]
    assert np.allclose(got, [1.0, 0.7, (0.85 + 0.15 / math.e) * (1 + 0.05 * math.log(4)), 1.0])


def test_merge_keeps_the_newer(spark):
    facts = spark.createDataFrame([(1, 10, 2), (2, 20, 1), (3, 20, 5), (4, 1, 0)], "id long, recorded_at long, hits long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a long, b long")
    got = {(r.keep, r.gone, r.hits) for r in vectors.merge_near_duplicates(pairs, facts, 99).collect()}
    assert got == {(2, 1, 2), (2, 3, 5)}
    assert vectors.merge_near_duplicates(pairs.limit(0), facts, 99).count() == 0


def test_recall_finds_through_the_graph(spark):
    facts = [
        (1, 2, 10, 11, "ci runs on node 22", 1.0, 0, None, 0, None, 0),
        (2, 2, 10, 12, "ci uses github actions", 1.0, 0, None, 0, None, 0),
        (3, 2, 13, 14, "the api uses postgres", 1.0, 0, None, 0, None, 0),
        (4, 3, 15, 16, "github actions in another scope", 1.0, 0, None, 0, None, 0),
        (5, 2, 10, 12, "ci used github actions once", 1.0, 0, 5, 0, 5, 0),
    ]
    f = spark.createDataFrame(facts, "id long, scope_id long, src long, dst long, statement string, confidence double, valid_from long, valid_to long, recorded_at long, invalidated_at long, hits long")
    n = spark.createDataFrame([(i, 1) for i in range(10, 17)], "id long, degree long")
    q = spark.createDataFrame([(7, "github actions", 2)], "query_id long, text string, scope_id long")
    legs = {(r.id, r.leg) for r in fusion.legs(q, f, n).collect()}
    assert (2, "bm25") in legs and (1, "graph") in legs and not {4, 5} & {i for i, _ in legs}
    assert not [1 for i, leg in {(r.id, r.leg) for r in fusion.legs(q, f, n, hops=0).collect()} if leg == "graph"]
    got = fusion.recall(q, f, n, 0, limit=6).orderBy("pick").collect()
    assert got[0].id == 2 and len({r.id for r in got}) == len(got)


def test_merging_takes_every_live_fact(spark):
    """Greedy merging as the reference walks it, over all facts, with copies and blocks that meet."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(1, 241):
        v = base[0] if i % 3 == 0 else base[rng.integers(12)] + rng.choice([0.0, 0.13]) * rng.standard_normal(16)
        rows.append((i, int(i % 5 == 0), int(rng.integers(6)), i, np.round(v / np.linalg.norm(v) * 127).astype(int).tolist()))
    rows += [(300, 0, 1, 1, [0] * 16), (301, 0, 2, 1, [0] * 16), (302, None, 2, 1, [127] + [0] * 15)]
    want, gone = set(), set()
    for a, sa, ta, ha, qa in rows:
        for b, sb, tb, hb, qb in rows if sa is not None else ():
            if a != b and sa == sb and a not in gone and b not in gone and np.dot(qa, qb) >= vectors.MERGE_AT * vectors.UNIT:
                want.add((a, b, hb) if ta >= tb else (b, a, ha))
                gone.add(b if ta >= tb else a)
    index = spark.createDataFrame(rows, "id long, scope_id long, recorded_at long, hits long, q array<tinyint>")
    got = [(r.keep, r.gone, r.hits) for r in vectors.merge_equal_and_near(index, 9, block=7).collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want
    assert vectors.merge_equal_and_near(index.limit(0), 9).count() == 0


def test_merged_facts_are_not_an_id_subset(spark, tmp_path):
    from strataweave.plans import search_queries

    rows = [(i, 2, "the cache lives on the second node" + "." * (i % 3), None, i, 0) for i in range(1, 50)] + [(51, 3, "The cache lives on the second node", None, 9, 0)]
    spark.createDataFrame(rows, "id long, scope_id long, statement string, invalidated_at long, recorded_at long, hits long").write.parquet(f"{tmp_path}/facts.parquet")
    got = {(r.keep, r.gone) for r in search_queries.merged_facts(spark, str(tmp_path)).collect()}
    assert got == {(i + 1, i) for i in range(1, 49)}


def test_explained_facts_has_every_live_fact(spark, tmp_path):
    from strataweave.plans import search_queries

    facts = [(i, 2 if i % 2 else 1, f"the cache of node {i}", None) for i in range(1, 141)] + [(200, 3, "the cache", None), (201, 2, "the cache", 5)]
    spark.createDataFrame(facts, "id long, scope_id long, statement string, invalidated_at long").write.parquet(f"{tmp_path}/facts.parquet")
    spark.createDataFrame([(50, 2, "the Cache of no node"), (100, 3, "the"), (51, 2, "cache")], "id long, scope_id long, name string").write.parquet(f"{tmp_path}/entities.parquet")
    rows = search_queries.explained_facts(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.id) for r in rows) == [(50, i) for i in range(1, 141)] + [(100, i) for i in range(2, 141, 2)] + [(100, 200)]
    assert {(r.query_id, r.match) for r in rows} == {(50, '"Cache"* OR "no" OR "node"*'), (100, None)}
    for q in (50, 100):
        floor = max(0.02, 0.65 * max(r.cos for r in rows if r.query_id == q))
        assert all(abs(r.floor - floor) < 1e-12 and r.kept == (r.cos >= floor) for r in rows if r.query_id == q)
    assert sum(r.kept for r in rows if r.query_id == 50) > 60
