import random

import numpy as np

from strataweave.llm import reading

EASY = ["The cache reads the queue.", "The job runs well.", "We saw the page.", "The file is small."]
HARD = [
    "The probabilistic invalidation heuristic inevitably complicates the asynchronous reconciliation of divergent replicas, insofar as the underlying assumptions remain unverified.",
    "A comparatively conservative retention policy, notwithstanding the observations accumulated previously, substantially undermines the transactional isolation of concurrent supersession.",
]


def document(level, rnd):
    said = [rnd.choice(HARD) if rnd.random() < (level - 1) / 3 else rnd.choice(EASY) for _ in range(24)]
    return "# Title\n" + " ".join(said) + "\n```\n$ run --x=1 a/b_1.sql\n```\n"


def test_boosting_fits_a_function():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (600, 6))
    y = np.where(x[:, 0] > 0.2, 2.0, 0.0) + x[:, 3]
    model = reading.Boosted().fit(x[:400], y[:400])
    assert np.abs(model.predict(x[400:]) - y[400:]).mean() < 0.12
    assert np.allclose(reading.Boosted().fit(x[:5], np.ones(5)).predict(x), 1.0)


def test_cut_points_part_the_grades():
    score = np.array([1.1, 1.3, 1.8, 2.0, 2.9, 3.1])
    low, high = reading.cut_points(score, np.array([1, 1, 2, 2, 3, 3]), np.array([1, 2, 3]))
    assert 1.3 < low < 1.8 and 2.0 < high < 2.9


def test_levels(spark):
    rnd = random.Random(3)
    docs = [(i, document(1 + i % 4, rnd), f"s{i % 7}") for i in range(240)]
    extra = [(900, None, "s"), (901, "", "s"), (902, "too short to tell", None), (903, document(1, rnd), None), (None, document(2, rnd), "s")]
    ratings = [(i, max(1, min(4, 1 + i % 4 + (rnd.random() < 0.05)))) for i in range(160)] + [(5, None), (99_999, 2)]
    d = spark.createDataFrame(docs + extra + [docs[0]], "doc_id long, text string, source string").selectExpr("*", "1 AS words", "2 AS features")
    r = spark.createDataFrame(ratings, "doc_id long, grade int")
    rows = reading.levels(d, "doc_id", "text", "source", r).collect()
    got = {x.doc_id: x.level for x in rows}
    assert set(got) == set(range(240)) | {903}
    held = [got[i] == 1 + i % 4 for i in range(160, 240)]
    assert np.mean(held) > 0.8 and all(abs(got[i] - (1 + i % 4)) <= 1 for i in range(160, 240))
    assert reading.levels(d, "doc_id", "text", "source", r.limit(0)).count() == 0
    assert reading.levels(d.limit(0), "doc_id", "text", "source", r).count() == 0


def test_features_ignore_code():
    words, features = reading.describe("The cache reads the queue.\n\n```\n$ run --x=1 a/b_1.sql\n```\n")
    assert words == 5 and len(features) == len(reading.FEATURES)
    assert reading.describe("$ run --x=1 a/b_1.sql")[1] is None and reading.describe("") == (0, None)


def test_agreement_is_reported_by_source(spark):
    rnd = random.Random(5)
    docs = [(i, document(1 + i % 4, rnd), f"s{i % 7}") for i in range(160)] + [(900, document(1, rnd), None), (901, None, "s1")]
    ratings = [(i, 1 + i % 4) for i in range(160)] + [(900, 1), (901, 3), (99_999, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS grade")
    r = spark.createDataFrame(ratings, "doc_id long, grade int")
    got = {x.source: x for x in reading.agreement(d, "doc_id", "text", "source", r).collect()}
    assert set(got) == {f"s{k}" for k in range(7)} | {None} and sum(x.rated for x in got.values()) == 161
    assert all(x.right <= x.rated and abs(x.share - x.right / x.rated) < 1e-9 for x in got.values())
    assert sum(x.right for x in got.values()) > 0.75 * 161
    assert reading.agreement(d, "doc_id", "text", "source", r.limit(0)).count() == 0
