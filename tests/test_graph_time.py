from pyspark.sql import functions as F

from strataweave.operators import graph, temporal

FACTS = [
    (1, 10, 11, "ci runs on node 22", 0, None, 5, None, 0),
    (2, 10, 12, "ci uses GitHub Actions", 100, 200, 100, 300, 4),
    (3, 13, 14, "api uses postgres", None, None, 50, None, 0),
    (4, None, 10, None, 20, None, 20, None, 0),
    (5, 10, 10, "ci is ci", 30, None, 30, None, 0),
]
SCHEMA = "id long, src long, dst long, statement string, valid_from long, valid_to long, recorded_at long, invalidated_at long, hits long"


def frames(spark):
    n = spark.createDataFrame([(10, "ci", 5), (11, "node 22", 1), (12, "GitHub Actions", 1), (13, "api", 1), (14, "postgres", 1), (15, "alone", 0)], "id long, name string, degree long")
    return spark.createDataFrame(FACTS, SCHEMA), n


def test_as_of(spark):
    f, _ = frames(spark)
    ids = lambda t: {r.id for r in f.where(temporal.as_of(t)).collect()}
    assert ids(1) == set() and ids(60) == {1, 3, 4, 5} and ids(150) == {1, 2, 3, 4, 5} and ids(200) == {1, 3, 4, 5}
    assert {r.id for r in f.where(temporal.live()).collect()} == {1, 3, 4, 5}


def test_neighbors_and_exclusion(spark):
    f, n = frames(spark)
    asked = spark.createDataFrame([(1, 10)], "group long, entity long")
    none = spark.createDataFrame([], "group long, id long")
    got = graph.neighbors(f, n, asked, none).orderBy("rank").collect()
    assert [r.id for r in got] == [2, 5, 4, 1]
    without = spark.createDataFrame([(1, 2)], "group long, id long")
    assert {r.id for r in graph.neighbors(f, n, asked, without).collect()} == {1, 4, 5}


def test_timeline_degrees_orphans(spark):
    f, n = frames(spark)
    asked = n.where("id = 12").select(F.col("id").alias("entity"), "name")
    lines = [r.line for r in graph.timeline(f, asked).collect()]
    assert lines == ["1970-01-01 → 1970-01-01  ci uses GitHub Actions"]
    found = {tuple(r) for r in graph.mentions(f, spark.createDataFrame([(1, "GITHUB actions"), (2, "x%"), (3, " "), (4, None)], "entity long, name string")).collect()}
    assert found == {(1, 2)}
    assert {(r.entity, r.degree) for r in graph.degrees(f).collect()} == {(10, 5), (11, 1), (12, 1), (13, 1), (14, 1)}
    assert [r.id for r in graph.orphans(n, f).collect()] == [15]


def test_read_set(spark):
    s = spark.createDataFrame([(1,), (2,)], "id long")
    assert {tuple(r) for r in temporal.read_set(s).collect()} == {(1, 1), (2, 2), (2, 1)}


def test_resolved_keeps_facts_without_ends(spark):
    f, n = frames(spark)
    f = f.withColumn("episode_id", F.lit(None).cast("long"))
    e = spark.createDataFrame([], "id long, source string, head string")
    rows = {r.id: (r.src_name, r.dst_name) for r in temporal.resolved(f, n, e).collect()}
    assert rows[4] == (None, "ci") and rows[1] == ("ci", "node 22") and len(rows) == 5
