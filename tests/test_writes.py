import random

from pyspark.sql import functions as F

from strataweave.operators import writes

SCHEMA = "scope_id long, src string, rel string, hash string, id long, ts long, valid_from long, valid_to long, confidence double, over boolean"


def one_by_one(rows):
    """Inserting fact by fact."""
    live, done = {}, []
    for scope, src, rel, h, i, ts, start, end, sure, over in sorted(rows, key=lambda r: (r[5], r[4])):
        facts = live.setdefault((scope, src, rel), {})
        if h in facts:
            facts[h]["rec"], facts[h]["sure"] = max(facts[h]["rec"], ts), max(facts[h]["sure"], sure)
            continue
        begin = ts if start is None else start
        if over:
            for f in facts.values():
                f.update(inv=ts, by=i, end=begin if f["end"] is None else f["end"])
                done.append(f)
            facts.clear()
        facts[h] = dict(scope=scope, src=src, rel=rel, hash=h, id=i, start=begin, end=end, rec=ts, sure=sure, inv=None, by=None)
    done += [f for facts in live.values() for f in facts.values()]
    return {tuple(f[k] for k in ("scope", "src", "rel", "hash", "id", "start", "end", "rec", "sure", "inv", "by")) for f in done}


def test_replay_equals_one_by_one(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = []
        for i in range(600):
            src = rnd.choice(["a", "b", "c", None])
            rel = rnd.choice(["uses", "knows", "mixed"])
            over = src is not None and (rel == "uses" or (rel == "mixed" and rnd.random() < 0.5))
            ts = rnd.randrange(400)
            rows.append((rnd.randrange(2), src, rel, rnd.choice("xyz"), i, ts, rnd.choice([None, ts - 5, ts]), rnd.choice([None, None, ts + 3]), rnd.choice([0.5, 1.0]), over))
        got = [tuple(r) for r in writes.replay(spark.createDataFrame(rows, SCHEMA)).collect()]
        assert len(got) == len(set(got)) and set(got) == one_by_one(rows)
        sharded = [tuple(r) for r in writes.replay(spark.createDataFrame(rows, SCHEMA), shards=30).collect()]
        assert sorted(map(str, sharded)) == sorted(map(str, got))
    assert writes.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_supersede_rule(spark):
    df = spark.createDataFrame([("uses", "a", None), ("Uses", "a", None), ("knows", "a", None), ("knows", "a", True), ("uses", "a", False), ("uses", None, True)], "rel string, src string, flag boolean")
    got = [r[0] for r in df.select(writes.supersedes(F.col("rel"), F.col("src"), F.col("flag"))).collect()]
    assert got == [True, True, False, True, False, False]


def test_first_episodes(spark):
    rows = [(1, 1, b"a", 5), (2, 1, b"a", 4), (3, 1, b"b", 1), (4, 2, b"a", 9)]
    df = spark.createDataFrame(rows, "id long, scope_id long, hash binary, recorded_at long")
    assert {r.id for r in writes.first_episodes(df).collect()} == {2, 3, 4}
    assert {r.id for r in writes.first_episodes(df, df.where("id = 4")).collect()} == {2, 3}


def test_resolve_by_alias_then_norm(spark):
    names = spark.createDataFrame([(1, "PostgreSQL "), (1, "pg"), (1, "other"), (2, "pg"), (1, None)], "scope_id long, name string")
    entities = spark.createDataFrame([(10, 1, "postgresql"), (11, 1, "pg")], "id long, scope_id long, norm string")
    aliases = spark.createDataFrame([(10, 1, "pg")], "entity_id long, scope_id long, norm string")
    got = {(r.scope_id, r.name): r.entity_id for r in writes.resolve_entities(names, entities, aliases).collect()}
    assert got == {(1, "PostgreSQL "): 10, (1, "pg"): 10, (1, "other"): None, (2, "pg"): None, (1, None): None}
    seq = names.withColumns({"seq": F.lit(1), "kind": F.lit(None).cast("string")})
    assert {(r.scope_id, r.norm) for r in writes.new_entities(seq, entities, aliases).collect()} == {(1, "other"), (2, "pg")}


def test_forget_purge_hits(spark):
    f = spark.createDataFrame([(1, None, None, 0, None), (2, 50, 40, 1, None), (3, 60, None, 2, 7)], "id long, valid_to long, invalidated_at long, hits long, last_hit long")
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    once = writes.forget(f, ids, 99)
    assert {(r.id, r.valid_to, r.invalidated_at) for r in once.collect()} == {(1, 99, 99), (2, 50, 40), (3, 60, None)}
    assert {(r.id, r.invalidated_at) for r in writes.forget(once, ids, 120).collect()} == {(1, 99), (2, 40), (3, None)}
    assert [r.id for r in writes.purge(f, ids).collect()] == [3]
    assert {(r.id, r.hits, r.last_hit) for r in writes.mark_hits(f, ids, 9).collect()} == {(1, 2, 9), (2, 2, 9), (3, 2, 7)}
    assert [r.id for r in writes.prunable(f.withColumn("hits", F.lit(0)), 100 * writes.DAY, 90).collect()] == [2]


def test_file_references(spark):
    df = spark.createDataFrame([(1, "see core/a_1.toml and `x/y.py`, core/a_1.toml again, not v1.2.3"), (2, None), (3, "")], "id long, body string")
    assert {tuple(r) for r in writes.file_references(df, "id", "body").collect()} == {(1, "core/a_1.toml", "rust"), (1, "x/y.py", "python")}
