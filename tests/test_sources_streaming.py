import json

from pyspark.sql import functions as F

from strataweave.sources import files, snapshot, transfer
from strataweave.streaming import prompts


def test_snippets(spark, tmp_path):
    (tmp_path / "a.py").write_text("\n".join(f"line {i}" for i in range(1, 101)))
    (tmp_path / "b.txt").write_text("x" * 3000)
    (tmp_path / "c.md").write_text("one\ntwo")
    (tmp_path / "d.rs").write_text("")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows["a.py"].lang == "python" and rows["a.py"].line_to == 60 and rows["a.py"].snippet.endswith("line 60\n… (truncated)")
    assert rows["b.txt"].line_to == -1 and rows["b.txt"].snippet == "x" * 2000 + "\n… (truncated)"
    assert rows["c.md"].snippet == "one\ntwo" and "d.rs" not in rows
    asked = spark.createDataFrame([(str(tmp_path / "a.py"), 10, 12)], "path string, line_from long, line_to long")
    part = [r for r in files.read_files(spark, str(tmp_path / "a.py"), asked).collect()][0]
    assert part.snippet == "line 10\nline 11\nline 12\n… (truncated)" and (part.line_from, part.line_to) == (10, 12)


def test_index_snapshot_is_read_under_its_version_only(spark, tmp_path):
    v = spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "id long, q array<tinyint>")
    version = snapshot.content_version(v)
    assert version == snapshot.content_version(v.orderBy(F.desc("id")))
    assert version != snapshot.content_version(v.where("id = 1"))
    snapshot.write_index(v, str(tmp_path / "index"), version)
    assert snapshot.read_index(spark, str(tmp_path / "index"), version, 2).count() == 2
    assert snapshot.read_index(spark, str(tmp_path / "index"), "other") is None
    assert snapshot.read_index(spark, str(tmp_path / "index"), version, 3) is None
    old = spark.createDataFrame([(1, 1, [1]), (1, 2, [2])], "kind int, ref_id long, q array<tinyint>")
    new = spark.createDataFrame([(1, 2, [9]), (2, 1, [7])], "kind int, ref_id long, q array<tinyint>")
    assert {(r.kind, r.ref_id, *r.q) for r in snapshot.upsert(old, new).collect()} == {(1, 1, 1), (1, 2, 9), (2, 1, 7)}


def test_export_import_round_trip(spark, tmp_path):
    scopes = spark.createDataFrame([(1, "global"), (2, "p:x")], "id long, key string")
    episodes = spark.createDataFrame([(5, 2, "cli", "note", "body", None, b"\x01\x02", None, 7), (6, 2, "cli", "note", "body", None, b"\x01\x02", "h", 8)], "id long, scope_id long, source string, kind string, body string, meta string, hash binary, head string, recorded_at long")
    facts = spark.createDataFrame([(1, 2, "a", "uses", "b", "a uses b", 1.0, 1, None, 2, None, 6), (2, 2, "a", "uses", None, "old", 1.0, 1, 2, 2, 3, 5)], "id long, scope_id long, src_name string, rel string, dst_name string, statement string, confidence double, valid_from long, valid_to long, recorded_at long, invalidated_at long, episode_id long")
    transfer.write_export(transfer.export_lines(scopes, episodes, facts), str(tmp_path / "out"))
    lines = transfer.read_export(spark, str(tmp_path / "out"))
    assert lines.count() == 4
    empty = spark.createDataFrame([], "scope_key string, hash binary, id long")
    ids = transfer.episode_ids(lines, empty, 100)
    e = transfer.import_episodes(lines, ids).collect()
    assert len(e) == 1 and e[0].body == "body" and bytes(e[0].hash) == b"\x01\x02" and e[0].id >= 100
    f = transfer.import_facts(lines, ids).collect()
    assert [(r.statement, r.episode_id) for r in f] == [("a uses b", e[0].id)]
    known = spark.createDataFrame([("p:x", b"\x01\x02", 55)], "scope_key string, hash binary, id long")
    ids = transfer.episode_ids(lines, known, 100)
    assert {(r.id, r.known) for r in ids.collect()} == {(55, True)} and transfer.import_episodes(lines, ids).count() == 0


def test_prompt_stream_keeps_each_prompt_once(spark, tmp_path):
    source = tmp_path / "in"
    rows = [(1, 1, "Never push to the main branch."), (2, 1, "never push to the MAIN branch"), (3, 1, "ok"), (4, 2, "Never push to the main branch."), (5, 1, "the password is hunter2-abc for now")]
    spark.createDataFrame(rows[:3], "id long, scope_id long, body string").write.parquet(str(source / "a"))
    read = lambda: spark.readStream.schema("id long, scope_id long, body string").parquet(str(source / "*"))
    for _ in range(2):
        prompts.run(read(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame(rows[1:], "id long, scope_id long, body string").write.parquet(str(source / "b"))
    prompts.run(read(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.scope_id, r.salient) for r in got if r.masked == 0) == [(1, "constraint"), (2, "constraint")]
    assert [r.body for r in got if r.masked] == ["the password is [redacted] for now"]


def test_current_values_and_drain(spark, tmp_path):
    rows = [(1, "a", "uses", "npm", 1, 10), (1, "a", "uses", "pnpm", 2, 20), (1, "b", "uses", "git", 3, 5)]
    schema = "scope_id long, src string, rel string, hash string, id long, ts long"
    spark.createDataFrame(rows[:2], schema).write.parquet(str(tmp_path / "in" / "a"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    seen = []

    def keep(batch, _):
        seen.extend(tuple(r) for r in batch.collect())

    def go():
        q = prompts.current_values(stream()).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    go()
    spark.createDataFrame(rows[2:] + [(1, "a", "uses", "pnpm", 4, 30)], schema).write.parquet(str(tmp_path / "in" / "b"))
    go()
    assert seen[0] == (1, "a", "uses", "pnpm", 20, 2) and set(seen[1:]) == {(1, "a", "uses", "pnpm", 20, 2), (1, "b", "uses", "git", 5, 1)}
    counts = []
    prompts.drain(stream(), lambda batch, _: counts.append(batch.count()), str(tmp_path / "d")).awaitTermination()
    assert sum(counts) == 4


def test_prompt_text(spark):
    raw = [json.dumps({"prompt": "hi", "x": 1}), json.dumps({"message": "m"}), "plain words", "{broken", None]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "value string").select(prompts.prompt_text()).collect()]
    assert got == ["hi", "m", "plain words", None, None]
