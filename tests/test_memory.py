from pyspark.sql import functions as F

from strataweave.functions import registered
from strataweave.operators import fusion, render, temporal, vectors, writes
from strataweave.sources import transcripts, transfer
from strataweave.streaming import prompts

DAY = 86_400_000


def test_remember(spark):
    notes = spark.createDataFrame(
        [(1, 1, "note", "  The cache is cold. ", 10, True), (2, 1, "note", "the cache  is cold", 20, True), (3, 1, "decision", "we use `Quill` with `core/a.md`", 30, True), (4, 2, "note", "the cache is cold", 5, False), (5, 1, "note", "  ", 40, True), (6, 1, "note", "known", 50, False)],
        "note_id long, scope_id long, kind string, body string, recorded_at long, derive boolean",
    ).withColumn("id", F.lit(0))
    given = spark.createDataFrame([(2, 7, "cache", "is", "cold", "cache is cold", None, None, 0.5, None), (6, 8, None, "uses", "x", "s", 1, 2, 1.0, True)], "note_id long, seq long, src string, rel string, dst string, statement string, valid_from long, valid_to long, confidence double, supersede boolean")
    key = writes.with_identity(spark.createDataFrame([(99, 1, "Known!")], "id long, scope_id long, body string")).withColumnRenamed("key", "hash")
    episodes, facts = writes.remember(notes, given, key.select("id", "scope_id", "hash"))
    assert sorted((r.id, r.scope_id, r.body) for r in episodes.collect()) == [(1, 1, "The cache is cold."), (3, 1, "we use `Quill` with `core/a.md`"), (4, 2, "the cache is cold")]
    got = sorted((r.note_id, r.episode_id, r.rel, r.src, r.over, r.derived) for r in facts.collect())
    # a repeated note's facts belong to the first; a known one's to the known episode; derived facts never supersede
    assert got == [(1, 1, "relates_to", None, False, True), (2, 1, "is", "cache", True, False), (3, 3, "decided", "Quill", False, True), (6, 99, "uses", None, False, False)]
    none = writes.remember(notes.limit(0), given, key.select("id", "scope_id", "hash"))
    assert none[0].count() == none[1].count() == 0


def test_pack(spark):
    heads = spark.createDataFrame([(1, "## M\n"), (2, "## M\n"), (3, "## M\n"), (4, "## M\n")], "query_id long, head string")
    lines = spark.createDataFrame([(1, 1, 11, "- one two three four five six", 5), (1, 2, 12, "- b", None), (1, 3, 13, "- c c c c c c c c c c c", None), (4, 1, 14, "- " + "long " * 50, None)], "query_id long, pick int, id long, line string, episode_id long")
    refs = spark.createDataFrame([(5, "src/b.py", 3, 9), (5, "src/a.py", None, None), (5, "src/c.py", 2, 2)], "episode_id long, path string, line_from long, line_to long")
    shown = render.with_pointers(lines, refs).withColumn("line", F.concat("line", F.lit("\n"))).join(heads, "query_id")
    notes = spark.createDataFrame([(1, 1, "- (x) y\n"), (2, 1, "- (1970-01-01) raw\n"), (2, 2, "- " + "w " * 40 + "\n"), (2, 3, "- z\n"), (4, 1, "- raw\n")], "query_id long, rank int, note string")
    got = {r.query_id: r.text for r in render.pack(heads, shown, notes, 25).collect()}
    assert got[1] == "## M\n- one two three four five six\n    `src/a.py`\n    `src/c.py`:2\n    `src/b.py`:3–9\n- b\n- … 1 more memories not shown (raise the budget or narrow the query)\n\n### Raw notes\n"
    assert got[2] == "## M\n\n### Raw notes\n- (1970-01-01) raw\n"  # the second does not fit, and what follows is not looked at
    assert got[3] == "" and got[4].startswith("## M\n- long") and got[4].endswith("\n### Raw notes\n")


def test_last_requests(spark):
    line = '{"type":"%s","content":"%s"}'
    rows = [(1, 1, line % ("USER_INPUT", "a <USER_REQUEST> first </USER_REQUEST>")), (1, 2, line % ("USER_INPUT", "<USER_REQUEST>second</USER_REQUEST> b")), (1, 3, line % ("USER_INPUT", "<USER_REQUEST> </USER_REQUEST>")),
            (1, 4, line % ("TOOL", "<USER_REQUEST>no</USER_REQUEST>")), (1, 5, "no json"), (1, 6, None), (1, 7, line % ("USER_INPUT", "</USER_REQUEST>no<USER_REQUEST>")), (2, 1, "")]
    got = transcripts.last_requests(spark.createDataFrame(rows, "transcript long, line_no long, line string").withColumn("t", F.lit(1))).collect()
    assert [tuple(r) for r in got] == [(1, "second")]


def test_ranked_over_partitions(spark):
    rows = [(i * 7 % 1000, i) for i in range(1000)] + [(None, 5000)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = sorted((r.rank, r.a, r.b) for r in temporal.ranked(df, F.asc_nulls_first("a"), F.asc("b")).collect())
    assert [r[0] for r in got] == list(range(1, 1002)) and [r[1:] for r in got] == [(None, 5000)] + sorted(rows[:-1])
    assert temporal.ranked(df.limit(0), F.asc("a")).count() == 0


def _store(spark):
    f = [(1, 1, 1, 2, "the cache is cold at night", 1.0, None, None, 10, None, None, 0, 1), (2, 1, 1, 3, "the cache is cold at night", 1.0, None, None, 20, None, None, 4, 2), (3, 1, 4, None, "printers run on paper", 1.0, None, None, 30, None, None, 1, 3)]
    facts = spark.createDataFrame(f, "id long, scope_id long, src long, dst long, statement string, confidence double, valid_from long, valid_to long, recorded_at long, invalidated_at long, invalidated_by long, hits long, episode_id long")
    return facts, spark.createDataFrame([(i, 1) for i in range(1, 5)], "id long, degree long")


def test_consolidate(spark):
    facts, _ = _store(spark)
    queue = spark.createDataFrame([(3,), (1,), (2,)], "id long")
    after, done = writes.consolidate(facts, queue, 100, most=2)
    assert sorted(r.id for r in done.collect()) == [1, 2]
    got = {r.id: (r.hits, r.invalidated_at, r.invalidated_by, r.valid_to) for r in after.collect()}
    assert got == {1: (0, 100, 2, 100), 2: (4, None, None, None), 3: (1, None, None, None)}
    same, none = writes.consolidate(facts, queue.limit(0), 100)
    assert none.count() == 0 and same.where("invalidated_at IS NOT NULL").count() == 0


def test_prompts_are_answered_before_they_are_kept(spark, tmp_path):
    facts, entities = _store(spark)
    batch = spark.createDataFrame([(50, 1, "we decided that the cache is cold"), (51, 1, "ok"), (52, 1, "cold?"), (53, 1, None)], "id long, scope_id long, body string")
    picks, kept = prompts.answer_then_keep(batch, facts, entities, 100)
    found = {(r.query_id, r.id) for r in picks.collect()}
    assert {q for q, _ in found} == {50, 52} and (50, 2) in found or (50, 1) in found
    assert {r.id for r in kept.collect()} == {50}
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "queue"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "queue"))
    end = prompts.on_session_end(facts, 100)
    prompts.drain(stream, end, str(tmp_path / "state")).awaitTermination()
    assert sum(n for _, _, n in end.report) == 2
    assert {r.id for _, f, _ in end.report for r in f.where("invalidated_at IS NOT NULL").collect()} == {1}


def test_recall_brings_notes_and_files(spark):
    facts, entities = _store(spark)
    episodes = spark.createDataFrame([(1, 1, "cache notes", 5), (2, 1, "printers", 6), (3, 2, "cache elsewhere", 7)], "id long, scope_id long, body string, recorded_at long")
    refs = spark.createDataFrame([(1, "a/x.py", "python", 1, 2), (2, "a/y.py", "python", None, None), (9, "a/z.py", None, None, None)], "episode_id long, path string, lang string, line_from long, line_to long")
    queries = spark.createDataFrame([(7, "is the cache cold", 1)], "query_id long, text string, scope_id long")
    picks, notes, files = fusion.recall_all(queries, facts, entities, episodes, refs, 100)
    of = {1: 1, 2: 2, 3: 3}
    assert {r.path for r in files.collect()} == {p for e, p in ((1, "a/x.py"), (2, "a/y.py")) if e in {of[r.id] for r in picks.collect()}}
    assert 1 in {r.id for r in notes.collect()} and 3 not in {r.id for r in notes.collect()}


def test_reindex_and_its_guard(spark):
    texts = spark.createDataFrame([(1, 1, "a b"), (1, 2, None), (2, 1, "c")], "kind int, ref_id long, text string")
    index = vectors.reindex(texts, "m1")
    assert vectors.of_model(index, "m1", 64).count() == 3
    assert vectors.of_model(index, "m2", 64).count() == vectors.of_model(index, "m1", 32).count() == 0
    probes = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0])], "a array<double>, b array<double>")
    assert [tuple(r) for r in vectors.worst_cosine(probes).collect()] == [(2, 0.0)] and vectors.worst_cosine(probes.limit(0)).first().worst is None


def test_export_order_and_files(spark, tmp_path):
    scopes = spark.createDataFrame([(1, "global", "global", None), (2, "p:2", "two", "/x/two")], "id long, key string, label string, root string")
    episodes = spark.createDataFrame([(i, 1 + i % 2, "cli", "note", f"body {i // 2}", None, bytes([i // 2]), None, i) for i in range(6)], "id long, scope_id long, source string, kind string, body string, meta string, hash binary, head string, recorded_at long")
    facts = spark.createDataFrame([(1, 1, "a", "is", "b", "s", 1.0, None, None, 5, None, 2)], "id long, scope_id long, src_name string, rel string, dst_name string, statement string, confidence double, valid_from long, valid_to long, recorded_at long, invalidated_at long, episode_id long")
    files = spark.createDataFrame([(2, "a/b.py", "python", 4, 8), (3, "a/c.py", "python", None, None)], "episode_id long, path string, lang string, line_from long, line_to long")
    lines = transfer.export_lines(scopes, episodes, facts, files)
    transfer.write_export(lines, str(tmp_path / "out"))
    back = transfer.read_export(spark, str(tmp_path / "out"))
    assert sorted(r.json for r in back.collect()) == sorted(r.json for r in lines.collect())
    parts = [(r.scope_key, r.part, r.id) for r in transfer.in_order(lines).collect()]
    rank = {"envelope": 0, "episode": 1, "fact": 2, "file": 3}
    assert parts == sorted(parts, key=lambda p: (p[0], rank[p[1]], p[2])) and parts[0] == ("global", "envelope", 1)
    existing = spark.createDataFrame([("global", bytes([1]), 77)], "scope_key string, hash binary, id long")
    ids = transfer.episode_ids(back, existing, 1000)
    got = [(r.scope_key, r.path, r.line_from) for r in transfer.import_files(back, ids).collect()]
    assert got == [("p:2", "a/c.py", None)]  # the global episode is known and keeps its own files


def test_functions_in_sql(spark):
    assert set(registered.register(spark)) == {"normalize_text", "est_tokens", "cosine_q", "quantize", "salience", "redact", "extract_entities"}
    row = spark.sql("SELECT normalize_text(' A  b! ') a, est_tokens('one two three') b, quantize(array(3D, 4D)) c, cosine_q(quantize(array(3D, 4D)), quantize(array(3D, 4D))) d, redact('password=hunter22') e, extract_entities('see `Quill`') f, salience('we must never do that again') g, quantize(array(0D)) h").first()
    assert row.a == "a b" and row.b == 3 and row.c == [76, 102] and abs(row.d - 16180 / 16129) < 1e-9 and row.e == "password=[redacted]" and row.f == ["Quill"] and row.g == "constraint" and row.h == [0]
