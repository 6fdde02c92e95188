import hashlib

from pyspark.sql import functions as F

from strataweave.operators import render, scopes, tasks


def test_scope_of_path(spark):
    s = spark.createDataFrame([(1, None), (2, "/home/dev/app"), (3, "/home/dev/app/sub"), (4, "D:\\proj\\x")], "id long, root string")
    p = spark.createDataFrame([("/home/dev/app/a.rs",), ("/home/dev/app/sub/b.rs",), ("/home/dev/apple/c",), ("D:\\proj\\x\\y",), (None,), ("",)], "path string")
    got = {r.path: r.scope_id for r in scopes.scope_of_path(p, s).collect()}
    assert got == {"/home/dev/app/a.rs": 2, "/home/dev/app/sub/b.rs": 3, "/home/dev/apple/c": None, "D:\\proj\\x\\y": 4, None: None, "": None}
    keys = [tuple(r) for r in s.select(scopes.key_of_root(F.col("root")), scopes.label_of_root(F.col("root"))).collect()]
    assert keys[0] == ("global", "global") and keys[1] == ("p:" + hashlib.sha256(b"/home/dev/app").hexdigest()[:16], "app") and keys[3][1] == "x"


def test_task_states(spark):
    events = [
        (1, 10, "save", " first ", "ship it", ["a"], None),
        (1, 20, "done", None, None, None, "early"),
        (1, 30, "save", "second", None, ["b", "c"], None),
        (1, 40, "done", None, None, None, "all good"),
        (2, 5, "done", None, None, None, None),
        (3, 7, "save", "open", None, [], None),
    ]
    df = spark.createDataFrame(events, "scope_id long, ts long, action string, state string, goal string, files array<string>, note string")
    got = {r.scope_id: tuple(r)[1:] for r in tasks.current(df).collect()}
    assert got == {1: ("ship it", "second\n\n[closed] all good", ["b", "c"], 10, 30, True), 3: (None, "open", [], 7, 7, False)}
    note = tasks.current(df).where("scope_id = 1").select(tasks.as_note(F.col("goal"), F.col("state"), F.col("closed"))).first()[0]
    assert note == "[in-progress task]\ngoal: ship it\nsecond\n\n[closed] all good\n(status: closed)"


def test_render_keeps_to_the_budget(spark):
    lines = [(1, i, 100 + i, f"- {'word ' * 10}\n", "## Memory — x\n") for i in range(1, 41)] + [(2, 1, 7, f"- {'long ' * 200}\n", "## Memory — x\n")]
    df = spark.createDataFrame(lines, "query_id long, pick int, id long, line string, head string")
    got = {r.query_id: r for r in render.render(df, 60).collect()}
    assert got[1].text.startswith("## Memory — x\n- word") and got[1].text.endswith("more memories not shown (raise the budget or narrow the query)\n")
    assert got[1].ids == [101 + i for i in range(len(got[1].ids))] and 2 <= len(got[1].ids) < 6 and f"- … {40 - len(got[1].ids)} more" in got[1].text
    assert got[2].ids == [7]
    assert render.render(df.limit(0), 60).count() == 0


def test_pointers(spark):
    df = spark.createDataFrame([("a.rs", 3, 9), ("a.rs", 3, 3), ("a.rs", None, None), ("a.rs", 4, None)], "p string, a long, b long")
    got = [r[0] for r in df.select(render.pointer(F.col("p"), F.col("a"), F.col("b"))).collect()]
    assert got == ["`a.rs`:3–9", "`a.rs`:3", "`a.rs`", "`a.rs`:4"]
