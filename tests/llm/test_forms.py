import random

from strataweave.llm import forms

TWINS = {"a": "аａ", "e": "еｅ", "o": "оοｏ", "p": "рｐ", "c": "сｃ", "i": "іｉ", "T": "ТΤＴ", "é": ["é", "ｅ́"], " ": "   ", "-": "‐‑"}


def disguise(text, rnd):
    out = []
    for ch in text:
        if ch in TWINS and rnd.random() < 0.4:
            ch = rnd.choice(TWINS[ch])
        out.append(ch + (rnd.choice(["​", "﻿", "­", "⁠"]) if rnd.random() < 0.05 else ""))
    return "".join(out).replace("fi", "ﬁ" if rnd.random() < 0.5 else "fi")


def test_table_form_undoes_disguises_and_keeps_what_is_visible():
    rnd = random.Random(4)
    for text in ["The café first opened at noon - twice", "a plain text", "Tiefe Ordnung, Operation file-copy", ""]:
        for _ in range(40):
            assert forms.table_form(disguise(text, rnd)) == text
    assert forms.table_form("e") != forms.table_form("é") and forms.table_form("A") != forms.table_form("a")
    assert forms.table_form("wait … Ⅳ") == "wait ... IV"
    assert forms.table_form("x²") == "x²" and forms.table_form("сосна") == forms.table_form("coсна")


def test_trie_walk():
    trie = forms.Trie()
    for w, n in (("cafe", 3), ("café", 9), ("сор", 2), ("file", 5)):
        trie.add(w, n)
    assert forms.choose(trie.walk("сａfe")) == "cafe"
    assert forms.choose(trie.walk("c​afе́")) == "café"
    assert forms.choose(trie.walk("ﬁle")) == "file"
    assert forms.choose(trie.walk("cop")) == "сор"
    assert trie.walk("cave") == [] and {w for _, w, _ in trie.walk("cave", budget=1)} == {"cafe"}
    assert trie.walk("cafe", budget=0.5) and {w for _, w, _ in trie.walk("cafe", budget=0.5)} == {"cafe", "café"}
    assert {w for _, w, _ in trie.walk("fle", budget=1)} == {"file"} and {w for _, w, _ in trie.walk("FILE", budget=2)} == {"file"}
    assert {w for _, w, _ in trie.walk("files", budget=1)} == {"file"} and forms.choose(trie.walk("ﬁlе", budget=2)) == "file"
    assert forms.choose([(0, "сор", 9), (0, "cop", 1)]) == "cop"


def test_alike_equals_brute_force(spark):
    rnd = random.Random(7)
    base = ["The café first opened at noon", "сосна на горе 5", "Ordnung - zwei Teile", "the cafe first opened at noon", "THE CAFÉ", ""]
    rows = []
    for i in range(120):
        text = rnd.choice(base)
        rows.append((rnd.choice(["x", "y"]), rnd.randrange(2), i, disguise(text, rnd) if rnd.random() < 0.5 else text))
    rows += [("x", 0, 900 + i, base[0]) for i in range(40)] + [("x", 0, 950, None), (None, 0, 951, base[0])]
    lost = [("x", 0, None, base[0]), ("x", 0, None, disguise(base[0], rnd))]
    want = {
        (t, a, b)
        for t, s, a, x in rows
        for t2, s2, b, y in rows
        if t is not None and (t, s) == (t2, s2) and a < b and None not in (x, y) and x != y and forms.table_form(x) == forms.table_form(y)
    }
    df = spark.createDataFrame(rows + lost, "tab string, scope_id int, id long, text string").withColumnRenamed("text", "form")
    got = [(r.tab, r.id_a, r.id_b) for r in forms.alike(df, ["tab", "scope_id"], "id", "form").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert forms.alike(df.limit(0), ["tab", "scope_id"], "id", "form").count() == 0


def test_canonical_keeps_rows_and_columns(spark):
    rows = [(1, "thе сafé", 1), (2, None, 2), (3, "", 3), (4, "the café", 4), (4, "the café", 4), (5, "белуга б", 5), (6, "x" * 100_000 + " ｙ", 6)]
    got = {(r.id, r.form) for r in forms.canonical(spark.createDataFrame(rows, "id long, text string, words int"), ["id"], "text").collect()}
    assert got == {(1, "the café"), (2, None), (3, ""), (4, "the café"), (5, "белуга б"), (6, "x" * 100_000 + " y")}


def test_the_trie_decides_where_the_table_would_err(spark):
    """A word of another script keeps its letters while nobody writes it in Latin ones; a budget joins accents behind the first letters."""
    rows = [(1, "сор на горе", 1), (2, "coр", 1), (3, "resumé", 1), (4, "resume resume", 1), (5, "rеsumé", 1)]
    df = spark.createDataFrame(rows, "id long, text string, words int")
    got = {r.id: r.form for r in forms.canonical(df, ["id"], "text").collect()}
    assert got[1].startswith("сор") and forms.table_form("сор") == "cop" and got[2] == "сор" and got[3] == got[5] == "resumé"
    loose = {r.id: r.form for r in forms.canonical(df, ["id"], "text", budget=0.5).collect()}
    assert loose[5] in ("resume", "resumé") and loose[1] == got[1]


def test_classes_count_members(spark):
    rows = [("x", 0, i, t) for i, t in enumerate(["the café", "thе cafe\u0301", "the café", "other", None])]
    df = spark.createDataFrame(rows, "tab string, scope_id int, id long, text string")
    assert sorted(tuple(r) for r in forms.classes(df, ["tab", "scope_id"], "id", "text").collect()) == [("x", 0, i, 0, 3) for i in range(3)]
