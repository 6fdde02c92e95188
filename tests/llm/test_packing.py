import random

from strataweave.llm import packing


def test_fullest_is_optimal():
    rnd = random.Random(1)
    for _ in range(150):
        room = rnd.randrange(1, 60)
        lengths = sorted(rnd.sample(range(1, 40), 6), reverse=True)
        left = [rnd.randrange(0, 4) for _ in lengths]
        sums = {0}
        for x, n in zip(lengths, left):
            sums = {s + k * x for s in sums for k in range(n + 1)}
        used = packing.fullest(room, lengths, left)
        assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= left[lengths.index(x)] for x, n in used.items())


def test_pack_places_everything_once_within_capacity(spark):
    rnd = random.Random(2)
    sizes = [(i, rnd.choice([0, 5, 5, 5, 5, rnd.randrange(1, 90), rnd.randrange(100, 350)])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    budgets = spark.createDataFrame([(1, 100, "a"), (2, 64, "b"), (3, None, "c"), (4, 0, "d")], "budget_id int, capacity int, label string")
    got = packing.pack(df, budgets, per_part=4).collect()
    for budget, capacity in ((1, 100), (2, 64)):
        rows = [r for r in got if r.budget_id == budget]
        whole = {}
        for r in rows:
            whole.setdefault(r.doc_id, []).append(r)
        assert set(whole) == {i for i, _ in sizes}
        for i, n in sizes:
            assert sum(r.tokens for r in whole[i]) == n
            assert sorted(r.part_no for r in whole[i]) == list(range(1, len(whole[i]) + 1))
            assert len(whole[i]) == max(1, -(-n // capacity))  # divided only when it alone exceeds the capacity
        bins = {}
        for r in rows:
            if r.bin_no:
                bins[r.bin_no] = bins.get(r.bin_no, 0) + r.tokens
        assert max(bins.values()) <= capacity and set(bins) == set(range(1, len(bins) + 1))
        assert sum(bins.values()) / (len(bins) * capacity) > 0.97
    assert {r.budget_id for r in got} == {1, 2}
    report = packing.fill(packing.pack(df, budgets), budgets).collect()
    assert all(r.bins >= r.least_bins for r in report)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, tokens long")
    budgets = spark.createDataFrame([(1, 100)], "budget_id int, capacity int")
    assert packing.pack(df, budgets).count() == 0


def test_token_counts(spark, tmp_path):
    import base64

    vocabulary = tmp_path / "bytes.tiktoken"
    vocabulary.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    rows = [(1, "abc d"), (2, ""), (3, None), (4, "x\n" * 150_000), (None, "abc")]
    got = {r.doc_id: r.tokens for r in packing.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", str(vocabulary)).collect()}
    assert got == {1: 5, 2: 0, 4: 300_000}


def test_long_texts_are_cut_where_no_token_reaches_across():
    import os
    import random

    import pytest

    if not os.path.exists(packing.TOKENIZER):
        pytest.skip("the vocabulary is not here")
    enc, rnd = packing.encoder(packing.TOKENIZER, packing.PATTERN), random.Random(3)
    kept, packing.SLICE = packing.SLICE, 40
    try:
        for _ in range(300):
            text = "".join(rnd.choice(["a", "word", "  ", " ", "\n", "'s", "'", "12", "é", "…", "\t", "\u00a0", "!?", " \n "]) for _ in range(200))
            slices = list(packing._slices(text, packing.PATTERN))
            assert "".join(slices) == text and sum(len(enc.encode_ordinary(s)) for s in slices) == len(enc.encode_ordinary(text))
        assert list(packing._slices("x" * 100, packing.PATTERN)) == ["x" * 100] and list(packing._slices("x y" * 100, "other")) == ["x y" * 100]
    finally:
        packing.SLICE = kept
