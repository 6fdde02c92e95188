import random

from strataweave.llm import leakage


def make(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(words, k=50))) for i in range(20)]
    docs, want = [], set()

    def text(n):
        return [rnd.choice(words) for _ in range(n)]

    for d in range(300):
        body = text(rnd.randrange(0, 80))
        kind = rnd.randrange(4)
        if kind:
            k = rnd.randrange(20)
            source = items[k][1].split()
            n = rnd.choice([8, 11]) if kind == 1 else rnd.randrange(20, 51)
            at = rnd.randrange(0, 51 - n)
            part = source[at : at + n]
            if kind == 3:  # one word in ten changed, dropped or added, well inside
                for j in range(12, len(part) - 5, 14):
                    rnd.choice([lambda: part.__setitem__(j, "zz"), lambda: part.pop(j), lambda: part.insert(j, "zz")])()
            body = body + [("«" + w.upper() + "»,\n> ") if kind == 2 else w for w in part] + text(rnd.randrange(30))
            if kind > 1:
                want.add((d, k))
        docs.append((d, " ".join(body)))
    return items, docs, want


def test_planted_passages_are_found(spark):
    for seed in (1, 2):
        items, docs, want = make(seed)
        d = spark.createDataFrame(docs + [(900, None), (901, ""), (None, items[0][1])], "doc_id long, text string")
        i = spark.createDataFrame(items + [(77, "too short"), (78, None)], "item_id long, text string")
        got = [tuple(r) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        blocks = {tuple(r) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text", block=150).collect()}
        assert blocks == want
        small = {tuple(r) for r in leakage.leaks(d, "doc_id", "text", i, "item_id", "text", shard=200).collect()}
        assert small == want
        assert leakage.leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
        assert leakage.leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_phrase_hits_equal_brute_force():
    rnd = random.Random(5)
    docs = [[rnd.choice("abcdef") for _ in range(rnd.randrange(0, 40))] for _ in range(30)]
    items = [(i, [rnd.choice("abcdef") for _ in range(15)]) for i in range(4)]
    probes = leakage.Probes(items)
    index = leakage.ShardIndex.of_documents(docs, probes.terms)
    p, item, q = index.phrase_hits(probes)
    got = sorted(zip(p.tolist(), item.tolist(), q.tolist()))
    want = sorted(
        (int(index.start[d]) + j, k, m)
        for d, ws in enumerate(docs)
        for j in range(len(ws) - 3)
        for k, (_, it) in enumerate(items)
        for m in range(len(it) - 3)
        if ws[j : j + 4] == it[m : m + 4]
    )
    assert got == want


def test_edit_limit():
    item = list(range(50))
    assert leakage.reproduces(item, item[3:18], 15, 10)
    assert not leakage.reproduces(item, item[3:17], 15, 10)
    assert leakage.reproduces(item, [*item[:9], 99, *item[10:21]], 15, 10)
    assert not leakage.reproduces(item, [*item[:5], 99, *item[6:11], 98, *item[12:16]], 15, 10)
