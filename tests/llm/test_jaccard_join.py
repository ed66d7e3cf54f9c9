import random

from claimloom.operators.components import components
from claimloom.llm.jaccard_join import keep_one, least_agreements, near_duplicates

SCHEMA = "doc_id long, text string"


def brute(texts, t=0.8):
    sets = {}
    for i, x in texts:
        w = (x or "").lower().split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], find(i)) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts, n = [], 0
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 3, 25])):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            texts.append((n, (" ", "\n", "  ")[rng.randrange(3)].join(w).replace("w1", rng.choice(["w1", "W1"]))))
            n += 1
    texts += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "long " * 20000), (1006, "long " * 20001)]
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == brute(texts)


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr("claimloom.llm.jaccard_join.SIDE", 7)
    rng, base = random.Random(1), [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(120)] = f"x{i}"
        texts.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == brute(texts)


def test_keep_one_and_repeats(spark):
    p = " ".join(f"a{i}" for i in range(40))
    docs = spark.createDataFrame([(5, p, 1), (3, p, 2), (3, p, 2), (9, "other words", 3), (10, None, 4), (11, None, 5), (None, p, 6), (None, p, 7)], "doc_id long, text string, cls int")
    assert sorted((r.doc_id or 0, r.cls) for r in keep_one(docs).collect()) == [(0, 6), (0, 7), (3, 2), (9, 3), (10, 4), (11, 5)]
    assert [(r.class_id, r.n_links) for r in near_duplicates(docs).where("doc_id is null").collect()] == [(None, 0)]
    assert keep_one(docs).columns == docs.columns and near_duplicates(docs.limit(0)).count() == 0


def test_pruning_bounds():
    for n, m in least_agreements(0.8):
        assert 0 < m < 0.8 * n + 1


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(e.limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    p, q = " ".join(f"a{i}" for i in range(40)), " ".join([*(f"a{i}" for i in range(39)), "z"])
    rows = [(1, p, "x"), (7, p, "x"), (7, "a text of its own", "y"), (7, "a  Text of its own", "z"), (8, q, "x"), (9, None, "n"), (9, None, "n"), (9, "", "n"), (5, "one", "b"), (5, "one", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seq string")
    got = sorted((r.doc_id, r.text or "", r.seq) for r in keep_one(docs).collect())
    assert got == [(1, p, "x"), (5, "one", "a"), (7, "a  Text of its own", "z"), (9, "", "n"), (9, "", "n"), (9, "", "n")]
    near = spark.createDataFrame([(1, p, "x"), (1, q, "x")], docs.schema)  # near copies under one id: one stays
    assert keep_one(near).count() == 1 and keep_one(docs.limit(0)).count() == 0 and keep_one(docs).columns == docs.columns


def test_families_find_the_links_of_every_band(spark, monkeypatch):
    """Pairs that agree in different bands meet once, whatever the families."""
    monkeypatch.setattr("claimloom.llm.jaccard_join.SIDE", 3)
    rng, texts = random.Random(9), []
    for i in range(90):
        w = [f"w{k}" for k in range(60)]
        for _ in range(rng.randrange(4)):
            at = rng.randrange(60)
            w[at : at + rng.randrange(3)] = [f"y{rng.randrange(6)}"]
        texts.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == brute(texts)


def test_near_copies_of_long_texts_are_dealt_by_bytes(spark, monkeypatch):
    """Blocks of few bytes: many jobs for one family, the same links."""
    monkeypatch.setattr("claimloom.llm.jaccard_join.SIDE_BYTES", 20_000)
    base = [f"w{k % 3000}" for k in range(4000)]
    texts = [(i, " ".join([*base[: 100 * i], f"x{i}", *base[100 * i + 1 :]])) for i in range(24)] + [(100, "quite other words than those of the rest here")]
    got = {r.doc_id: (r.n_links, r.class_id) for r in near_duplicates(spark.createDataFrame(texts, SCHEMA)).collect()}
    assert got == {**{i: (23, 0) for i in range(24)}, 100: (0, 100)}
