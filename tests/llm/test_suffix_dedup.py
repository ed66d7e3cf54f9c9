import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.suffix_dedup import _matches, _neighboured, leftmost_least, remove_copies, repeated_spans, super_suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def brute(texts, L):
    """Words of each document that lie in a repeated window, and those in a window that is not its first occurrence."""
    seen = defaultdict(list)
    for i, t in sorted((i, t) for i, t in texts if t):
        w = t.split()
        for p in range(len(w) - L + 1):
            seen[tuple(w[p : p + L])].append((i, p))
    first, copy = defaultdict(set), defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for n, (i, p) in enumerate(sorted(places)):
                (copy if n else first)[i] |= set(range(p, p + L))
    return first, copy


def covered(rows):
    first, copy = defaultdict(set), defaultdict(set)
    for r in rows:
        (copy if r.is_copy else first)[r.doc_id] |= set(range(r.start_word, r.start_word + r.n_words))
    return first, copy


def test_exact_on_random_texts(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 90))] for _ in range(25)]
    passage = [f"p{i}" for i in range(23)]
    texts = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(4) : 19 + rng.randrange(5)]
        texts.append((i, " ".join(w)))
    texts += [(100, "a b " * 40), (101, None), (102, ""), (103, " \n\t"), (104, "short one")]
    for L, k in ((12, 4), (16, 8), (20, 8)):
        got = covered(repeated_spans(frame(spark, texts), L, k).collect())
        want = brute(texts, L)
        assert {k: v for k, v in got[0].items() if v} == dict(want[0])
        assert {k: v for k, v in got[1].items() if v} == dict(want[1])


def test_first_occurrence_across_copied_contexts(spark):
    p = [f"p{i}" for i in range(16)]
    around = lambda n: " ".join([*(f"{n}l{i}" for i in range(20)), *p, *(f"{n}r{i}" for i in range(20))])
    texts = [(1, around("a")), (2, around("a")), (3, around("b")), (4, around("b")), (5, "x y z " * 30), (6, "x y z " * 30)]
    got = covered(repeated_spans(frame(spark, texts), 12, 4).collect())
    want = brute(texts, 12)
    assert got[0] == want[0] and got[1] == want[1]


def test_removal(spark):
    p = " ".join(f"q{i}" for i in range(60))
    docs = frame(spark, [(1, f"one {p}\nend"), (2, f"two  {p} tail é"), (3, p), (4, None), (5, ""), (6, "clean text"), (7, p), (8, " \n")])
    got = {r.doc_id: r for r in remove_copies(docs).collect()}
    assert got[1].text == f"one {p}\nend" and got[2].text == "two   tail é" and got[2].n_chars == 12
    assert 3 not in got and 7 not in got and got[4].text is None and got[5].text == "" and got[6].text == "clean text" and got[8].text == " \n"
    assert got[6].lang == "en" and remove_copies(docs.limit(0)).count() == 0
    rows = repeated_spans(docs).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.is_copy) for r in rows} == {(1, 1, 60, 1, False), (2, 1, 60, 1, True), (3, 0, 60, 1, True), (7, 0, 60, 1, True)}


def test_repeated_rows_and_clashing_columns(spark):
    p = " ".join(f"r{i}" for i in range(55))
    docs = frame(spark, [(1, p), (1, p), (2, "x " + p)]).selectExpr("*", "1 AS pos", "'z' AS context", "2 AS n", "3 AS kgram", "4 AS cuts_")
    assert {(r.doc_id, r.is_copy) for r in repeated_spans(docs).collect()} == {(1, False), (2, True)}
    assert remove_copies(docs).columns == docs.columns
    differ = frame(spark, [(1, "b " + p), (1, "a"), (2, "x " + p), (2, "y " + p + " longer at the end"), (3, "w " + p)])
    assert {(r.doc_id, r.is_copy) for r in repeated_spans(differ).collect()} == {(2, False), (3, True)}
    assert sorted(r.text for r in remove_copies(differ).collect() if r.doc_id < 3) == sorted(["b " + p, "a", "x " + p, "y " + p + " longer at the end"])
    anonymous = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars", "'c' AS cuts", "1 AS context")
    both = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit("c").alias("cuts"), F.lit(1).alias("context")).unionByName(anonymous)
    assert {r.doc_id for r in repeated_spans(both).collect()} == {1, 2}
    assert sorted(r.n_chars for r in remove_copies(both).where("doc_id is null").collect()) == sorted(r.n_chars for r in docs.collect())


def test_leftmost_least():
    rng = np.random.default_rng(2)
    for w in (1, 2, 3, 7, 8, 43):
        g = rng.integers(0, 9, 200).astype(np.uint64)
        assert leftmost_least(g, w).tolist() == [i + int(g[i : i + w].argmin()) for i in range(200 - w + 1)]


def test_minimisers_of_texts_beyond_2_24_words():
    """The same passage far behind in a very long text has the same suffixes, whole."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**63, 80, dtype=np.uint64)
    far = np.concatenate([np.full((1 << 24) + 1000, 7, np.uint64) + np.arange((1 << 24) + 1000, dtype=np.uint64), passage])
    short = super_suffixes(passage, np.array([0, 80]), 50, 8)
    long = super_suffixes(far, np.array([0, len(far)]), 50, 8)
    assert set(short[3].tolist()) <= set(long[3].tolist())
    inner = {c for c, a, n in zip(short[4].tolist(), short[1].tolist(), short[2].tolist()) if a > 0}
    assert inner <= set(long[4].tolist()) and len(short[0]) >= 2 and int(long[1].max()) > 1 << 24


def pieces(rows, names, sizes):
    """Record batches of these sizes (and the rest)."""
    at = 0
    for n in [*sizes, len(rows)]:
        part = rows[at : at + n]
        at += n
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in part], pa.int64()) for c in range(len(names))], names)


def test_neighbours_in_batches_and_at_borders():
    rng = random.Random(7)
    for _ in range(300):
        keys = sorted(rng.randrange(9) for _ in range(rng.randrange(1, 30)))
        rows = [(k, i) for i, k in enumerate(keys)]
        got = [r["i"] for b in _neighboured(pieces(rows, ["k", "i"], [rng.randrange(6) for _ in range(5)])) for r in b.to_pylist()]
        want = [i for i, k in enumerate(keys) if keys.count(k) > 1 or k == keys[0] or i == len(keys) - 1]
        assert got == want
        rows = [(k, 5 + i, 3 * i, 70 + i, i) for i, k in enumerate(keys)]
        got = [r for b in _matches(pieces(rows, ["window", "doc_id", "pos", "context", "step"], [rng.randrange(6) for _ in range(5)])) for r in b.to_pylist()]
        assert [r["step"] for r in got] == want
        for r in got:
            at = keys.index(r["window"])
            assert (r["first_doc"], r["first_pos"], r["context"]) == (5 + at, 3 * at, 70 + r["step"])
            assert r["border"] == (r["window"] == keys[0] or r["step"] == len(keys) - 1)


def test_runs_across_many_ranges(spark):
    """One passage in most documents, over more ranges than it has windows."""
    rng = random.Random(8)
    p = [f"p{i}" for i in range(14)]
    texts = [(i, " ".join([*(f"l{rng.randrange(10**6)}" for _ in range(rng.randrange(9))), *p, *(f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(9)))])) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, want = covered(repeated_spans(frame(spark, texts), 12, 4).collect()), brute(texts, 12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == want[0] and got[1] == want[1]
