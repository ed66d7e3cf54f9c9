import numpy as np

from claimloom.llm.ann import nearest, probe_order

QUERY = "vec_id % 20 = 0"


def exact(rows, top=20):
    good = {i: np.array(v, float) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(good))
    x, out = np.array([good[i] for i in ids]), {}
    for q in ids[ids % 20 == 0]:
        s = (x * good[q]).sum(1)
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:top]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=16) * rng.uniform(0.5, 2)).astype("f4").tolist()) for i in range(3000)]
    want, have = exact(rows), got(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), QUERY))
    assert set(have) == set(want) and all(len(v) == 20 for v in have.values())
    assert np.mean([len({i for i, _ in have[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    x = dict(rows)
    for q, found in have.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(i != q and abs(s - np.dot(np.array(x[q], float), np.array(x[i], float))) < 1e-9 for i, s in found)


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want, have = exact([(r.vec_id, list(r.embedding)) for r in df.collect()]), got(nearest(df, QUERY))
    assert np.mean([len({i for i, _ in have[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_invalid_equal_few_and_clashing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(i, rng.normal(size=2).tolist()) for i in range(100, 140)]
    rows += [(200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (None, [1.0, 2.0]), (260, [1.0, float("nan")]), (280, [1.0, float("inf")]), (300, []), (0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS bucket", "2 AS id", "3 AS vector")
    for block in (4096, 16):
        have, want = got(nearest(df, QUERY, block=block)), exact(rows[:-8])
        assert set(have) == set(want)
        for q in (0, 20, 40, 60, 80):
            assert [i for i, _ in have[q]] == [i for i, _ in want[q]]
    few = df.where("vec_id in (0, 20, 105)")
    assert {q: sorted(i for i, _ in v) for q, v in got(nearest(few, QUERY)).items()} == {0: [20, 105], 20: [0, 105]}
    assert nearest(df.limit(0), QUERY).count() == 0 and nearest(df.where("vec_id = 20"), QUERY).count() == 0


def test_short_queries_are_completed(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(200)]
    have = got(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), QUERY, tables=1, hashes=12, width=0.2, probes=2))
    want = exact(rows)
    assert all([i for i, _ in have[q]] == [i for i, _ in want[q]] for q in want)


def test_probes_come_in_order_of_success():
    low = np.array([0.1, 0.7, 0.45])
    order = probe_order(low, 27)
    cost = [sum(low[i] ** 2 if d < 0 else (1 - low[i]) ** 2 for i, d in p) for p in order]
    assert cost == sorted(cost) and len({tuple(sorted(p)) for p in order}) == 27


def test_recall_with_unequal_norms(spark):
    rng = np.random.default_rng(6)
    unit = rng.normal(size=(10_000, 64))
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    long = np.where(np.arange(10_000) == 7, 5.0, 1.0)
    for norms in (long, rng.lognormal(0, 1, 10_000)):
        rows = [(i, v) for i, v in enumerate((unit * norms[:, None]).tolist())]
        want, have = exact(rows), got(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), QUERY))
        recall = np.mean([len({i for i, _ in have[q]} & {i for i, _ in want[q]}) / 20 for q in want])
        assert recall >= 0.9, recall


def test_ties_of_different_vectors_go_by_id(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, *rng.integers(-4, 5, 3).tolist()]) for i in range(1, 400)]  # all at inner product 1 of the query
    rows += [(0, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").where("vec_id = 0 or vec_id % 20 <> 0")
    for block in (4096, 32):
        have = got(nearest(df, QUERY, tables=1, hashes=1, width=50.0, block=block))
        assert have[0] == [(i, 1.0) for i in sorted(i for i, _ in rows if i % 20)[:20]]
