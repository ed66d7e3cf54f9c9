import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.language_id import held_out
from claimloom.llm.quality_nbsvm import Features, descend, features, fit, judge, train
from claimloom.llm.textbuf import Block


def data(spark):
    rng, docs, labels = random.Random(1), [], []
    for i in range(300):
        w = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        docs.append((i, (" ".join(x + "%%%" if rng.random() < 0.3 else x for x in w)) if bad else " ".join(w)))
        if i < 240:
            labels.append((i, 0 if bad else 1))
    docs += [(900, None), (901, ""), (902, "the alpha " * 30000), (903, "of"), (903, "of")]
    labels += [(0, 1), (5, None)]  # two labels for one document, and none
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_quality_and_defined_cases(spark):
    docs, labels = data(spark)
    got = judge(docs, labels).collect()
    assert len(got) == 305 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.95
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] and by[902] > 0.5
    odd = spark.createDataFrame([(None, "of the", 1)], "doc_id long, text string, score int")
    assert judge(docs.unionByName(odd), labels.union(spark.createDataFrame([(None, 0)], "doc_id long, quality int"))).where("doc_id is null").first().held_out is False
    assert judge(docs.limit(0), labels).count() == 0
    assert {r.score for r in judge(docs, labels.limit(0)).collect()} == {0.5}


def test_training_uses_no_held_out_label(spark):
    docs, labels = data(spark)
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (fit(docs, x, ~held_out(F.col("doc_id"))) for x in (labels, flipped))
    assert np.array_equal(a.weight, b.weight) and a.slope == b.slope


def test_features_that_reach_the_driver_are_bounded(spark):
    docs, labels = data(spark)
    usable = ~held_out(F.col("doc_id"))
    whole, some = fit(docs, labels, usable), fit(docs, labels, usable, most_bytes=20_000)
    assert 0 < (some.ratio != 0).sum() < (whole.ratio != 0).sum() or not np.array_equal(some.ratio, whole.ratio)
    long = spark.createDataFrame([(i, " ".join(f"{'bad' if i % 2 else 'fine'}{i}x{k}" for k in range(20_000))) for i in range(40)], "doc_id long, text string")
    model = fit(long, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"), F.lit(True), most_bytes=1_000_000)
    assert np.isfinite(model.weight).all()


def test_features_are_distinct_indicators():
    x = Features(Block(pa.array(["a b a b", "", None, "é"])))
    assert len(x.of(0)) == 2 + 2 + 4 and len(set(x.of(0).tolist())) == len(x.of(0)) and len(x.of(1)) == len(x.of(2)) == 0 and len(x.of(3)) == 1


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([0 if i % 2 else 1, 2]), np.array([1.0, rng.normal()])) for i in range(60)]
    y = np.array([1 if i % 2 else -1 for i in range(60)])
    w, bias = descend(rows, y, 1.0, 30)
    assert all(np.sign(w[f] @ v + bias) == t for (f, v), t in zip(rows, y, strict=True))
    assert train(features(["a", "b"]), np.array([1, 1])).score(np.zeros(1))[0] > 0.5


def test_descent_reaches_the_optimum():
    """Against projected gradient steps on the dual, over all rows at once."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    y = np.where(x @ rng.normal(size=6) + rng.normal(size=40) > 0, 1, -1)
    w, bias = descend([(np.arange(6), v) for v in x], y, 1.0, 2000)
    share = np.array([np.mean(y == c) for c in (-1, 1)])
    upper = 0.5 / share[(y > 0).astype(int)]
    z = np.concatenate([x, np.ones((40, 1))], 1) * y[:, None]
    q, alpha = z @ z.T, np.zeros(40)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, upper)
    best = z.T @ alpha
    assert np.allclose(np.append(w[:6], bias), best, atol=1e-4)


def test_scores_against_plain_python(spark):
    """The scores of the query's model, feature by feature."""
    docs, labels = data(spark)
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in judge(docs, labels).where("doc_id < 40").collect()}
    for r in docs.where("doc_id < 40").collect():
        f = set(features([r.text])[0].tolist())
        norm = sum(float(model.ratio[i]) ** 2 for i in f) ** 0.5
        margin = model.bias + (sum(float(model.ratio[i]) * float(model.weight[i]) for i in f) / norm if norm else 0)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-5


def test_sample_is_bounded_and_repeats_count_once(spark):
    docs, labels = data(spark)
    many = docs.unionByName(docs).unionByName(docs)
    a, b = (fit(d, labels, ~held_out(F.col("doc_id")), 30) for d in (docs, many))
    assert np.array_equal(a.weight, b.weight) and 0 < (a.ratio != 0).sum() < (fit(docs, labels, F.lit(True)).ratio != 0).sum() + 1
