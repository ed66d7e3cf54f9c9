import random

import numpy as np

from claimloom.operators import encoder as N
from claimloom.operators import pairs as P

from .factory import claim, claims


def test_directions_span_the_subspace_of_numpy(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6)) @ (rng.normal(size=(6, 40)) * np.array([9, 7, 5, 3, 1, 0.5])[:, None]) + rng.normal(size=(300, 40)) * 0.01
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, vector array<double>").repartition(5)
    assert np.allclose(N.gram(frame, 40), v.T @ v)
    basis = N.directions(frame, 4, 40)
    _, _, want = np.linalg.svd(v, full_matrices=False)
    assert np.allclose(basis.T @ basis, np.eye(4)) and np.allclose(basis @ basis.T, want[:4].T @ want[:4], atol=1e-8)
    got = {r.id: np.array(r.vector) for r in N.projected(frame, basis).collect()}
    assert set(got) == set(range(300)) and np.allclose([np.linalg.norm(x) for x in got.values()], 1)
    assert np.allclose(got[7] @ got[8], (v[7] @ basis) @ (v[8] @ basis) / np.linalg.norm(v[7] @ basis) / np.linalg.norm(v[8] @ basis))
    assert N.directions(frame, 100, 40).shape[1] <= 40 and N.directions(frame.limit(0), 4, 40).shape == (40, 0)


def test_texts_with_common_words_are_near(spark):
    rng = random.Random(2)
    topics = [["lactate", "acid", "muscle", "effort"], ["shade", "leaf", "sugar", "growth"]]
    rows = [(f"t{i}", " ".join(rng.choice(topics[i % 2]) for _ in range(12))) for i in range(60)] + [("none", None), ("empty", "")]
    got = {r.id: np.array(r.vector) for r in N.semantic_vectors(spark.createDataFrame(rows, "id string, text string"), 2).collect()}
    same, other = got["t0"] @ got["t2"], got["t0"] @ got["t1"]
    assert same > 0.9 > other and not got["none"].any() and not got["empty"].any()


def test_as_the_vectors_of_claims(spark):
    c = claims(spark, *[claim(f"c{i}", f"p{i}", subject_label=f"agent {i % 3}", object_label="growth of leaves") for i in range(9)])
    v = P.claim_vectors(c, N.semantic_vectors)
    assert {round(float(np.linalg.norm(r.vector)), 6) for r in v.collect()} == {1.0}
    assert P.candidate_pairs(c, 0.99, 8, N.semantic_vectors).count() >= 9
