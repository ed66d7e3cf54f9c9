"""Quality scores by naive-Bayes support vectors (NB-SVM).

Features are indicators (present or not in the text) of hashed word 1-grams, word 2-grams and byte 3-grams. Each is
scaled by its log-count ratio r = log((p / |p|) / (q / |q|)), p and q the smoothed counts of training texts of either
class that have it; each text's scaled vector is set to unit length. On these a linear hinge-loss model is fitted by
dual coordinate descent, and interpolated with its mean weight. A logistic curve, fitted on training rows that the
model did not see, turns margins into scores.

Training takes about ``TRAIN_ROWS`` labelled rows of each class (all, if there are no more), drawn by a hash of the id, and
of the text where an id has several: a bounded sample. Their features, at most 2^``BITS`` numbers each however long the text, are made by executors;
texts do not go to the driver, and features only up to about ``TRAIN_BYTES`` (long texts leave fewer rows, by a hash again).

Defined results: null and empty texts have no features and the score of the bias alone. Without labels of both classes
every score is the share of label 1 (0.5 without any). Equal rows get equal scores, one each; rows whose doc_id has
several labels are left out of training. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.language_id import held_out
from claimloom.llm.prefilter import may_match
from claimloom.llm.sample import TOP, drawn, share_of, shares
from claimloom.sources.scratch import materialize
from claimloom.llm.textbuf import U, Block, blocks, mix, sequence_hash, sequence_sums

TRAIN_BYTES = 200 << 20
BITS, TRAIN_ROWS, BETA, COST, EPOCHS, SMOOTH = 18, 3000, 0.25, 1.0, 8, 1.0


class Features:
    """Distinct feature numbers (BITS bits) of each document of a block."""

    def __init__(self, b: Block):
        h = b.word_hashes()
        sums, n = sequence_sums(h), np.arange(len(h))
        one = h >> U(64 - BITS)
        two = sequence_hash(sums, n, np.minimum(n + 2, len(h))) >> U(64 - BITS)
        x = b.buf.astype(np.uint64)
        tri = np.zeros(len(x), np.uint64)
        if len(x) > 2:
            tri[:-2] = mix((x[:-2] << U(16) | x[1:-1] << U(8) | x[2:]) + U(1 << 40)) >> U(64 - BITS)
        self.b, self.one, self.two, self.tri = b, one.astype(np.int32), two.astype(np.int32), tri.astype(np.int32)
        self.stamp = np.zeros(1 << BITS, np.int32)

    def of(self, d: int) -> np.ndarray:
        b = self.b
        w, v, s, e = b.wptr[d], b.wptr[d + 1], b.start[d], b.stop[d]
        f = np.concatenate([self.one[w:v], self.two[w : max(w, v - 1)], self.tri[s : max(s, e - 2)]])
        at = np.arange(len(f), dtype=np.int32)
        self.stamp[f] = at
        return f[self.stamp[f] == at]


@dataclass
class NBSVM:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f]
        norm = float(np.sqrt((r * r).sum()))
        return self.bias + (float((r * self.weight[f]).sum()) / norm if norm else 0.0)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -50, 50)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min |w|^2/2 + cost * sum of hinge losses; the bias is a feature of value 1. Classes
    are weighed to equal total cost."""
    w, bias, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([float((v * v).sum()) + 1 for _, v in rows])
    share = np.array([np.mean(y == c) for c in (-1, 1)])
    upper = cost * 0.5 / share[(y > 0).astype(int)]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            f, v = rows[i]
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps with a small ridge."""
    a, b, t = 1.0, 0.0, (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - t) * margin).sum() + 1e-2 * (a - 1), (p - t).sum() + 1e-2 * b])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin**2).sum() + 1e-2, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def features(texts: list[str]) -> list[np.ndarray]:
    """Feature numbers of each text, in order."""
    out = []
    for _, _, b in blocks(pa.record_batch([pa.array(texts, pa.string())], ["text"])):
        x = Features(b)
        out += [np.sort(x.of(d)) for d in range(b.n)]
    return out


def train(feats: list[np.ndarray], y: np.ndarray) -> NBSVM:
    """y: 1 or -1."""
    if len(set(y.tolist())) < 2:
        p = (int((y > 0).sum()) + 0.5) / (len(y) + 1)
        return NBSVM(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 1.0, 0.0, float(np.log(p / (1 - p))))
    fit = np.arange(len(y)) % 5 > 0
    if len(set(y[fit].tolist())) < 2 or len(set(y[~fit].tolist())) < 2:
        fit[:] = True
    count = {s: np.full(1 << BITS, SMOOTH) for s in (-1, 1)}
    for i in np.flatnonzero(fit):
        count[int(y[i])][feats[i]] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[-1] / count[-1].sum())
    ratio[(count[1] == SMOOTH) & (count[-1] == SMOOTH)] = 0
    rows = []
    for f in feats:
        r = ratio[f]
        rows.append((f, r / max(1e-12, float(np.sqrt((r * r).sum())))))
    w, bias = descend([rows[i] for i in np.flatnonzero(fit)], y[fit])
    used = ratio != 0
    w[used] = (1 - BETA) * np.abs(w[used]).mean() + BETA * w[used]  # towards naive Bayes, as r carries the signs
    model = NBSVM(ratio.astype(np.float32), w.astype(np.float32), bias, 1.0, 0.0)
    margins = np.array([model.margin(f) for f in feats])
    held = ~fit if (~fit).any() else fit
    model.slope, model.shift = platt(margins[held], y[held])
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [f.astype("<i4").tobytes() for f in features(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), batch.column(2)], ["o", "features", "quality"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> NBSVM:
    """Learned from the labelled rows of docs where ``usable`` holds."""
    named = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    named = materialize(named.where(usable), "labels")
    share = shares({r.quality: r.n for r in named.groupBy("quality").agg(F.count("*").alias("n")).collect()}, per_class)
    chosen = materialize(named.where(drawn("doc_id") <= share_of(F.col("quality"), share)), "chosen")
    texts = may_match(docs.where("text is not null").select("doc_id", "text"), "doc_id", chosen.select("doc_id"))
    texts = texts.join(chosen, "doc_id").select("doc_id", "text", "quality", drawn("doc_id", "text").alias("draw"))
    # an id with n different texts gives about one of them, so that one with very many does not fill the sample
    several = materialize(texts.select("doc_id", "draw").distinct().groupBy("doc_id").agg(F.count("*").alias("n")), "texts")
    rows = texts.join(several, "doc_id").where((F.col("n") == 1) | (F.col("draw") <= F.lit(TOP) / F.col("n"))).select(F.xxhash64("doc_id").alias("o"), "text", "quality").distinct()
    made = materialize(rows.mapInArrow(_features, "o long, features binary, quality int"), "features")
    total = made.agg(F.sum(F.octet_length("features"))).first()[0] or 0
    if total > most_bytes:
        made = made.where(drawn("o") <= F.lit(TOP * most_bytes // total))
    got = sorted((r.o, bytes(r.features), r.quality) for r in made.collect())  # about two classes x per_class, and most_bytes
    return train([np.frombuffer(g[1], "<i4") for g in got], np.array([1 if g[2] else -1 for g in got]))


def _score(model: NBSVM):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b in blocks(batch):
                x = Features(b)
                s = model.score(np.array([model.margin(x.of(d)) for d in range(b.n)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: NBSVM) -> DataFrame:
    """doc_id, score of every row."""
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels that are not held out and score all: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
