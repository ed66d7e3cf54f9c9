"""An encoder learned from the texts themselves: hashed counts, projected on their strongest common directions.

The directions are the leading right singular vectors of the matrix of all (unit-length) hashed vectors, taken from its Gram matrix: each
task adds up the outer products of its rows in blocks, Spark adds up the tasks' sums, and the driver gets a matrix of a fixed size (``DIM`` x ``DIM``),
whatever the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.pairs import DIM, hashing_vectors
from claimloom.sources.scratch import materialize

RANK = 128


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def gram(vectors: DataFrame, dim: int = DIM) -> np.ndarray:
    """The sum of v v' over all vectors (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = _matrix(batch, 0)
            total += v.T @ v
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array((i * dim + j).astype(np.int32)), pa.array(total[i, j])], ["place", "value"])

    out = np.zeros(dim * dim)
    for r in vectors.select("vector").where("vector is not null").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():  # dim^2 / 2 numbers at most
        out[r.place] = r.value
    half = out.reshape(dim, dim)
    return half + np.triu(half, 1).T


def directions(vectors: DataFrame, rank: int = RANK, dim: int = DIM) -> np.ndarray:
    """dim x rank: orthogonal directions of the greatest sums of squares, strongest first; fewer than ``rank`` if the vectors span less. A direction's
    sign is that of its largest entry."""
    values, basis = np.linalg.eigh(gram(vectors, dim))
    order = np.argsort(-values, kind="stable")[:rank]
    order = order[values[order] > 1e-9 * max(1.0, float(values.max(initial=0)))]
    basis = basis[:, order]
    return basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1) if basis.size else basis


def projected(vectors: DataFrame, basis: np.ndarray) -> DataFrame:
    """(id, vector): the vectors along the directions, at unit length; one without a share of any direction is zero."""
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch, 1) @ basis
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(norm > 1e-9, v / np.maximum(norm, 1e-9), 0)
            lists = pa.ListArray.from_arrays(pa.array((np.arange(len(v) + 1) * basis.shape[1]).astype(np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "vector"])

    return vectors.select("id", "vector").where("vector is not null").mapInArrow(run, f"id {kind}, vector array<double>")


def semantic_vectors(texts: DataFrame, rank: int = RANK) -> DataFrame:
    """(id, vector) of texts (id, text): unit vectors in which texts of words that occur together are near. Null and empty texts are zero."""
    hashed = materialize(hashing_vectors(texts), "hashed")
    return projected(hashed, directions(hashed, rank))
