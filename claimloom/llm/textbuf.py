"""Whole-batch text arithmetic in numpy: words, word hashes and k-gram hashes of many documents at once.

Documents of an Arrow batch are looked at in blocks of about ``BLOCK`` bytes (a longer document is a block of its
own). Words are the maximal runs of characters other than space and \\t..\\r, as bytes of UTF-8. Hashes are
polynomials modulo 2**64 over per-byte random values, finished by a bit mixer; they depend on content only, so every
executor gets the same ones.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
U = np.uint64
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95 | 5
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n-1."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + BLOCK // 4)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _POWERS[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each bit of the input moves half of the output's."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def tidy() -> None:
    """Give memory that this process has freed back to the system: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class Block:
    """Some documents end to end in ``buf``, each followed by a newline byte.

    start, stop: each document's bytes. Words: ws, we (bytes), wptr (first word of each document, and the total).
    """

    def __init__(self, texts: pa.Array):
        joined = pc.binary_join_element_wise(pc.cast(pc.fill_null(texts, ""), pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = joined.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.n, self.start, self.stop = len(texts), offsets[:-1], offsets[1:] - 1
        self.space = SPACE[self.buf]

    def words(self) -> Block:
        if not hasattr(self, "ws"):
            edge = np.empty(len(self.buf) + 1, bool)
            edge[0] = not self.space[0] if len(self.buf) else False
            np.not_equal(self.space[1:], self.space[:-1], out=edge[1:-1]) if len(self.buf) else None
            edge[-1] = False  # the last byte is a newline
            at = np.flatnonzero(edge)
            self.ws, self.we = at[0::2], at[1::2]
            self.wptr = np.append(np.searchsorted(self.ws, self.start), len(self.ws))
        return self

    def spans_hash(self, s: np.ndarray, e: np.ndarray, lower: np.ndarray | None = None) -> np.ndarray:
        """A hash of the bytes s..e of each span, of ``lower`` in place of buf if given."""
        p, inverse = powers(_BASE, len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[self.buf if lower is None else lower] * p[: len(self.buf)], out=sums[1:])
        return mix((sums[e] - sums[s]) * inverse[s])

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        self.words()
        return self.spans_hash(self.ws, self.we, ASCII_LOWER[self.buf] if lower else None)


def sequence_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``sequence_hash`` takes the hash of any run of word hashes."""
    p, _ = powers(_BASE2, len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=sums[1:])
    return sums


def sequence_hash(sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    _, inverse = powers(_BASE2, len(sums))
    return mix((sums[e] - sums[s]) * inverse[s])


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, Block) over the batch, each of about ``size`` bytes."""
    texts = batch.column(batch.schema.get_field_index(column))
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) + 1
    ends, i = np.cumsum(length), 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield i, j, Block(texts.slice(i, j - i))
        i = j
    tidy()


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return x.view(np.int64)
