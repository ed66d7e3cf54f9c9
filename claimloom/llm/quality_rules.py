"""Quality rules: base counts, and the divergence of a text from language references.

Words are the runs ``[^\\x20\\x09-\\x0D]+``. Base counts of each text: n_words; word_chars (code points in words);
n_symbols (characters of ``#*$%&|<>``); n_dup_lines (lines, cut at \\n, that hold a word and equal an earlier line);
n_repeat_words (words in 5-word windows that the text holds twice or more). base_failed: under 10 words, or over 20 % of
the words repeated so.

Method. Two histograms describe a text: classes of characters, and the most common words of languages (with one place
for all other words). The references are the same histograms summed over all labelled documents of each language. A
text is compared with each reference by Jensen-Shannon distance (base 2, so from 0 to 1), and with the nearest by the
mean of both distances. It fails if its class distance to that reference is over ``MOST_CLASS`` or its word distance
over ``MOST_WORD``. Guards: texts under ``LEAST_WORDS`` words are not compared at all; the word histogram counts only
from ``LEAST_FOR_WORDS`` words; without references nothing fails.

Texts are read once: counts and histograms go to a table in the shared folder (a few hundred bytes a document), from
which references and verdicts are made.

Defined results: null and empty texts have zero counts, fail the base rules and are not kept. Very long texts are
whole; equal rows are reported once each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import materialize
from claimloom.llm.textbuf import ASCII_LOWER, Block, U, blocks, mix, sequence_hash, sequence_sums

LEAST_WORDS, LEAST_FOR_WORDS, MOST_CLASS, MOST_WORD = 30, 50, 0.3, 0.42
# Frequent words of English, French, German and Spanish.
COMMON_WORDS = """the of and to in is that it was for on are as with by at be this from or an have not they which you he
de la le les des et en un une du que qui dans est pour au par sur pas plus il ce elle se ne aux son avec sont
der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
el los las del se con una su por para como más pero sus al lo y o este sí porque esta entre cuando muy sin sobre""".split()
WORDS = list(dict.fromkeys(COMMON_WORDS))
N_CLASS = 10
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_CLASS = np.full(256, 9, np.uint8)  # 9: other ASCII
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[0x0A] = 4
_CLASS[[*b".,;:"]] = 5
_CLASS[[*b"'\"()-?!"]] = 6
_CLASS[_SYMBOL] = 7
_CLASS[0xC0:] = 8  # the first byte of a character outside ASCII; bytes 0x80..0xBF continue one
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _word_numbers() -> tuple[np.ndarray, np.ndarray]:
    b = Block(pa.array([" ".join(WORDS)]))
    h = b.word_hashes()
    order = np.argsort(h)
    return h[order], order


def measure(b: Block) -> dict[str, np.ndarray]:
    """Base counts and histograms (n x N_CLASS, n x words + 1) of a block's documents."""
    h = b.word_hashes()
    n, n_words = b.n, np.diff(b.wptr)
    doc_of_word = np.repeat(np.arange(n), n_words)
    sums = lambda flag: (c := np.concatenate([[0], np.cumsum(flag)]))[b.stop] - c[b.start]
    out = {"n_words": n_words, "word_chars": sums(~b.space & ~_CONTINUES[b.buf]), "n_symbols": sums(_SYMBOL[b.buf])}
    # lines
    ends = np.flatnonzero(b.buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    line_doc = np.searchsorted(b.start, starts, "right") - 1
    worded = np.searchsorted(b.ws, ends) > np.searchsorted(b.ws, starts)
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    key = mix(b.spans_hash(starts, ends) + line_doc.astype(np.uint64) * U(0x9E3779B97F4A7C15) + (ends - starts).astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)
    # 5-word windows
    count = np.maximum(n_words - 4, 0)
    doc = np.repeat(np.arange(n), count)
    at = b.wptr[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    key = mix(sequence_hash(sequence_sums(h), at, at + 5) + doc.astype(np.uint64) * U(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    hit = at[order[same[1:] | same[:-1]]]
    edge = np.zeros(len(h) + 6, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    out["n_repeat_words"] = np.bincount(doc_of_word[np.cumsum(edge)[: len(h)] > 0], minlength=n)
    # histograms
    cls = _CLASS[b.buf]
    use = ~_CONTINUES[b.buf]
    use[b.stop] = False
    doc_of_byte = np.repeat(np.arange(n), b.stop - b.start + 1)
    out["classes"] = np.bincount(doc_of_byte[use] * N_CLASS + cls[use], minlength=n * N_CLASS).reshape(n, N_CLASS)
    low = b.spans_hash(b.ws, b.we, ASCII_LOWER[b.buf])
    known, number = _word_numbers()
    place = np.minimum(np.searchsorted(known, low), len(known) - 1)
    number = np.where(known[place] == low, number[place], len(WORDS))
    out["words"] = np.bincount(doc_of_word * (len(WORDS) + 1) + number, minlength=n * (len(WORDS) + 1)).reshape(n, len(WORDS) + 1)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, b in blocks(batch):
            m = measure(b)
            hist = np.concatenate([m["classes"], m["words"]], 1).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(m[c], pa.int64()) for c in COUNTS), pa.array([r.tobytes() for r in hist], pa.binary())], ["doc_id", "lang", *COUNTS, "hist"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histograms summed by language over all rows of a task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        hist = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(batch.num_rows, -1)
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs.tolist()):
            total[lang] = total.get(lang, 0) + hist[langs == lang].sum(0, dtype=np.int64)
    rows = [(lang, k, int(v)) for lang, t in sorted(total.items()) for k, v in enumerate(t.tolist()) if v]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "place", "n"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of rows of p (counts) to q (counts); 1 for rows without counts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        total = p.sum(1, keepdims=True)
        p = np.where(total > 0, p / np.maximum(total, 1), 0)
        q = (q / max(q.sum(), 1))[None]
        m = (p + q) / 2
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        return np.where(total[:, 0] > 0, np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1)), 1.0)


def _verdicts(langs: list[str], references: np.ndarray, most_class: float, most_word: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            hist = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<i4").reshape(n, -1).astype(float)
            words, repeat = np.asarray(batch.column(1)), np.asarray(batch.column(5))
            failed = (words < 10) | (100 * repeat > 20 * words)
            nearest, by_class, by_word = [None] * n, np.zeros(n), np.zeros(n)
            bad = np.zeros(n, bool)
            if langs and n:
                c = np.stack([js_distance(hist[:, :N_CLASS], r[:N_CLASS]) for r in references], 1)
                w = np.stack([js_distance(hist[:, N_CLASS:], r[N_CLASS:]) for r in references], 1)
                near = (c + w).argmin(1)
                by_class, by_word = c[np.arange(n), near], w[np.arange(n), near]
                nearest = [langs[k] for k in near]
                bad = (words >= LEAST_WORDS) & (by_class > most_class) | (words >= LEAST_FOR_WORDS) & (by_word > most_word)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(~failed & ~bad), pa.array(nearest, pa.string()), pa.array(by_class), pa.array(by_word)], ["doc_id", *COUNTS, "base_failed", "kept", "nearest_lang", "class_distance", "word_distance"])

    return run


def judge(docs: DataFrame, most_class: float = MOST_CLASS, most_word: float = MOST_WORD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the distances that decided."""
    counts = ", ".join(f"{c} long" for c in COUNTS)
    measured = materialize(docs.select("doc_id", "lang", "text").mapInArrow(_measure, f"doc_id long, lang string, {counts}, hist binary"), "measured")
    sums = measured.where("lang is not null").select("lang", "hist").mapInArrow(_sums, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).collect()  # one short histogram a language
    langs = sorted({r.lang for r in sums})
    references = np.zeros((len(langs), N_CLASS + len(WORDS) + 1))
    for r in sums:
        references[langs.index(r.lang), r.place] = r.n
    return measured.select("doc_id", *COUNTS, "hist").mapInArrow(_verdicts(langs, references, most_class, most_word), f"doc_id long, {counts}, base_failed boolean, kept boolean, nearest_lang string, class_distance double, word_distance double")

