"""Language identification by a byte convolutional network, trained in numpy.

A text is read as bytes of UTF-8, ASCII letters lower-cased and all other ASCII as blanks, in windows of ``WINDOW``
bytes (the last one padded with blanks; windows without letters are skipped). Each window goes through a byte
embedding, filters of several widths, max pooling over the window, and a softmax over the learned languages. A text's
probabilities are the mean of its windows', weighted by their non-blank bytes; all windows of all texts are looked at.

Convolution of embedded bytes is linear in each byte, so prediction sums rows of 256-row tables (embedding times
filter) in place of multiplying matrices.

Training rows are windows: every window of every labelled text may be drawn, by a hash of its doc_id and place, about
``TRAIN_WINDOWS`` of each language (all, if there are no more), a bounded sample that follows from the table alone.
Windows are counted, drawn and cut by DataFrame functions, so only the sample leaves its task. Adam runs with a fixed seed.

Defined results: null texts and texts without any letter are ``und`` with score 0; so is everything if there is no
labelled text. A null doc_id is not held out. Equal rows get equal results, one each. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm.sample import drawn, share_of, shares
from claimloom.llm.textbuf import Block, blocks

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 12
TRAIN_WINDOWS, EPOCHS, BATCH, RATE = 1500, 4, 32, 0.01
UNKNOWN = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def windows(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a block (rows of WINDOW + widest filter - 1 folded bytes) and the document of each."""
    folded = np.concatenate([_FOLD[b.buf], np.full(WINDOW + max(WIDTHS), 32, np.uint8)])
    length = b.stop - b.start
    count = -(-length // WINDOW)
    doc = np.repeat(np.arange(b.n), count)
    at = b.start[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    width = WINDOW + max(WIDTHS) - 1
    x = folded[at[:, None] + np.arange(width)]
    x[at[:, None] + np.arange(width) >= np.minimum(at + WINDOW, b.stop[doc])[:, None]] = 32
    some = (x != 32).any(1)
    return x[some], doc[some]


@dataclass
class ByteNet:
    """Parameters: embed (256 x E), one filter bank (width, E, F) and bias for each width, out (features x languages)."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> np.ndarray:
        """256 x (all offsets of all filters): what each byte adds at each place of each filter."""
        return np.concatenate([self.embed @ w[o] for w in self.filters for o in range(len(w))], 1).astype(np.float32)

    def pooled(self, x: np.ndarray, tables: np.ndarray, arg: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        g = tables[x]
        tops, places, at, n = [], [], 0, WINDOW
        for w, bias in zip(self.filters, self.bias, strict=True):
            f = w.shape[2]
            conv = g[:, :n, at : at + f].copy()
            for o in range(1, len(w)):
                conv += g[:, o : o + n, at + o * f : at + (o + 1) * f]
            at += len(w) * f
            if arg:
                places.append(conv.argmax(1))
                tops.append(np.take_along_axis(conv, places[-1][:, None], 1)[:, 0] + bias)
            else:
                tops.append(conv.max(1) + bias)
        return np.concatenate(tops, 1), np.concatenate(places, 1) if arg else None

    def probabilities(self, x: np.ndarray, chunk: int = 16) -> np.ndarray:
        tables, parts = self.tables(), []
        for i in range(0, len(x), chunk):
            h = np.maximum(self.pooled(x[i : i + chunk], tables)[0], 0)
            z = h @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            parts.append(z / z.sum(1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)))


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 11) -> ByteNet:
    """Cross-entropy by Adam; gradients pass the max pooling at the winning places only."""
    rng = np.random.default_rng(seed)
    n_lang = len(languages)
    p = [rng.normal(0, 0.5, (256, EMBED))] + [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS] + [np.zeros(FILTERS) for _ in WIDTHS]
    p += [rng.normal(0, (FILTERS * len(WIDTHS)) ** -0.5, (FILTERS * len(WIDTHS), n_lang)), np.zeros(n_lang)]
    k = len(WIDTHS)
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    share = np.bincount(y, minlength=n_lang) / max(1, len(y))
    weight = 1 / np.maximum(share * n_lang, 1e-9)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(order), BATCH):
            i = order[s : s + BATCH]
            net = ByteNet(languages, p[0], p[1 : k + 1], p[k + 1 : 2 * k + 1], p[-2], p[-1])
            raw, places = net.pooled(x[i], net.tables(), True)
            h = np.maximum(raw, 0)
            z = h @ p[-2] + p[-1]
            z = np.exp(z - z.max(1, keepdims=True))
            d = z / z.sum(1, keepdims=True)
            d[np.arange(len(i)), y[i]] -= 1
            d *= (weight[y[i]] / len(i))[:, None]
            grads = [np.zeros_like(q) for q in p]
            grads[-2], grads[-1] = h.T @ d, d.sum(0)
            dh = (d @ p[-2].T) * (raw > 0)
            for j, w in enumerate(WIDTHS):
                gj, at = dh[:, j * FILTERS : (j + 1) * FILTERS], places[:, j * FILTERS : (j + 1) * FILTERS]
                grads[k + 1 + j] = gj.sum(0)
                for o in range(w):
                    byte = x[i][np.arange(len(i))[:, None], at + o]
                    grads[1 + j][o] = np.einsum("nf,nfe->ef", gj, p[0][byte])
                    np.add.at(grads[0], byte, gj[:, :, None] * p[1 + j][o].T[None])
            t += 1
            for q, g, a, b in zip(p, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= RATE * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return ByteNet(languages, p[0], p[1 : k + 1], p[k + 1 : 2 * k + 1], p[-2], p[-1])


def drawn_windows(labelled: DataFrame, per_language: int) -> DataFrame:
    """(lang, doc_id, i, bytes): about ``per_language`` windows of each language's texts, repeats of a row counted once."""
    n = F.expr(f"cast(ceil(octet_length(text) / {WINDOW}) as int)")
    share = shares({r.lang: r.n for r in labelled.groupBy("lang").agg(F.sum(n).alias("n")).collect()}, per_language)  # one row a language
    rows = labelled.select("lang", "doc_id", "text", n.alias("n"), share_of(F.col("lang"), share).alias("share")).where("n > 0")
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: drawn(F.col("doc_id"), i) <= F.col("share"))
    picked = rows.select("lang", "doc_id", "text", places.alias("places")).where("size(places) > 0").select("lang", "doc_id", "text", F.explode("places").alias("i"))
    return picked.select("lang", "doc_id", "i", F.expr(f"substring(cast(text as binary), i * {WINDOW} + 1, {WINDOW})").alias("bytes")).distinct()


def fit(docs: DataFrame, usable: Column, per_language: int = TRAIN_WINDOWS) -> ByteNet | None:
    """A network learned from the texts and langs of rows where ``usable`` holds; None without any."""
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    got = sorted((r.lang, r.doc_id, r.i, bytes(r.bytes)) for r in drawn_windows(labelled, per_language).collect())  # about languages x per_language short windows
    x = np.full((len(got), WINDOW + max(WIDTHS) - 1), 32, np.uint8)
    for row, g in zip(x, got, strict=True):
        row[: len(g[3])] = _FOLD[np.frombuffer(g[3], np.uint8)]
    some = (x != 32).any(1)
    if not some.any():
        return None
    langs = np.array([g[0] for g in got], object)[some]
    languages = sorted(set(langs.tolist()))
    return train(x[some], np.searchsorted(np.array(languages, object), langs), languages)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def _predict(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(net.languages if net else []), UNKNOWN], object)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j, b in blocks(batch, size=1 << 19):
                best, score = np.full(b.n, len(names) - 1), np.zeros(b.n)
                if net:
                    x, doc = windows(b)
                    p, weight = net.probabilities(x), (x[:, :WINDOW] != 32).sum(1)
                    total = np.zeros((b.n, len(net.languages)))
                    for c in range(len(net.languages)):
                        total[:, c] = np.bincount(doc, p[:, c] * weight, b.n)
                    mass = np.bincount(doc, weight, b.n)
                    seen = mass > 0
                    best[seen], score[seen] = total[seen].argmax(1), total[seen].max(1) / mass[seen]
                    plain = (b.buf >= 97) & (b.buf <= 122) | (b.buf >= 65) & (b.buf <= 90)
                    letters = np.concatenate([[0], np.cumsum(plain)])
                    for d in np.flatnonzero(seen & (letters[b.stop] == letters[b.start])).tolist():
                        if not has_letter(texts[i + d].as_py()):
                            best[d], score[d] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(names[best], pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    return docs.select("doc_id", "text").mapInArrow(_predict(net), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    net = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """The documents of a learned language: those whose score is at least ``least_score`` (0.3, little over what four
    languages that look equally likely would get). Null texts and texts without letters go. If nothing was learned, as no row
    has a lang, no text can be told to be foreign, and all documents with a letter stay.

    The decision is taken row by row beside the text, without a join."""
    net = fit(docs, ~held_out(F.col("doc_id")))
    names, judge = docs.columns, _predict(net)
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if net is None:
                yield batch.filter(pa.array([has_letter(t) for t in batch.column(at).to_pylist()], pa.bool_()))
                continue
            short = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["doc_id", "text"])
            keep = [np.asarray(r.column(2)) >= least_score for r in judge(iter([short]))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, schema)
