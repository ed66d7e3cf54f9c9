"""Repeated passages by sparse suffix arrays.

Method. A passage of ``min_words`` (L) words holds L - k + 1 k-grams; the one with the smallest hash is its minimiser,
chosen by content alone, so equal passages choose equal positions. Only suffixes at minimisers are retained (about one
in (L-k+2)/2 words), each with the context that passages anchored at it can reach: the bounded suffix to its right and
the bounded extension to its left. Orders are global: ranges of the sorted rows go to tasks, and every row is compared
with its neighbours there (ranges end within a group, so no group is one task's; what stands at a border is settled by a
table of two rows a task).

1. Suffixes are sorted by the k-gram they begin with, then by their whole context. One whose neighbours begin with other
   k-grams matches nothing and is dropped; neighbours of equal context are merged with their count and first occurrence,
   so thousands of copies cost one row.
2. Where different contexts remain under one k-gram, each is extended left and right word by word: the L-word windows
   anchored at the suffix, one for each number of words to its left, are sorted by their fingerprints, and each is
   compared with its neighbours; equal ones are matches, the first in the order being the source.

Each L-word window has exactly one minimiser, so the result is exact (up to 64-bit hash collisions): a word belongs to
a repeat if and only if some L-word window over it occurs twice. No group is gathered into one task.

Defined results: null and empty texts, and texts under L words, have no repeats. Words are the runs between spaces and
\\t..\\r, compared byte by byte; texts keep any length. Rows repeated under one doc_id with the same text count as one
document; if their texts differ, the smallest takes part and the others are left alone. Rows without a doc_id take no part, and stay as they are where copies are removed. An empty table gives an empty result. Extra columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.prefilter import may_match, split_by_match
from claimloom.sources.scratch import materialize
from claimloom.llm.textbuf import Block, U, blocks, sequence_hash, sequence_sums, signed

MIN_WORDS, KGRAM = 50, 8


def leftmost_least(g: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values the place of the least, the first of equals."""
    m, at, size = g, np.arange(len(g)), 1

    def joined(shift: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(m) - shift
        right = m[shift:] < m[:n]
        return np.where(right, m[shift:], m[:n]), np.where(right, at[shift:], at[:n])

    while size * 2 <= w:
        m, at = joined(size)
        size *= 2
    return joined(w - size)[1] if w > size else at


def super_suffixes(h: np.ndarray, wptr: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: document, first window (word of the block), windows in the run - 1,
    k-gram hash, hash of all words that the run covers."""
    L, w = min_words, min_words - k + 1
    n, sums = len(h), sequence_sums(h)
    empty = np.zeros(0, np.int64)
    if n < L:
        return empty, empty, empty, empty, empty
    at = np.arange(n - k + 1)
    g = sequence_hash(sums, at, at + k)
    anchor = leftmost_least(g, w)
    doc = np.repeat(np.arange(len(wptr) - 1), np.diff(wptr))
    s = np.arange(n - L + 1)
    inside = doc[s] == doc[s + L - 1]
    s, anchor = s[inside], anchor[inside]
    if not len(s):
        return empty, empty, empty, empty, empty
    new = np.ones(len(s), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    a, b = s[first], s[last]
    return doc[a], a, b - a, signed(g[anchor[first]]), signed(sequence_hash(sums, a, b + L))


def _suffixes(min_words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, b in blocks(batch):
                h = b.word_hashes()
                d, s, n, kg, ctx = super_suffixes(h, b.wptr, min_words, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][d]), pa.array((s - b.wptr[d]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(kg), pa.array(ctx)], ["doc_id", "pos", "n", "kgram", "context"])

    return run


def _windows(min_words: int):
    """For each document with requests (pos, n, context): every window of those suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            asked = batch.column(2)
            off = np.asarray(asked.offsets)
            flat = asked.values
            pos, n, ctx = (np.asarray(flat.field(x)) for x in ("pos", "n", "context"))
            for i, j, b in blocks(batch):
                h = b.word_hashes()
                sums = sequence_sums(h)
                lo, hi = off[i], off[j]
                doc = np.repeat(np.arange(j - i), np.diff(off[i : j + 1]))
                p, m, c = pos[lo:hi], n[lo:hi].astype(np.int64) + 1, ctx[lo:hi]
                row = np.repeat(np.arange(hi - lo), m)
                step = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                at = b.wptr[doc[row]] + p[row] + step
                win = signed(sequence_hash(sums, at, at + min_words))
                for x in range(0, len(row), 100_000):
                    y = slice(x, x + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(c[row[y]]), pa.array(step[y].astype(np.int32)), pa.array(win[y]), pa.array(ids[i:j][doc[row[y]]]), pa.array((p[row[y]] + step[y]).astype(np.int32))], ["context", "step", "window", "doc_id", "pos"])

    return run


def _neighboured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column those that have it in common with a neighbour; at the borders of a task, where
    the neighbour is in another, all of the first value and the last row."""
    held, known, first = None, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        k = t.column(0).to_numpy()
        first = k[0] if first is None else first
        keep, same = k == first, k[1:] == k[:-1]
        keep[0] |= known
        keep[1:] |= same
        keep[:-1] |= same
        yield from t.slice(0, len(k) - 1).filter(pa.array(keep[:-1])).to_batches()
        held, known = t.slice(len(k) - 1).combine_chunks(), bool(keep[-1])
    if held is not None:
        yield from held.to_batches()


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (window, doc_id, pos, context, step) in that order to (window, context, step, first_doc, first_pos, border)
    of those that equal a neighbour; first: the first of the equal ones here. border: whether other tasks may know more,
    which is so for the first window of a task and for its last row."""
    held, source, first = None, None, None  # source: of the run that the held row belongs to, if it has an earlier row
    names = ["window", "context", "step", "first_doc", "first_pos", "border"]

    def rows(t: pa.Table, pick: np.ndarray, doc: np.ndarray, pos: np.ndarray, border: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = t.filter(pa.array(pick)).combine_chunks()
        out = pa.table([some.column(0), some.column(3), some.column(4), pa.array(doc[pick]), pa.array(pos[pick]), pa.array(border[pick])], names)
        yield from out.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        w, d, p = (t.column(c).to_numpy() for c in range(3))
        n = len(w)
        first = w[0] if first is None else first
        same = w[1:] == w[:-1]
        starts = np.concatenate([[True], ~same])
        at = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        doc, pos = d[at], p[at]
        if source is not None:
            run = at == 0
            doc[run], pos[run] = source
        border = w == first
        pick = border.copy()
        pick[0] |= source is not None
        pick[1:] |= same
        pick[:-1] |= same
        last = np.arange(n) == n - 1
        yield from rows(t, pick & ~last, doc, pos, border)
        source = (doc[-1], pos[-1]) if pick[-1] else None
        held = t.slice(n - 1).combine_chunks()
    if held is not None:
        doc, pos = (held.column(c).to_numpy() for c in (1, 2))
        doc, pos = (doc, pos) if source is None else (np.array([source[0]]), np.array([source[1]]))
        yield from rows(held, np.ones(1, bool), doc, pos, np.ones(1, bool))


def _one_text_each(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with one text a doc_id, the smallest where rows differ; and, if any id has several rows, the hash of
    the text taken for each such id. Ids alone are counted to find them, so texts move only where ids repeat."""
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    twins = materialize(texts.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "twins")
    if twins.isEmpty():
        return texts, None
    taken = materialize(texts.join(twins, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "taken")
    return texts.join(twins, "doc_id", "left_anti").unionByName(taken), taken.select("doc_id", F.xxhash64("text").alias("__claimloom_taken"))


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, k: int = KGRAM) -> DataFrame:
    """(doc_id, pos, until, first_doc, first_pos): words pos..until of the document start L-word windows that occur
    more than once; the run's first window occurs first at word first_pos of document first_doc, and so on along it."""
    k = min(k, min_words)
    texts = _one_text_each(docs)[0]
    suffixes = materialize(texts.mapInArrow(_suffixes(min_words, k), "doc_id long, pos int, n int, kgram long, context long"), "suffixes")
    order = ["kgram", "context", "doc_id", "pos"]
    ranged = suffixes.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order)
    near = materialize(ranged.mapInArrow(_neighboured, "kgram long, context long, doc_id long, pos int, n int"), "shared")
    merged = near.groupBy("kgram", "context").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    merged = materialize(merged, "merged")
    several = merged.groupBy("kgram").agg(F.count("*").alias("contexts")).where("contexts > 1").select("kgram")
    several = materialize(several, "several")
    asked = merged.join(several, "kgram").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("first.pos", "n", "context")).alias("asked"))
    asked = materialize(asked, "asked")  # a document's requests are no more than its own suffixes
    wanted = may_match(texts, "doc_id", asked.select("doc_id"))  # only texts of which something is asked are shuffled
    windows = materialize(wanted.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_windows(min_words), "context long, step int, window long, doc_id long, pos int"), "windows")
    order = ["window", "doc_id", "pos"]
    ranged = windows.select(*order, "context", "step").repartitionByRange(*order).sortWithinPartitions(*order)
    matches = materialize(ranged.mapInArrow(_matches, "window long, context long, step int, first_doc long, first_pos int, border boolean"), "matches")
    open_ = matches.where("border").select("window").distinct()  # at most two windows a task
    settled = matches.join(F.broadcast(open_), "window").groupBy("window").agg(F.count("*").alias("c"), F.min(F.struct("first_doc", "first_pos")).alias("first")).where("c > 1")
    border = matches.where("border").drop("first_doc", "first_pos").join(F.broadcast(settled), "window").select("context", "step", "first.first_doc", "first.first_pos")
    # a run that goes on behind a border has its first place before it, and rows on both sides
    inner = matches.where("not border").join(F.broadcast(settled.select("window", "first")), "window", "left")
    inner = inner.select("context", "step", F.coalesce("first.first_doc", "first_doc").alias("first_doc"), F.coalesce("first.first_pos", "first_pos").alias("first_pos"))
    matched = inner.unionByName(border)
    extended = matched.groupBy("context").agg(F.sort_array(F.collect_list(F.struct("step", "first_doc", "first_pos"))).alias("steps"))
    found = (
        merged.join(extended, "context", "left")
        .where("copies > 1 or steps is not null")
        .select(
            "context",
            F.expr(
                # for whole contexts with copies: one run over all windows, its source the first copy, or an earlier one seen by extension
                "aggregate(coalesce(steps, array()), if(copies > 1 and steps is null,"
                " array(named_struct('a', 0, 'b', n, 'doc', first.doc_id, 'pos', first.pos)),"
                " cast(array() as array<struct<a:int,b:int,doc:bigint,pos:int>>)),"
                " (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).b = x.step - 1 and element_at(acc, -1).doc = x.first_doc"
                " and element_at(acc, -1).pos + x.step - element_at(acc, -1).a = x.first_pos,"
                " concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', x.step, 'doc', element_at(acc, -1).doc, 'pos', element_at(acc, -1).pos))),"
                " concat(acc, array(named_struct('a', x.step, 'b', x.step, 'doc', x.first_doc, 'pos', x.first_pos)))))"
            ).alias("runs"),
            "copies", "n", "first", F.col("steps").isNotNull().alias("seen"),
        )
    )
    # a context with copies whose extension met only some windows elsewhere: the rest repeat within its copies
    found = found.select("context", F.when((F.col("copies") > 1) & F.col("seen"), F.expr(
        "concat(runs, transform(filter(sequence(0, n), s -> not exists(runs, r -> s between r.a and r.b)),"
        " s -> named_struct('a', s, 'b', s, 'doc', first.doc_id, 'pos', first.pos + s)))")).otherwise(F.col("runs")).alias("runs"))
    found = materialize(found, "found")
    return (
        near.join(found, "context").select("doc_id", "pos", F.explode("runs").alias("r"))
        .select("doc_id", (F.col("pos") + F.col("r.a")).alias("pos"), (F.col("pos") + F.col("r.b")).alias("until"), F.col("r.doc").alias("first_doc"), F.col("r.pos").alias("first_pos"))
    )


def _merge(min_words: int):
    """Runs of windows of one document, as arrays, to maximal spans: repeated words, and of those the words that are
    later copies."""
    L = min_words

    def spans(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for x, y in sorted(zip(a.tolist(), b.tolist(), strict=True)):
            if out and x <= out[-1][1]:
                out[-1][1] = max(out[-1][1], y)
            else:
                out.append([x, y])
        return [(x, y) for x, y in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            ids, runs = np.asarray(batch.column(0)), batch.column(1)
            off, flat = np.asarray(runs.offsets), runs.values
            pos, until, fd, fp = (np.asarray(flat.field(x)).astype(np.int64) for x in ("pos", "until", "first_doc", "first_pos"))
            for i, doc in enumerate(ids.tolist()):
                s = slice(off[i], off[i + 1])
                p, u, d, q = pos[s], until[s], fd[s], fp[s]
                copy = (d != doc) | (q < p)
                for dup in (False, True):
                    pick = copy == dup
                    for x, y in spans(p[pick], u[pick] + L):
                        src = d[pick][(p[pick] >= x) & (u[pick] + L <= y)]
                        for c, v in zip(cols, (doc, x, y - x, int(src.min()), dup), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())], ["doc_id", "start_word", "n_words", "first_doc_id", "is_copy"])

    return run


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, k: int = KGRAM) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, is_copy): maximal spans of words that repeat in the corpus.

    is_copy false: each passage there occurs for the first time (smallest doc_id, then place) and would be kept; true:
    it repeats an earlier one, the earliest in first_doc_id. A span of copies and one of first occurrences may overlap
    by up to L - 1 words where they meet."""
    runs = repeated_windows(docs, min_words, k).groupBy("doc_id").agg(F.collect_set(F.struct("pos", "until", "first_doc", "first_pos")).alias("runs"))
    return runs.mapInArrow(_merge(min_words), "doc_id long, start_word int, n_words int, first_doc_id long, is_copy boolean")


def _without(text: str, cuts: list[dict]) -> str:
    raw, b, kept, at = text.encode(), Block(pa.array([text])).words(), [], 0
    for c in sorted(cuts, key=lambda c: c["start_word"]):
        s, e = int(b.ws[c["start_word"]]), int(b.we[c["start_word"] + c["n_words"] - 1])
        kept.append(raw[at : max(s, at)])
        at = max(at, e)
    return b"".join([*kept, raw[at:]]).decode()


def remove_copies(docs: DataFrame, min_words: int = MIN_WORDS, k: int = KGRAM) -> DataFrame:
    """The documents with each copied span cut out (first occurrences stay), n_chars counted anew; a document of
    which nothing but white space is left is dropped. Other columns stay as they are."""
    cuts = repeated_spans(docs, min_words, k).where("is_copy").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("__claimloom_cuts"))
    cuts = materialize(cuts, "cuts")
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]
    sure, may = split_by_match(docs, "doc_id", cuts.select("doc_id"))  # only rows that may lose a span are shuffled
    joined, taken = may.join(cuts, "doc_id", "left"), _one_text_each(docs)[1]
    if taken is not None:  # the spans are those of one text of the id; its other rows are left alone
        ours = F.coalesce(F.col("__claimloom_taken") == F.xxhash64("text"), F.col("__claimloom_taken").isNull())
        joined = joined.join(taken, "doc_id", "left").withColumn("__claimloom_cuts", F.when(ours, F.col("__claimloom_cuts")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not c else _without(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            by = {"doc_id": batch.column(0), "text": pa.array(texts, pa.string())} | {c: batch.column(3 + i) for i, c in enumerate(rest)}
            if "n_chars" in rest:
                n = by["n_chars"].to_pylist()
                by["n_chars"] = pa.array([len(t) if c else x for t, c, x in zip(texts, batch.column(2).to_pylist(), n, strict=True)], by["n_chars"].type)
            out = pa.RecordBatch.from_arrays([by[c] for c in names], names)
            yield out.filter(pa.array([not c or bool(t.strip(" \t\n\v\f\r")) for t, c in zip(texts, batch.column(2).to_pylist(), strict=True)]))

    own = [f"`{c}`" for c in names]
    return sure.select(*own).unionByName(joined.select("doc_id", "text", "__claimloom_cuts", *[f"`{c}`" for c in rest]).mapInArrow(run, schema))
