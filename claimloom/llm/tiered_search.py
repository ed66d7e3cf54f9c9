"""Ranked lexical search over a tiered index of posting lists.

Terms are the maximal runs of ``[0-9A-Za-z]`` and characters outside ASCII, only A-Z lower-cased. N counts the texts with a
term, L their terms with repeats, n one text's terms, df the texts that hold a term, tf its occurrences in a text. A
term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); m = 25 + (75 n N) div L; a text's score for an item is the
sum, over the item's terms with repeats, of w (10^9 tf div (1000 tf + 8 m)), in 64-bit integers.

Method.

1. Texts are read once: the query's terms in each text, with their tf (forward table), without a shuffle. N, L and df follow.
2. The index: each segment (the texts of one Arrow batch, so bounded in bytes) has a posting list for each term and
   tier. A posting's impact is its share of a score; tier 0 holds those of at least half of the greatest possible impact, tier
   1 those of at least a quarter, and so on, the last one the rest. Each tier is a folder of its own.
3. Items are evaluated on tiers 0..k only, k = 0, 1, ...: a text's score from them is a lower bound, and what its
   terms' postings may still have in lower tiers (their greatest impact there, the residual bound) an upper one. Segments give their
   ten best lower bounds, and the tenth best of all is the item's threshold. If texts without any posting in tiers 0..k can't
   reach it, the candidates are proven complete: those whose upper bound reaches the threshold. Items that lack
   this proof, and only they, fall through to tier k + 1; after the last tier all residuals are 0.
4. Candidates are scored exactly from the forward table and ranked.

Items are taken in blocks of at most ``MOST_ITEMS`` items and ``MOST_CHARS`` characters (one item may be longer), so what a task
knows of them is bounded; texts meet an item in numpy, and only candidates become rows.

Defined results: null and empty texts have no terms and are in no result; items without terms, or whose terms are in no text,
give no rows. Each row of the documents is a text of its own, each row of the items an item of its own, so rows repeated under one id repeat.
Equal scores go by doc_id, nulls last. Very long texts are whole. Empty tables give an empty result. Extra columns, whatever
their names, are not read. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.llm.groups import whole_groups
from claimloom.llm.prefilter import may_match
from claimloom.llm.textbuf import Block, blocks
from claimloom.sources.scratch import materialize

BEST, TIERS = 10, 6
MOST_ITEMS, MOST_CHARS = 5_000, 8_000_000
_APART = np.zeros(256, bool)
_APART[:128] = True
_APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def term_hashes(b: Block) -> np.ndarray:
    """Hashes of a block's terms, in order; wptr tells the documents apart."""
    b.space = _APART[b.buf]
    return b.word_hashes(lower=True)


@dataclass
class Queries:
    """A block of items: term numbers (into vocabulary, sorted hashes) and repeats of each."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[Row]) -> Queries:
        hashes = []
        for r in rows:
            b = Block(pa.array([r.text], pa.string()))
            hashes.append(np.unique(term_hashes(b), return_counts=True))
        vocabulary = np.unique(np.concatenate([h for h, _ in hashes])) if hashes else np.zeros(0, np.uint64)
        return cls([r.item_id for r in rows], vocabulary, [np.searchsorted(vocabulary, h) for h, _ in hashes], [c.astype(np.int64) for _, c in hashes])


def query_blocks(items: DataFrame, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> Iterator[Queries]:
    held: list[Row] = []
    chars = 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():  # a block at a time
        if held and (len(held) >= most_items or chars + len(r.text) > most_chars):
            yield Queries.of(held)
            held, chars = [], 0
        held.append(r)
        chars += len(r.text)
    if held:
        yield Queries.of(held)


def _forward(vocabulary: np.ndarray):
    """(row, doc_id, text) to (row, doc_id, n, terms, tfs): the query's terms of each text and its number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, b in blocks(batch):
                h = term_hashes(b)
                n = np.diff(b.wptr)
                doc = np.repeat(np.arange(b.n), n)
                at = np.searchsorted(vocabulary, h)
                hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h if len(vocabulary) else np.zeros(len(h), bool)
                key, tf = np.unique(doc[hit] * len(vocabulary) + at[hit], return_counts=True)
                doc, term = np.divmod(key, max(1, len(vocabulary)))
                off = pa.array(np.searchsorted(doc, np.arange(b.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), *lists], ["row", "doc_id", "n", "terms", "tfs"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold a term, by term, in a task."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        c = np.bincount(np.asarray(batch.column(0).flatten()))
        if len(c) > len(total):
            total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
        total[: len(c)] += c
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])


@dataclass
class Scale:
    """What turns tf into impact: weights of the terms, N and L, and the greatest possible impact."""

    weight: np.ndarray
    texts: int
    length: int

    def impacts(self, terms: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + (75 * n * self.texts) // self.length
        tf = tfs.astype(np.int64)
        return self.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

    def tiers(self, impact: np.ndarray, last: int) -> np.ndarray:
        top = max(1, int(self.weight.max(initial=0)) * 1_000_000)
        return np.searchsorted(-(top // 2 ** np.arange(1, last + 1)), -impact)


def _postings(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Text (number in the batch), term and tf of each posting of forward rows (row, n, terms, tfs)."""
    off = np.asarray(batch.column(2).offsets)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(off))
    return doc, np.asarray(batch.column(2).flatten()), np.asarray(batch.column(3).flatten())


def _index(scale: Scale, last: int):
    """Forward rows to posting lists (segment, term, rows, impacts, most, tier); a batch is a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, tf = _postings(batch)
            if not len(doc):
                continue
            rows, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            impact = scale.impacts(term, tf, n[doc])
            tier = scale.tiers(impact, last)
            order = np.lexsort((-impact, term, tier))
            tier, term, impact, doc = tier[order], term[order], impact[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (tier[1:] != tier[:-1]) | (term[1:] != term[:-1])]))
            off = pa.array(np.append(new, len(tier)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(new), rows[0])), pa.array(term[new]), pa.ListArray.from_arrays(off, pa.array(rows[doc])), pa.ListArray.from_arrays(off, pa.array(impact)), pa.array(impact[new]), pa.array(tier[new].astype(np.int32))],
                ["segment", "term", "rows", "impacts", "most", "tier"],
            )

    return run


def _evaluated(batches: Iterator[pa.RecordBatch], queries: Queries, items: np.ndarray, residual: np.ndarray) -> Iterator[tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]]:
    """For each segment: its rows, and for each item with postings there (item, lower bounds, upper bounds) of the rows."""
    for table, starts in whole_groups(batches, 1):
        term, lists, impacts = (table.column(c).combine_chunks() for c in (1, 2, 3))
        off, terms = np.asarray(lists.offsets), term.to_numpy()
        all_rows, all_impacts = np.asarray(lists.values), np.asarray(impacts.values)
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows, place = np.unique(all_rows[off[s] : off[e]], return_inverse=True)
            impact = all_impacts[off[s] : off[e]]
            by_term: dict[int, list[tuple[int, int]]] = {}
            for i in range(s, e):
                by_term.setdefault(int(terms[i]), []).append((int(off[i] - off[s]), int(off[i + 1] - off[s])))

            def each(rows=rows, place=place, impact=impact, by_term=by_term) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                for item in items.tolist():
                    low = np.zeros(len(rows), np.int64)
                    left = np.full(len(rows), int((queries.repeats[item] * residual[queries.terms[item]]).sum()))
                    met = False
                    for t, c in zip(queries.terms[item].tolist(), queries.repeats[item].tolist(), strict=True):
                        for x, y in by_term.get(t, ()):
                            at, met = place[x:y], True
                            low[at] += c * impact[x:y]
                            left[at] -= c * residual[t]
                    if met:
                        yield item, low, low + left

            yield rows, each()


def _best_bounds(queries: Queries, items: np.ndarray, residual: np.ndarray, best: int):
    """The ``best`` highest lower bounds of each item in each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _evaluated(batches, queries, items, residual):
            numbers, bounds = [], []
            for item, low, _ in found:
                top = np.partition(low, -best)[-best:] if len(low) > best else low
                top = top[top > 0]
                numbers.append(np.full(len(top), item, np.int32))
                bounds.append(top)
            if numbers:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), pa.array(np.concatenate(bounds))], ["item", "bound"])

    return run


def _candidates(queries: Queries, threshold: dict[int, int], residual: np.ndarray):
    """(row, item) of the texts whose upper bound reaches the item's threshold."""
    items = np.array(sorted(threshold), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _evaluated(batches, queries, items, residual):
            out = [(rows[keep], np.full(len(keep), item, np.int32)) for item, _, high in found if len(keep := np.flatnonzero(high >= max(1, threshold[item])))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["row", "item"])

    return run


def _exact(queries: Queries, scale: Scale):
    """(row, n, terms, tfs, doc_id, items) to (item, doc_id, row, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, tf = _postings(batch)
            impact = scale.impacts(term, tf, np.asarray(batch.column(1))[doc])
            off, asked = np.asarray(batch.column(2).offsets) - batch.column(2).offsets[0].as_py(), batch.column(5)
            item_off, items = np.asarray(asked.offsets), np.asarray(asked.values)
            whole = np.zeros(len(queries.vocabulary), np.int64)
            number, place, score = [], [], []
            for d in range(batch.num_rows):
                own = term[off[d] : off[d + 1]]
                whole[own] = impact[off[d] : off[d + 1]]
                for item in items[item_off[d] : item_off[d + 1]].tolist():
                    number.append(item)
                    place.append(d)
                    score.append(int((queries.repeats[item] * whole[queries.terms[item]]).sum()))
                whole[own] = 0
            at = pa.array(np.array(place, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), batch.column(4).take(at), batch.column(0).take(at), pa.array(score, pa.int64())], ["item", "doc_id", "row", "score"])

    return run


def _search_block(docs: DataFrame, queries: Queries, best: int, tiers: int, told: list | None) -> DataFrame:
    spark, last = docs.sparkSession, tiers - 1
    numbered = docs.select("doc_id", "text").where("text is not null").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    forward = materialize(numbered.mapInArrow(_forward(queries.vocabulary), "row long, doc_id long, n long, terms array<int>, tfs array<int>"), "forward")
    size = forward.agg(F.count_if(F.col("n") > 0).alias("texts"), F.sum("n").alias("length")).first()
    scale = Scale(np.zeros(len(queries.vocabulary), np.int64), size.texts, size.length or 1)
    for r in forward.select("terms").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # the block's terms
        scale.weight[r.term] = math.floor(1000 * math.log((2 * size.texts + 2) / (2 * r.df + 1)))
    held = forward.where(F.size("terms") > 0).select("row", "n", "terms", "tfs")
    index = materialize(held.mapInArrow(_index(scale, last), "segment long, term int, rows array<long>, impacts array<long>, most long, tier int"), "index", by="tier")
    most = np.zeros((tiers + 1, len(queries.vocabulary)), np.int64)
    for r in index.groupBy("tier", "term").agg(F.max("most").alias("most")).collect():  # the block's terms, for each tier
        most[r.tier, r.term] = r.most
    residual = np.flip(np.maximum.accumulate(np.flip(most, 0), 0), 0)  # [k]: greatest impact in tiers k and lower
    open_ = np.arange(len(queries.ids))
    found: DataFrame | None = None
    for k in range(tiers):
        after = residual[k + 1]
        lists = index.where(F.col("tier") <= k).select("segment", "term", "rows", "impacts").repartition("segment").sortWithinPartitions("segment")
        bounds = lists.mapInArrow(_best_bounds(queries, open_, after, best), "item int, bound long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))
        tenth = {r["item"]: r.bound for r in bounds.withColumn("place", place).where(F.col("place") <= best).where(F.col("place") == best).select("item", "bound").collect()}
        rest = {int(i): int((queries.repeats[i] * after[queries.terms[i]]).sum()) for i in open_}
        proven = {i: tenth.get(i, 0) for i in rest if k == last or rest[i] < tenth.get(i, 0)}
        if told is not None:
            told.append((k, len(open_), len(proven)))
        if proven:
            more = lists.mapInArrow(_candidates(queries, proven, after), "row long, item int")
            found = more if found is None else found.unionByName(more)
            open_ = np.array([i for i in open_.tolist() if i not in proven], np.int64)
        if not len(open_):
            break
    asked = materialize((found if found is not None else spark.createDataFrame([], "row long, item int")).groupBy("row").agg(F.collect_list("item").alias("items")), "asked")
    wanted = may_match(forward, "row", asked.select("row")).join(asked, "row").select("row", "n", "terms", "tfs", "doc_id", "items")
    scored = wanted.mapInArrow(_exact(queries, scale), "item int, doc_id long, row long, score long").where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    named = spark.createDataFrame([(i, x) for i, x in enumerate(queries.ids)], "item int, item_id long")
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # names of the block's items


def search(docs: DataFrame, items: DataFrame, best: int = BEST, tiers: int = TIERS, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS, told: list | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` highest-scoring documents of each item. told gets (tier, items that came
    so far, items proven there)."""
    out: DataFrame | None = None
    for block in query_blocks(items, most_items, most_chars):
        ranked = _search_block(docs, block, best, tiers, told)
        out = ranked if out is None else out.unionByName(ranked)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
