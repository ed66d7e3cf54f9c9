"""Near-duplicate join on word shingles: MinHash bands, Bayesian candidate pruning, exact verification.

Shingles are the sets of 5 consecutive words (runs between spaces and \\t..\\r, ASCII letters lower-cased) of a text; a
text of 1 to 4 words has one shingle, all its words. Two texts are linked if the Jaccard similarity of their shingle
sets is at least the threshold.

1. Texts with equal word sequences form one class; its smallest doc_id represents it. Classes, not documents, go on.
2. ``BANDS`` x ``ROWS`` MinHash values give each class a key for each band. A pair is a candidate if a band agrees; at
   similarity 0.8 it agrees in none with probability (1 - 0.8**4)**24 < 4e-6. Keys of one class only are dropped by
   an aggregation with map-side combine, and a bitmap of fixed size keeps them out of later shuffles.
3. Buckets with the same smallest class are one family: near copies that agree in many bands so meet in few families, a
   class having one row in each, with the set of its bands. A family is dealt in blocks of ``SIDE`` classes and ``SIDE_BYTES`` of
   shingles at most, about; a task compares two blocks at a time. A pair is looked at only where the first band in which it agrees is. Its MinHash values
   are compared ``STEP`` at a time: with a uniform prior the posterior of its similarity after m agreements of n is
   Beta(m + 1, n - m + 1), and the pair is dropped as soon as the probability that it reaches the threshold is under
   ``TOLERANCE``.
4. Survivors are verified exactly from the shingles of their texts, again block against block. Pairs never become
   rows: a task gives each class's number of links and a spanning forest of its links.
5. Groups are the connected components of verified links.

Defined results: null, empty and blank texts have no shingles, no links, and a group of their own each. Rows repeated
with one doc_id are one document if their texts agree; if they differ each row is kept and counted. Rows without a doc_id
have no links (one row tells of them all). Very long texts are whole. An empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.operators.components import components
from claimloom.llm.groups import whole_groups
from claimloom.llm.prefilter import may_match, split_by_match
from claimloom.sources.scratch import materialize
from claimloom.llm.textbuf import U, Block, blocks, mix, sequence_hash, sequence_sums, signed

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE, SIDE = 24, 4, 16, 1e-6, 512
SIDE_BYTES = 64 << 20  # of shingles in a block, about
N_HASH = BANDS * ROWS
PAIRS = 300_000  # pairs at a time in a task
_MULTIPLY = np.random.default_rng(7).integers(1, 2**63, N_HASH, dtype=np.uint64) * U(2) + U(1)


def shingle_hashes(b: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a block, and where those of each document begin (and the total)."""
    h = b.word_hashes(lower=True)
    n = np.diff(b.wptr)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    ptr = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(b.n), count)
    s = b.wptr[doc] + np.arange(ptr[-1]) - ptr[doc]
    return sequence_hash(sequence_sums(h), s, np.minimum(s + size, b.wptr[doc + 1])), ptr


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, b in blocks(batch):
                x, ptr = shingle_hashes(b, size)
                full = np.flatnonzero(np.diff(ptr))
                sig = np.empty((len(full), N_HASH), np.uint32)
                at = 0  # as many documents at a time as stay in the cache
                while at < len(full):
                    to = max(at + 1, int(np.searchsorted(ptr[full], ptr[full[at]] + 16384, "right")) - 1)
                    part = x[ptr[full[at]] : ptr[full[to - 1] + 1]]
                    starts = ptr[full[at:to]] - ptr[full[at]]
                    for k in range(N_HASH):
                        sig[at:to, k] = np.minimum.reduceat(part * _MULTIPLY[k], starts) >> U(32)
                    at = to
                h = b.word_hashes(lower=True)
                seq = sequence_hash(sequence_sums(h), b.wptr[:-1][full], b.wptr[1:][full])
                data = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((np.arange(len(full) + 1) * (4 * N_HASH)).astype(np.int32)), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(full)), pa.array(signed(seq)), data, pa.array(np.diff(ptr)[full])], ["doc_id", "seq", "sig", "size"])

    return run


def least_agreements(threshold: float, tolerance: float = TOLERANCE, n_hash: int = N_HASH, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with under m agreements is dropped, since P(s >= threshold | m of n) < tolerance."""

    def reaches(m: int, n: int) -> float:  # 1 - I_t(m + 1, n - m + 1) as a binomial tail
        return sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return [(n, next(m for m in range(n + 1) if reaches(m, n) >= tolerance)) for n in range(step, n_hash + 1, step)]


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """n x BANDS keys; the band's number is part of the key."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    k = np.arange(BANDS, dtype=np.uint64)[None] + U(1)
    for r in range(ROWS):
        k = mix(k * U(0x9E3779B97F4A7C15) + v[:, :, r])
    return k


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, N_HASH)
        for i in range(0, len(sig), 2048):
            k = _band_keys(sig[i : i + 2048])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0))[i : i + 2048], BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(k))), pa.array(signed(k.ravel()))], ["seq", "k", "band"])


def _candidates(threshold: float):
    """Rows (family, bi, bj, block, seq, mask, sig) in that order. Gives a row for each class in a surviving pair, the
    first of a job with all its pairs (places among the job's rows given)."""
    bounds = least_agreements(threshold)

    def surviving(a: np.ndarray, b: np.ndarray, mask: np.ndarray, keys: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ours = []
        for k in range(BANDS):  # pairs whose first common band belongs to this family
            same = keys[k, a] == keys[k, b]
            pick = same & ((mask[a] >> k) & 1 == 1)
            ours.append((a[pick], b[pick]))
            a, b = a[~same], b[~same]
        a, b = (np.concatenate(x) for x in zip(*ours, strict=True))
        agree, last = np.zeros(len(a), np.int16), 0
        for n, m in bounds:
            for k in range(last, n):
                agree += sig[k, a] == sig[k, b]
            last, keep = n, agree >= m
            a, b, agree = a[keep], b[keep], agree[keep]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 3):
            family, bi, bj, block, seq, mask = (t.column(c).to_numpy() for c in range(6))
            n, size = t.num_rows, np.diff(starts)
            sig = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint32).reshape(n, N_HASH)
            keys = np.ascontiguousarray(np.concatenate([_band_keys(sig[i : i + 4096]) for i in range(0, n, 4096)]).T)
            sig = np.ascontiguousarray(sig.T)
            row, end = np.arange(n), np.repeat(starts[1:], size)
            left = np.add.reduceat((block == bi).astype(np.int64), starts[:-1])
            border = np.repeat(starts[:-1] + left, size)  # the first row of the other block
            partner = np.where(bi == bj, row + 1, border)
            count = np.where((bi == bj) | (row < border), end - partner, 0)
            total, i = np.cumsum(count), 0
            found: list[tuple[np.ndarray, np.ndarray]] = []
            while i < n:
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")))
                a = np.repeat(row[i:j], count[i:j])
                b = np.arange(len(a)) - np.repeat(total[i:j] - count[i:j] - (total[i - 1] if i else 0), count[i:j]) + partner[a]
                found.append(surviving(a, b, mask, keys, sig))
                i = j
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(a):
                continue
            group = np.searchsorted(starts, a, "right") - 1
            order = np.argsort(group, kind="stable")
            a, b, group = a[order], b[order], group[order]
            used = np.unique(np.concatenate([a, b]))
            at = np.arange(len(used))
            first_used = np.searchsorted(used, starts[:-1])
            at = at - first_used[np.searchsorted(starts, used, "right") - 1]
            place = np.zeros(n, np.int32)
            place[used] = at
            pairs: list[bytes | None] = [None] * len(used)
            for g in np.unique(group).tolist():
                s, e = np.searchsorted(group, [g, g + 1])
                pairs[first_used[g]] = np.concatenate([place[a[s:e]], place[b[s:e]]]).astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(family[used]), pa.array(bi[used]), pa.array(bj[used]), pa.array(at.astype(np.int32)), pa.array(seq[used]), pa.array(pairs, pa.binary())], ["family", "bi", "bj", "at", "seq", "pairs"])

    return run


def _shingle_sets(size: int):
    """(seq, shingles) of texts: the classes and their sets of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b in blocks(batch):
                x, ptr = shingle_hashes(b, size)
                h = b.word_hashes(lower=True)
                seq = sequence_hash(sequence_sums(h), b.wptr[:-1], b.wptr[1:])
                sets = [np.unique(x[ptr[d] : ptr[d + 1]]).tobytes() for d in range(b.n)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(seq)), pa.array(sets, pa.binary())], ["seq", "shingles"])

    return run


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each pair of sets (places a, b) shares."""
    total = sum(map(len, sets))
    if len(a) * 2 < len(sets) * 8 or total > 4_000_000:
        return np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a))
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    common, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for lo in range(0, len(values), width):
        s, e = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(sets), min(width, len(values) - lo)), np.float32)
        m[row[s:e], code[s:e] - lo] = 1
        common += m @ m.T
    return common[a, b].astype(np.int64)


def _verify(threshold: float):
    """Rows (family, bi, bj, at, seq, pairs, copies, shingles) in that order to (seq, root, links)."""

    def job(place: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = place[: len(place) // 2], place[len(place) // 2 :]
        n, common = np.array([len(x) for x in sets]), overlaps(sets, a, b)
        linked = common >= threshold * (n[a] + n[b] - common) - 1e-9
        a, b = a[linked], b[linked]
        links = np.bincount(a, weight[b], len(n)) + np.bincount(b, weight[a], len(n))
        root = list(range(len(n)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        return links.astype(np.int64), seq[[find(x) for x in range(len(n))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, 3):
            seq, copies = t.column(4).to_numpy(), t.column(6).to_numpy()
            links, roots = np.zeros(len(seq), np.int64), np.empty(len(seq), np.int64)
            pairs, sets = t.column(5), t.column(7)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = [np.frombuffer(x, np.uint64) for x in sets.slice(s, e - s).to_pylist()]
                links[s:e], roots[s:e] = job(np.frombuffer(pairs[s].as_py(), np.int32), own, copies[s:e], seq[s:e])
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(seq[some]), pa.array(roots[some]), pa.array(links[some])], ["seq", "root", "links"])

    return run


def _members(docs: DataFrame, threshold: float, size: int) -> DataFrame:
    """(doc_id, seq, copy_id, class_id, n_links, n_class, first) of each document with a doc_id and a word, one row for
    each of its texts; first: the (doc_id, seq) that stands for the group."""
    signatures = materialize(docs.select("doc_id", "text").mapInArrow(_signatures(size), "doc_id long, seq long, sig binary, size long"), "signatures")
    members = materialize(signatures.select("doc_id", "seq").distinct(), "members")
    classes = materialize(members.groupBy("seq").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies")), "classes")
    bands = materialize(signatures.select("seq", "sig").mapInArrow(_bands, "seq long, k int, band long"), "bands")
    shared = materialize(bands.groupBy("band").agg(F.min("seq").alias("family"), F.max("seq").alias("b")).where("family <> b").select("band", "family"), "shared")
    in_family = may_match(bands, "band", shared.select("band")).join(shared, "band").groupBy("family", "seq").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("mask"))
    met = materialize(in_family, "met")
    needed = materialize(met.select("seq").distinct(), "needed")
    # blocks are bounded in classes and in the bytes of their shingles, as a task holds those of two blocks
    sizes = may_match(signatures.select("seq", "size"), "seq", needed).groupBy("seq").agg(F.max("size").alias("size"))
    many = F.greatest(F.count("*") / SIDE, F.sum("size") * 8 / SIDE_BYTES)
    n_blocks = materialize(met.join(sizes, "seq").groupBy("family").agg(F.ceil(many).cast("int").alias("n_blocks")), "families")
    jobs = met.join(n_blocks, "family").withColumn("block", F.expr("cast(pmod(xxhash64(seq), n_blocks) as int)"))
    jobs = jobs.select("seq", "mask", "family", "block", F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("other"))
    jobs = jobs.select("family", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "seq", "mask")
    sigs = may_match(signatures.select("seq", "sig"), "seq", needed).dropDuplicates(["seq"])
    key = ["family", "bi", "bj"]
    schema = "family long, bi int, bj int, at int, seq long, pairs binary"
    dealt = jobs.join(sigs, "seq").select(*key, "block", "seq", "mask", "sig").repartition(*key).sortWithinPartitions(*key, "block", "seq")
    survivors = materialize(dealt.mapInArrow(_candidates(threshold), schema), "survivors")
    wanted = materialize(survivors.select("seq").distinct().join(classes, "seq"), "wanted")
    texts = may_match(docs.select("doc_id", "text"), "doc_id", wanted.select("copy_id")).select("text")
    sets = texts.mapInArrow(_shingle_sets(size), "seq long, shingles binary").join(wanted.select("seq", "copies"), "seq").dropDuplicates(["seq"])
    dealt = survivors.join(sets, "seq").select(*schema.replace(" long", "").replace(" int", "").replace(" binary", "").split(", "), "copies", "shingles")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "at")
    verified = materialize(dealt.mapInArrow(_verify(threshold), "seq long, root long, links long"), "verified")
    links = verified.groupBy("seq").agg(F.sum("links").alias("links"))
    joined = components(verified.where("seq <> root").select(F.col("seq").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "seq")
    linked = classes.join(links, "seq").join(joined, "seq")
    groups = linked.groupBy("component").agg(F.min(F.struct(F.col("copy_id").alias("doc_id"), "seq")).alias("first"), F.sum("copies").alias("n_class"))
    linked = linked.join(groups, "component").select("seq", "links", "first", "n_class")
    first = F.coalesce("first", F.struct(F.col("copy_id").alias("doc_id"), "seq"))
    by_class = classes.join(linked, "seq", "left").select("seq", "copy_id", first.alias("first"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("n_class", "copies").alias("n_class"))
    by_class = materialize(by_class, "by-class")  # so that the join below is of two tables, and can be split where a text has many copies
    return members.join(by_class, "seq").select("doc_id", "seq", "copy_id", F.col("first.doc_id").alias("class_id"), "n_links", "n_class", "first")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row per document (and per distinct text of a doc_id): doc_id, copy_id (smallest doc_id with the same word
    sequence), class_id (smallest doc_id of the group that links join), n_links (long: other documents whose
    similarity is at least the threshold, copies among them), n_class (documents in the group)."""
    found = _members(docs.where("doc_id is not null"), threshold, size).drop("seq", "first")
    alone = docs.select("doc_id", "text").where("doc_id is null or " r"text is null or not text rlike '[^ \t-\r]'").select("doc_id").distinct()
    alone = alone.select("doc_id", F.col("doc_id").alias("copy_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_class"))
    return found.unionByName(alone)


def _with_seq(at: int, names: list[str]):
    """Rows with the hash of their text's word sequence (null without a word) in column __claimloom_seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            for i, j, b in blocks(short):
                h = b.word_hashes(lower=True)
                seq = sequence_hash(sequence_sums(h), b.wptr[:-1], b.wptr[1:])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(signed(seq), mask=b.wptr[:-1] == b.wptr[1:])], [*names, "__claimloom_seq"])

    return run


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The documents without near duplicates: of each group one row stays, of the smallest doc_id (of its texts the one
    of smallest hash). Decided row by row: a row whose text has no near duplicate stays whatever other rows of its
    doc_id hold. Of rows with one doc_id and one word sequence the one with the smallest values stays. Rows without a
    doc_id or a word stay as they are."""
    found = materialize(_members(docs.where("doc_id is not null"), threshold, size), "groups")
    gone = materialize(found.where("doc_id <> first.doc_id or seq <> first.seq").select("doc_id", "seq"), "gone")
    names = docs.columns
    own = [f"`{c}`" for c in names]
    twins = docs.where("doc_id is not null").select("doc_id").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    twins = materialize(twins, "twins")
    repeats = not twins.isEmpty()
    # only rows whose doc_id may be among those that lose a row are read again and shuffled
    sure, may = split_by_match(docs, "doc_id", gone.select("doc_id").union(twins))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", __claimloom_seq long"
    may = may.select(*own).mapInArrow(_with_seq(names.index("text"), names), schema)
    # an outer join, as an anti-join would be moved below the split, and shuffle all texts
    out = gone.select("doc_id", F.col("seq").alias("__claimloom_seq"), F.lit(True).alias("__claimloom_gone"))
    may = may.join(out, ["doc_id", "__claimloom_seq"], "left").where("__claimloom_gone is null")
    if repeats:
        whole = may.where("__claimloom_seq is null or doc_id is null")
        one = may.where("__claimloom_seq is not null and doc_id is not null").groupBy("doc_id", "__claimloom_seq").agg(F.min(F.struct(*own)).alias("r"))
        may = whole.select(*own).unionByName(one.select("r.*"))
    return sure.select(*own).unionByName(may.select(*own))
