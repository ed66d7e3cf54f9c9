"""Packing token sequences into few bins by a grouping genetic algorithm on distributed islands.

Documents are tokenized whole; only those of more than ``CAPACITY`` tokens are cut. Full pieces are bins of their own.
The other pieces are dealt by hash into shards of about ``SHARD`` pieces, and each shard evolves on ``ISLANDS`` islands:

* an individual is a list of bins (groups of pieces), begun by best-fit decreasing, dealt anew in part for its kin;
* crossover injects well-filled bins of one parent into the other whole, removes the bins that then hold a piece twice
  and some of the worst, exchanges displaced pieces for smaller ones of bins that they fill better, and best-fits what
  is left, largest first;
* fitness counts bins, then prefers uneven filling (mean square of fill);
* after each epoch every island sends its elite to the next island of the ring.

An island stops at the shard's lower bound, or when it no longer gets better. As every shard rounds up for itself, the
worst-filled bins of all shards (those of at most 1 / ``REST`` of a shard's pieces) are then opened and packed again with
each other, level by level, until one shard is left. Shards are bounded, so no task ever gathers more than a shard. Seeds
follow from the shards' numbers, shards from the pieces' table and its files, so a lost executor recomputes the same
result; packing the same documents from files of another layout may give other, equally valid sequences.

Defined results: a null or empty text is the document of no ids but the end id; the strings of special tokens become
their ids, as the tokenizer file has it; equal rows are packed once each; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.scratch import materialize
from claimloom.llm.textbuf import blocks
from claimloom.llm.word_bpe import word_bpe

CAPACITY, END_ID = 2048, 0
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS, PATIENCE = 4096, 2, 2, 6, 40, 4
EXCHANGES, MEMBERS, PARTNERS = 256, 8, 8  # of a crossover: bins, pieces of a bin and first partners that are tried
REST = 8  # a shard's worst bins that are packed again with other shards' hold at most 1 / REST of its pieces


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_bpe(path)
        for batch in batches:
            for i, j, b in blocks(batch):
                ids, ptr = encoder.encode_block(b, batch.column(1).slice(i, j - i))
                n = np.diff(ptr) + 1
                whole = np.insert(ids, ptr[1:], np.uint32(end_id)).astype("<u4", copy=False)
                first = np.concatenate([[0], np.cumsum(n)])
                count = -(-n // capacity)
                doc = np.repeat(np.arange(b.n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                view = memoryview(whole)
                at = first[doc] + start
                crc = [zlib.crc32(view[x : x + y]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins under construction, their free places kept in order for best fit."""

    def __init__(self, size: np.ndarray, capacity: int):
        self.size, self.capacity = size.tolist(), capacity
        self.bins: list[list[int]] = []
        self.free: list[tuple[int, int]] = []

    def inject(self, members: list[int]) -> None:
        bisect.insort(self.free, (self.capacity - sum(self.size[i] for i in members), len(self.bins)))
        self.bins.append(members)

    def fit(self, items: list[int]) -> None:
        """Best fit, largest first."""
        for i in sorted(items, key=lambda i: (-self.size[i], i)):
            at = bisect.bisect_left(self.free, (self.size[i], -1))
            if at < len(self.free):
                room, k = self.free.pop(at)
                self.bins[k].append(i)
                bisect.insort(self.free, (room - self.size[i], k))
            else:
                bisect.insort(self.free, (self.capacity - self.size[i], len(self.bins)))
                self.bins.append([i])


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    return len(bins), -sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(mother: list[list[int]], father: list[list[int]], size: np.ndarray, capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Some well-filled bins of the father in the mother; the mother's bins that they meet lose their other pieces, as do
    some of her worst. Loose pieces are first exchanged for smaller ones of bins that they fill better, then best-fitted."""
    sizes = size.tolist()
    fill = np.array([sum(sizes[i] for i in b) for b in father])
    ranked = np.argsort(-fill, kind="stable")[: max(1, (2 * len(father)) // 3)]
    chosen = ranked[rng.random(len(ranked)) < rng.uniform(0.1, 0.6)]
    taken = np.zeros(len(sizes), bool)
    bins: list[list[int]] = []
    for k in chosen.tolist():
        taken[father[k]] = True
        bins.append(list(father[k]))
    loose: list[int] = []
    poor = sorted(range(len(mother)), key=lambda k: sum(sizes[i] for i in mother[k]))[: max(2, len(mother) // 8)]
    worst = {poor[k] for k in rng.integers(0, len(poor), max(2, len(mother) // 50)).tolist()}
    for k, b in enumerate(mother):
        hit = [bool(taken[i]) for i in b]
        if any(hit) or k in worst:
            loose += [i for i, h in zip(b, hit, strict=True) if not h]
        else:
            bins.append(list(b))
    loose = exchange(bins, loose, sizes, capacity, rng)
    child = Bins(size, capacity)
    for b in bins:
        child.inject(b)
    child.fit(loose)
    return child.bins


def exchange(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[int]:
    """Fill bins with room better by loose pieces: one or two of these for one or two smaller ones, which become loose.
    Every exchange fills its bin more, so the pieces left over get smaller. Changes bins; gives the loose pieces."""
    free = sorted((sizes[i], i) for i in loose)
    for k in rng.permutation(len(bins))[:EXCHANGES].tolist():
        b = bins[k]
        room = capacity - sum(sizes[i] for i in b)
        if not room or not free:
            continue
        best: tuple = (0, (), ())
        outs = [((), 0)] + [((i,), sizes[i]) for i in b[:MEMBERS]] + [((i, j), sizes[i] + sizes[j]) for n, i in enumerate(b[:MEMBERS]) for j in b[:n]]
        for out, gone in outs:
            most = room + gone
            at = bisect.bisect_right(free, (most, len(sizes))) - 1
            if at >= 0 and free[at][0] - gone > best[0]:
                best = (free[at][0] - gone, out, (free[at],))
            for x in range(at, max(-1, at - PARTNERS), -1):
                y = min(bisect.bisect_right(free, (most - free[x][0], len(sizes))) - 1, x - 1)
                if y >= 0 and free[x][0] + free[y][0] - gone > best[0]:
                    best = (free[x][0] + free[y][0] - gone, out, (free[x], free[y]))
            if best[0] == room:
                break
        if best[0]:
            bins[k] = [i for i in b if i not in best[1]] + [i for _, i in best[2]]
            for f in best[2]:
                free.pop(bisect.bisect_left(free, f))
            for i in best[1]:
                bisect.insort(free, (sizes[i], i))
    return [i for _, i in free]


def evolve(size: np.ndarray, capacity: int, elites: list[list[list[int]]], seed: int, population: int = POPULATION, generations: int = GENERATIONS, patience: int = PATIENCE) -> list[list[int]]:
    """One island's epoch: from the elites that came in to the best individual. It ends at the lower bound, after
    ``generations``, or after ``patience`` generations in which neither the bins nor their filling got better."""
    sizes = size.tolist()
    bound = -(-sum(sizes) // capacity)
    rng = np.random.default_rng(seed)
    people = list(elites)
    if not people:
        first = Bins(size, capacity)
        first.fit(list(range(len(sizes))))
        people = [first.bins]
    rank = lambda p: fitness(p, sizes, capacity)
    people = sorted(((rank(p), p) for p in people), key=lambda x: x[0])
    while len(people[0][1]) > bound and len(people) < population:  # kin of the best: half of its bins, the rest in another order
        kin = Bins(size, capacity)
        loose: list[int] = []
        for b in people[0][1]:
            if rng.random() < 0.5:
                kin.inject(list(b))
            else:
                loose += b
        half = rng.random(len(loose)) < 0.5
        kin.fit([i for i, h in zip(loose, half, strict=True) if h])
        kin.fit([i for i, h in zip(loose, half, strict=True) if not h])
        people.append((rank(kin.bins), kin.bins))
    idle = 0
    for _ in range(generations):
        people = sorted(people, key=lambda x: x[0])[:population]
        if len(people[0][1]) <= bound or idle >= patience:
            break
        for _ in range(population):
            x, y = rng.integers(0, len(people), 2).tolist()
            child = crossover(people[x][1], people[y][1], size, capacity, rng)
            people.append((rank(child), child))
        idle = 0 if min(p[0] for p in people[population:]) < people[0][0] else idle + 1
    return min(people, key=lambda x: x[0])[1]


def encode_bins(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def decode_bins(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _epoch(capacity: int, epoch: int):
    """Rows (shard, island, lengths, elites): elites become the island's best individual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for shard, island, lengths, elites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = np.array(lengths, np.int64)
                came = [decode_bins(e) for e in elites or []]
                best.append(encode_bins(evolve(size, capacity, came, (shard * 1000003 + island * 1009 + epoch) % 2**63), len(size)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([[x] for x in best], pa.list_(pa.binary()))], ["shard", "island", "lengths", "elites"])

    return run


def _place(capacity: int, first_id: int, rest: bool):
    """(shard, pieces, bins) to rows with sequence and offset; where ``rest``, the pieces of the shard's worst bins (of at
    most 1 / REST of its pieces) are marked to be packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, flat = batch.column(0)[r].as_py(), batch.column(1).slice(r, 1).flatten()
                of = np.frombuffer(batch.column(2)[r].as_py(), np.int32).astype(np.int64)
                length = np.asarray(flat.field("length"))
                order = np.argsort(of, kind="stable")
                total = np.cumsum(length[order]) - length[order]
                first = np.concatenate([[True], np.diff(of[order]) != 0])
                offset = np.empty(len(of), np.int64)
                offset[order] = total - np.repeat(total[first], np.diff(np.append(np.flatnonzero(first), len(of))))
                again = np.zeros(len(of), bool)
                if rest:
                    fill, held = np.bincount(of, length), np.bincount(of)
                    worst = np.argsort(fill, kind="stable")
                    worst = worst[(np.cumsum(held[worst]) <= len(of) // REST) & (fill[worst] < capacity)]
                    again = np.isin(of, worst)
                yield pa.RecordBatch.from_arrays([flat.field("doc_id"), flat.field("piece"), flat.field("start"), flat.field("length"), flat.field("ids_crc32"), pa.array(of * 2 + 1 + (shard + first_id << 20)), pa.array(offset), pa.array(again)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "again"])

    return run


def _evolved(shards: DataFrame, n_shards: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(shard, bins): the best individual of each shard's islands."""
    lengths = shards.select("shard", F.expr("cast(pieces.length as array<bigint>)").alias("lengths"))
    state = lengths.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.expr("cast(array() as array<binary>)").alias("elites"))
    schema = "shard long, island int, lengths array<bigint>, elites array<binary>"
    for epoch in range(epochs):
        parts = max(1, min(n_shards * islands, 4 * state.sparkSession.sparkContext.defaultParallelism))
        state = state.repartition(parts, "shard", "island").mapInArrow(_epoch(capacity, epoch), schema)
        if epoch + 1 < epochs:  # the next island of the ring gets this one's elite
            state = materialize(state, "islands")
            sent = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.col("elites").alias("sent"))
            state = state.join(sent, ["shard", "island"]).select("shard", "island", "lengths", F.array_distinct(F.concat("elites", "sent")).alias("elites"))
    state = materialize(state, "islands")
    count = state.select("shard", "island", F.col("elites")[0].alias("bins"))
    return count.mapInArrow(_count, "shard long, island int, bins binary, n int").groupBy("shard").agg(F.min_by("bins", F.struct("n", "island")).alias("bins"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_size: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The pieces with sequence_id and offset: gapless sequences of at most ``capacity`` tokens."""
    pieces = materialize(pieces, "pieces")
    row = ["length", "doc_id", "piece", "start", "ids_crc32"]
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long")).select(out)
    part, first_id = pieces.where(F.col("length") < capacity).select(row), 0
    while True:  # a level takes at most 1 / REST of the level before, so there are few
        n_shards = max(1, -(-part.count() // shard_size))
        at = F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32, monotonically_increasing_id() % 1024), {n_shards})").cast("long")
        shards = materialize(part.groupBy(at.alias("shard")).agg(F.sort_array(F.collect_list(F.struct(*row)), asc=False).alias("pieces")), "shards")
        best = _evolved(shards, n_shards, capacity, islands, epochs)
        schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, again boolean"
        placed = shards.join(best, "shard").select("shard", "pieces", "bins").mapInArrow(_place(capacity, first_id, n_shards > 1), schema)
        if n_shards == 1:
            return done.unionByName(placed.select(out))
        placed = materialize(placed, "placed")
        done, part, first_id = done.unionByName(placed.where("not again").select(out)), placed.where("again").select(row), first_id + n_shards


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(x, np.int32).max()) + 1 for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], ["shard", "island", "bins", "n"])


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, **how: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity, **how)
