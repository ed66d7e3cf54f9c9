"""SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

A text is prefixed by a blank, blanks are written U+2581, and a segmentation is a way to cut it into pieces of the
model; its score is the sum of its pieces' scores. Characters that no piece holds (and U+2581 in the text itself) become
byte pieces at the cost of an unknown character, 10 under the lowest score; pieces whose score in the file is under -1e8
(runs of blanks, which have no rank) count as 5 under the lowest. Forward Viterbi scores of all prefixes are
exact heuristics for a backward A* search from the end of the lattice, which so pops complete segmentations in the order
of their scores without ever popping a partial one in vain. Partial paths in the frontier have no completion in common
and each is as good as its estimate, so the frontier never needs more than N of them, however long the text. Of equal
scores the segmentation with fewer pieces comes first; further ties have a fixed order. Scores are whole multiples of
1 / ``SCALE`` and numbers of pieces are counted apart from them, so sums are exact.

Between two characters that stand side by side in no piece every segmentation has a cut. A text is cut there into
segments that repeat (mostly words); forward and backward Viterbi scores are computed in numpy once for each distinct
segment (a process keeps those it has met, up to a fixed number), all of one length together. The loss of a segment's second best way is the best score less the best
over edges off the best path of forward + edge + backward. A text's N best differ from the best in at most the N - 1
segments of least loss, so only those are searched by A*, and their results are combined in order of the sum. The ids
of each of the N are those of the best one with the changed segments put in place.

Defined results: null and empty texts have no pieces, score 0 and one segmentation. Decoding joins the pieces' bytes,
writes U+2581 as blank and drops the first blank; decode(encode(text)) == text for every text. Texts are whole, however
long. Equal rows are encoded once each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm.textbuf import U, blocks, mix, powers

N_BEST, SCALE = 4, 1 << 20
WORST = -(1 << 61)
MOST_SEGMENTS = 1_000_000  # that a process keeps; beyond it starts anew
BLANK, FOREIGN = 0x2581, 0x10FFFF + 1  # FOREIGN stands for U+2581 of the text itself
_B = 0xA24BAED4963EE407 | 5


class PieceModel:
    """Pieces, integer edge weights (score x SCALE) and lookup tables of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        normal = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        score = np.array([sp.get_score(i) for i in range(n)])
        lowest, usable = float(min(score[i] for i in normal if score[i] > -1e8)), normal
        score[usable] = np.maximum(score[usable], lowest - 5)  # pieces without a rank: runs of blanks
        self.score, self.unknown_score = score, lowest - 10
        self.weight = np.round(np.where(np.abs(score) < 1e9, score, 0) * SCALE).astype(np.int64)
        self.unknown = round(self.unknown_score * SCALE)
        chars = sorted({c for i in usable for c in self.pieces[i]})
        self.number = np.zeros(0x110002, np.int32)  # 0: in no piece
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        self.longest = max(len(self.pieces[i]) for i in usable)
        for i in usable:
            c = self.number[[ord(x) for x in self.pieces[i]]]
            self.beside[c[:-1], c[1:]] = True
        self.char = {c: k + 1 for k, c in enumerate(chars)}
        keys = np.array([self._key([self.char[c] for c in self.pieces[i]]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        raw = [b""] * n
        for i in normal:
            raw[i] = self.pieces[i].replace("▁", " ").encode()
        for b in range(256):
            raw[self.byte_id[b]] = bytes([b])
        self.raw_length = np.array([len(r) for r in raw])
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_length)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drop what this process has learned of segments."""
        self.known = np.zeros(0, np.uint64)
        self.facts = np.zeros((0, 6), np.int64)  # score and pieces of the best way, what the second loses of both, place in the pool, ids
        self.pool = np.zeros(0, np.int64)
        self.searched: dict[int, list[tuple[int, int, np.ndarray, bool]]] = {}

    def learn(self, keys: np.ndarray, facts: np.ndarray, ids: list[np.ndarray]) -> None:
        """Keep new segments (keys in order)."""
        at = np.searchsorted(self.known, keys)
        facts[:, 5] = [len(x) for x in ids]
        facts[:, 4] = np.cumsum(facts[:, 5]) - facts[:, 5] + len(self.pool)
        self.known, self.facts = np.insert(self.known, at, keys), np.insert(self.facts, at, facts, 0)
        self.pool = np.concatenate([self.pool, *ids])

    @staticmethod
    def _key(numbers: list[int]) -> int:
        h = 0
        for c in numbers:
            h = (h * _B + c) % (1 << 64)
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, -1 without one."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1)

    def edges(self, seg: np.ndarray) -> np.ndarray:
        """For segments of one length n (rows of character numbers): pieces at [start, length - 1], or -1; single
        characters without a piece are -2."""
        m, n = seg.shape
        most = min(self.longest, n)
        prefix = np.zeros((m, n + 1), np.uint64)
        for j in range(n):
            prefix[:, j + 1] = prefix[:, j] * U(_B) + seg[:, j].astype(np.uint64)
        power, _ = powers(_B, most + 1)
        out = np.full((m, n, most), -1, np.int64)
        for length in range(1, most + 1):
            key = prefix[:, length:] - prefix[:, : n - length + 1] * power[length]
            out[:, : n - length + 1, length - 1] = self.find(key)
        out[:, :, 0][(out[:, :, 0] < 0) | (seg == 0)] = -2
        return out

    @staticmethod
    def _first(score: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of each row the place of the greatest score, then least count, then the last such place."""
        tie = score == score.max(1, keepdims=True)
        less = np.where(tie, count, np.iinfo(np.int64).max)
        good = less == less.min(1, keepdims=True)
        return score.shape[1] - 1 - good[:, ::-1].argmax(1)

    def viterbi(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward scores and pieces of the best paths to each place (m, n + 1), the lengths of these paths' last
        pieces, edge weights, and what the second best way loses of the score and adds in pieces (a large loss without
        one)."""
        m, n, most = edge.shape
        row = np.arange(m)
        weight = np.where(edge >= 0, self.weight[edge], np.where(edge == -2, self.unknown, WORST))

        def sweep(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """w: weights by (stop, length) of pieces that end at each place."""
            score, count, back = np.full((m, most + n + 1), WORST), np.zeros((m, most + n + 1), np.int64), np.zeros((m, n + 1), np.int64)
            score[:, most] = 0
            for v in range(1, n + 1):
                s = score[:, v : v + most][:, ::-1] + w[:, v - 1]
                c = count[:, v : v + most][:, ::-1] + 1
                at = self._first(s, c)
                score[:, most + v], count[:, most + v], back[:, v] = np.maximum(s[row, at], WORST), c[row, at], at + 1
            return score[:, most:], count[:, most:], back

        by_stop = np.full((m, n, most), WORST)
        for length in range(1, most + 1):
            by_stop[:, length - 1 :, length - 1] = weight[:, : n - length + 1, length - 1]
        alpha, pieces, back = sweep(by_stop)
        beta, rest, _ = sweep(weight[:, ::-1])
        beta, rest = beta[:, ::-1], rest[:, ::-1]
        on = np.zeros((m, n, most), bool)
        at = np.full(m, n)
        while (live := at > 0).any():
            r, length = row[live], back[row[live], at[live]]
            at[live] -= length
            on[r, at[live], length - 1] = True
        second, more = np.full((m, most), WORST), np.zeros((m, most), np.int64)
        for length in range(1, most + 1):
            s = alpha[:, : n - length + 1] + weight[:, : n - length + 1, length - 1] + beta[:, length:]
            s[on[:, : n - length + 1, length - 1]] = WORST
            c = pieces[:, : n - length + 1] + 1 + rest[:, length:]
            at = self._first(s, c)
            second[:, length - 1], more[:, length - 1] = s[row, at], c[row, at]
        at = self._first(second, more)
        second, more = second[row, at], more[row, at]
        some = second > WORST // 2
        return alpha, pieces, back, weight, np.where(some, alpha[:, n] - second, -WORST), np.where(some, more - pieces[:, n], 0)

    @staticmethod
    def search(alpha: np.ndarray, pieces: np.ndarray, weight: np.ndarray, n_best: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """Backward A* over one segment, given what ``viterbi`` found: (score, pieces, [(start, stop)]) of its best
        ways, in order."""
        n, most, out, step = weight.shape[0], weight.shape[1], [], 0
        alpha, pieces = alpha.tolist(), pieces.tolist()
        # estimate, pieces, the step that made it (later ones first, so that a way is completed before its equals), length, place, path
        frontier: list = [(-alpha[n], pieces[n], 0, 0, n, 0, 0, None)]
        while frontier and len(out) < n_best:
            _, _, _, _, at, gone, count, path = frontier.pop(0)
            if at == 0:
                places = []
                while path:
                    places.append((path[0], path[1]))
                    path = path[2]
                out.append((gone, count, places))
                continue
            step += 1
            for length in range(min(most, at), 0, -1):
                w, start = int(weight[at - length, length - 1]), at - length
                if w > WORST // 2 and alpha[start] > WORST // 2:
                    frontier.append((-(gone + w + alpha[start]), count + 1 + pieces[start], -step, -length, start, gone + w, count + 1, (start, at, path)))
            frontier.sort(key=lambda x: x[:4])
            del frontier[n_best - len(out) :]
        return out


def sums_in_order(choices: list[list[tuple[int, int]]], n: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """The n best sums of one (score, pieces) from each list (best first), with the places chosen."""
    start = tuple([0] * len(choices))
    heap, seen, out = [(-sum(c[0][0] for c in choices), sum(c[0][1] for c in choices), start)], {start}, []
    while heap and len(out) < n:
        s, p, at = heapq.heappop(heap)
        out.append((-s, p, at))
        for k, c in enumerate(choices):
            if at[k] + 1 < len(c):
                nxt = (*at[:k], at[k] + 1, *at[k + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (s + c[at[k]][0] - c[at[k] + 1][0], p - c[at[k]][1] + c[at[k] + 1][1], nxt))
    return out


class Encoded:
    """All documents of some texts: ids end to end (``ptr``), and what their N best need."""

    def __init__(self, model: PieceModel, texts: list[str | None], n_best: int = N_BEST):
        self.model, self.n_best, self.texts = model, n_best, texts
        parts = [" " + t if t else "" for t in texts]
        code = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.code = np.where(code == BLANK, FOREIGN, np.where(code == 32, BLANK, code))
        number = model.number[self.code]
        size = np.array([len(p) for p in parts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)])
        cut = np.ones(len(code) + 1, bool)
        cut[1:-1] = ~model.beside[number[:-1], number[1:]] | (number[1:] == 0) | (number[:-1] == 0)
        cut[self.start] = True
        s = np.flatnonzero(cut[:-1])
        e = np.append(s[1:], len(code)) if len(s) else s
        p, inverse = powers(_B, len(code) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.code.astype(np.uint64) + U(977)) * p[: len(code)])])
        key = mix((sums[e] - sums[s]) * inverse[s])
        self.keys, at, self.which = np.unique(key, return_index=True, return_inverse=True)
        self.seg_start, self.seg_stop = s[at], e[at]  # of each distinct segment, one place where it stands
        self.first_seg = np.searchsorted(s, self.start)
        if len(model.known) + len(at) > MOST_SEGMENTS:
            model.forget()
        near = np.minimum(np.searchsorted(model.known, self.keys), max(0, len(model.known) - 1))
        new = np.flatnonzero(model.known[near] != self.keys) if len(model.known) else np.arange(len(at))
        length = (self.seg_stop - self.seg_start)[new]
        facts = np.zeros((len(new), 6), np.int64)
        ids: list = [None] * len(new)
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            for lo in range(0, len(rows), max(1, 100_000 // n)):
                r = rows[lo : lo + max(1, 100_000 // n)]
                edge = model.edges(number[self.seg_start[new[r]][:, None] + np.arange(n)])
                alpha, pieces, back, _, lost, more = model.viterbi(edge)
                facts[r, :4] = np.stack([alpha[:, n], pieces[:, n], lost, more], 1)
                self._read(r, new[r], edge, back, n, ids)
        if len(new):
            model.learn(self.keys[new], facts, ids)
        self.facts = model.facts[np.searchsorted(model.known, self.keys)]
        n_of = self.facts[:, 5][self.which]
        self.seg_ptr = np.concatenate([[0], np.cumsum(n_of)])  # of each segment of the texts, its first id
        self.ids = model.pool[np.repeat(self.facts[:, 4][self.which] - self.seg_ptr[:-1], n_of) + np.arange(self.seg_ptr[-1])].astype(np.uint32)
        self.ptr = self.seg_ptr[self.first_seg]

    def _bytes_of(self, code: int) -> np.ndarray:
        return self.model.byte_id[list(chr(BLANK if code == FOREIGN else code).encode("utf-8", "surrogatepass"))]

    def _read(self, rows: np.ndarray, segs: np.ndarray, edge: np.ndarray, back: np.ndarray, n: int, ids: list) -> None:
        m = len(rows)
        at, taken = np.full(m, n), []
        row = np.arange(m)
        while (at > 0).any():
            live = at > 0
            length = np.where(live, back[row, at], 0)
            at = at - length
            taken.append(np.where(live, edge[row, at, np.maximum(length, 1) - 1], -1))
        steps = np.stack(taken[::-1], 1)
        plain = (steps != -2).all(1)
        keep = steps >= 0
        for i in range(m):
            if plain[i]:
                ids[rows[i]] = steps[i][keep[i]]
            else:
                ids[rows[i]] = np.concatenate([self._piece_ids(edge[i], int(segs[i]), a, b) for a, b in self._path(back[i], n)])

    @staticmethod
    def _path(back: np.ndarray, n: int) -> list[tuple[int, int]]:
        out, at = [], n
        while at:
            out.append((at - int(back[at]), at))
            at -= int(back[at])
        return out[::-1]

    def _piece_ids(self, edge: np.ndarray, seg: int, a: int, b: int) -> np.ndarray | list[int]:
        """Ids of the piece over characters a..b of a distinct segment with these edges."""
        found = edge[a, b - a - 1]
        return [found] if found >= 0 else self._bytes_of(int(self.code[self.seg_start[seg] + a]))

    def document(self, d: int) -> np.ndarray:
        return self.ids[self.ptr[d] : self.ptr[d + 1]]

    def _search(self) -> None:
        """For each document the segments of least loss (``near``); the best ways of those not searched before."""
        self.near: list[np.ndarray] = []
        for d in range(len(self.texts)):
            own = self.which[self.first_seg[d] : self.first_seg[d + 1]]
            loss, more, k = self.facts[own, 2], self.facts[own, 3], min(self.n_best - 1, len(own))
            if not k:
                self.near.append(np.zeros(0, np.int64))
                continue
            near = np.flatnonzero(loss <= np.partition(loss, k - 1)[k - 1])
            near = np.sort(near[np.lexsort((more[near], loss[near]))[:k]])
            self.near.append(near[loss[near] < -WORST])
        need = np.unique(np.concatenate([np.zeros(0, np.int64), *(self.which[self.first_seg[d] + x] for d, x in enumerate(self.near))]))
        keys = [int(k) * 64 + self.n_best for k in self.keys[need].tolist()]
        need = need[[k not in self.model.searched for k in keys]]
        length = (self.seg_stop - self.seg_start)[need]
        for n in np.unique(length).tolist():
            rows = need[length == n]
            for lo in range(0, len(rows), max(1, 100_000 // n)):
                r = rows[lo : lo + max(1, 100_000 // n)]
                edge = self.model.edges(self.model.number[self.code[self.seg_start[r][:, None] + np.arange(n)]])
                alpha, pieces, _, weight, _, _ = self.model.viterbi(edge)
                for i, seg in enumerate(r.tolist()):
                    found = self.model.search(alpha[i], pieces[i], weight[i], self.n_best)
                    ids = [np.concatenate([self._piece_ids(edge[i], seg, a, b) for a, b in places]).astype(np.uint32) for _, _, places in found]
                    raw = [decode_ids(self.model, x.astype(np.int64)) for x in ids]
                    self.model.searched[int(self.keys[seg]) * 64 + self.n_best] = [(s, c, x, y == raw[0]) for (s, c, _), x, y in zip(found, ids, raw, strict=True)]

    def nbest(self, d: int) -> list[tuple[float, list[np.ndarray], bool]]:
        """(score, ids in parts, whether all changed segments decode as the best way's) of the document's best
        segmentations in order."""
        if not hasattr(self, "near"):
            self._search()
        first, last = int(self.first_seg[d]), int(self.first_seg[d + 1])
        own, near = self.which[first:last], self.near[d]
        if not len(own):
            return [(0.0, [], True)]
        score = self.facts[own, 0]
        total = (int((score >> 32).sum()) << 32) + int((score & 0xFFFFFFFF).sum())
        ways = [self.model.searched[int(k) * 64 + self.n_best] for k in self.keys[own[near]].tolist()]
        rest = total - sum(w[0][0] for w in ways)
        cuts = [(int(self.seg_ptr[first + j]), int(self.seg_ptr[first + j + 1])) for j in near.tolist()]
        out = []
        for value, _, places in sums_in_order([[x[:2] for x in w] for w in ways], self.n_best):
            parts, at, same = [], int(self.ptr[d]), True
            for (a, b), w, p in zip(cuts, ways, places, strict=True):
                if p:
                    parts += [self.ids[at:a], w[p][2]]
                    at, same = b, same and w[p][3]
            out.append(((value + rest) / SCALE, [*parts, self.ids[at : int(self.ptr[d + 1])]], same))
        return out


def decode_ids(model: PieceModel, ids: np.ndarray) -> bytes:
    """The bytes of some ids end to end, the first blank included."""
    n = model.raw_length[ids]
    total = np.cumsum(n) - n
    return model.raw[np.repeat(model.raw_start[ids] - total, n) + np.arange(int(n.sum()))].tobytes()


def decode(model: PieceModel, ids: np.ndarray) -> str:
    return decode_ids(model, np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")[1:]


_OPEN: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    if path not in _OPEN:
        _OPEN[path] = PieceModel(path)
    return _OPEN[path]


def _encode(path: str, n_best: int, all_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            for i, j, _ in blocks(batch, size=1 << 20):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                e = Encoded(model, texts, n_best)
                best = [e.nbest(d) for d in range(len(texts))]
                scores = pa.array([[s for s, _, _ in b] for b in best], pa.list_(pa.float64()))
                if all_ids:
                    ids = pa.array([[np.concatenate([np.zeros(0, np.uint32), *x]).tolist() for _, x, _ in b] for b in best], pa.list_(pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, scores], ["doc_id", "nbest_ids", "nbest_scores"])
                    continue
                raw = decode_ids(model, e.ids.astype(np.int64))
                stop = np.concatenate([[0], np.cumsum(model.raw_length[e.ids])])[e.ptr].tolist()
                whole = [raw[stop[d] : stop[d + 1]] == ((" " + t) if t else "").encode() for d, t in enumerate(texts)]
                same = [w and all(x for _, _, x in b) for w, b in zip(whole, best, strict=True)]
                crc = [[functools.reduce(lambda c, x: zlib.crc32(np.ascontiguousarray(x, "<u4"), c), parts, 0) for _, parts, _ in b] for b in best]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(e.ptr), pa.int64()), pa.array([b[0][0] for b in best]), scores, pa.array(crc, pa.list_(pa.int64())), pa.array(same)], ["doc_id", "n_pieces", "score", "nbest_scores", "nbest_crc32", "round_trip"])

    return run


def encode(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """doc_id, nbest_ids array<array<int>> (best first), nbest_scores array<double>."""
    return docs.select("doc_id", "text").mapInArrow(_encode(model, n_best, True), "doc_id long, nbest_ids array<array<int>>, nbest_scores array<double>")


def digest(docs: DataFrame, model: str, n_best: int = N_BEST) -> DataFrame:
    """doc_id, n_pieces and score of the best segmentation, and of all N in order nbest_scores and nbest_crc32 (of their
    ids as little-endian unsigned 32-bit values); round_trip: whether the pieces of every one of them decode to the text."""
    return docs.select("doc_id", "text").mapInArrow(_encode(model, n_best, False), "doc_id long, n_pieces long, score double, nbest_scores array<double>, nbest_crc32 array<bigint>, round_trip boolean")


def decode_table(encoded: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """doc_id, text of a table of doc_id and ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            texts = [None if x is None else decode(m, np.array(x, np.int64)) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", column).mapInArrow(run, "doc_id long, text string")
