"""Token ids of whole batches with a word-end BPE of the ``tokenizers`` library, each distinct word encoded once.

The tokenizer lower-cases, drops white space and splits a text into runs of letters, single digits, runs of other
characters and English contractions; what it makes of such a piece does not depend on its neighbours. So a batch is cut
in numpy, pieces are told apart by hash, and only pieces not met before (in this process) are sent to the library,
joined by blanks: each piece's last token ends a word. Texts with characters outside ASCII and U+00C0..U+00FF (without
the signs U+00D7 and U+00F7), with other control characters, or with the text of a special token go to the library
whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from claimloom.llm.textbuf import SPACE, Block

MOST_WORDS = 1_000_000  # the memory of a process; at more it starts anew
_CLASS = np.full(256, 3, np.uint8)
_CLASS[SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1
_CLASS[48:58] = 2
_ODD = np.zeros(256, bool)
_ODD[[*(set(range(0x20)) - set(range(0x09, 0x0E))), 0x7F, *(set(range(0xC0, 256)) - {0xC3})]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class WordBPE:
    """Encoder for the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if len(self.known) + len(hashes) > MOST_WORDS:
            self._forget()
        ids = []
        for i in range(0, len(pieces), 4000):
            ids += [np.array(self.tokenizer.encode(" ".join(pieces[i : i + 4000]), add_special_tokens=False).ids, np.uint32)]
        flat = np.concatenate(ids)
        last = np.flatnonzero(self.ends[flat])
        assert len(last) == len(pieces), "a piece did not end in one word end"
        first = np.concatenate([[0], last[:-1] + 1])
        at = np.searchsorted(self.known, hashes)  # both sorted
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first + len(self.pool))
        self.count = np.insert(self.count, at, last + 1 - first)
        self.pool = np.concatenate([self.pool, flat])

    def encode_block(self, b: Block, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block's documents end to end, and where each document's begin (and the total)."""
        buf = b.buf
        odd = _ODD[buf]
        signs = np.flatnonzero(buf == 0xC3)
        odd[signs] |= (buf[signs + 1] == 0x97) | (buf[signs + 1] == 0xB7)
        special = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))  # <|
        odd[special] = True
        odd_docs = np.unique(np.searchsorted(b.start, np.flatnonzero(odd), "right") - 1)
        cls = _CLASS[buf]
        low = _LOW[buf]
        upper = signs[(buf[signs + 1] >= 0x80) & (buf[signs + 1] <= 0x9E)] + 1
        low[upper] += 32
        begins = cls != 0
        begins[1:] &= (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        marks = np.flatnonzero((buf == 39) & begins)
        marks = marks[marks + 2 < len(buf)]
        marks = marks[cls[marks + 1] == 1]
        for m in marks.tolist():  # 's 't 're 've 'm 'll 'd
            one, two = chr(low[m + 1]), bytes(low[m + 1 : m + 3])
            n = 1 if one in "stmd" else 2 if two in (b"re", b"ve", b"ll") else 0
            if n:
                begins[m + 1] = False
                begins[m + 1 + n] = cls[m + 1 + n] != 0
        s = np.flatnonzero(begins)
        gaps = np.flatnonzero(cls == 0)
        e = np.minimum(np.append(s[1:], len(buf)), gaps[np.searchsorted(gaps, s)]) if len(s) else s
        doc = np.searchsorted(b.start, s, "right") - 1
        if len(odd_docs):
            skip = np.zeros(b.n, bool)
            skip[odd_docs] = True
            keep = ~skip[doc]
            s, e, doc = s[keep], e[keep], doc[keep]
        h = b.spans_hash(s, e, low)
        u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = u[self.known[np.minimum(np.searchsorted(self.known, u), len(self.known) - 1)] != u] if len(self.known) else u
        if len(new):
            if len(self.known) + len(new) > MOST_WORDS:
                self._forget()
                new = u
            raw = low.tobytes()
            place = at[np.searchsorted(u, new)]
            self._learn(new, [raw[x:y].decode() for x, y in zip(s[place].tolist(), e[place].tolist(), strict=True)])
        slot = np.searchsorted(self.known, u)
        n_of, first_of = self.count[slot][inverse], self.first[slot][inverse]
        ptr = np.zeros(len(n_of) + 1, np.int64)
        np.cumsum(n_of, out=ptr[1:])
        ids = self.pool[np.repeat(first_of - ptr[:-1], n_of) + np.arange(ptr[-1])]
        bounds = ptr[np.searchsorted(doc, np.arange(b.n + 1))]
        if not len(odd_docs):
            return ids, bounds
        parts = [ids[bounds[d] : bounds[d + 1]] if not skip[d] else self.whole(texts[d].as_py()) for d in range(b.n)]
        return (np.concatenate(parts) if parts else ids), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_OPEN: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    """This process's encoder for a path."""
    if path not in _OPEN:
        _OPEN[path] = WordBPE(path)
    return _OPEN[path]
