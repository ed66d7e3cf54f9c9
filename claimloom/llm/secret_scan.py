"""Secret scans: fixed patterns, and guess-cost dynamic programming on values in credential contexts.

Patterns (kinds assign, access, hex), each leftmost and non-overlapping within its kind:

* assign: ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, its letters in
  either case (ASCII), value of 6 characters or more; access: ``AKIA[A-Z0-9]+`` of 20 or more; hex: ``[0-9a-f]+`` of 24
  or more. Shorter matches are dropped.

Method (kind guess): wider contexts (``pwd``, ``passphrase``, ``credential``, ``auth``, ``bearer``, ``login`` ... with
``:``, ``=`` or ``is``) give candidate values. A value's guess cost is the least sum, over all ways to cut it into
spans, of the logarithms (base 10) of the guesses for each span: words by their rank in a list of common passwords, or else
in a public word list (``word_ranks``: the words of a tokenizer's vocabulary in the order of its file), dates, repeats (twice or more, single characters three times) of a block of up to ``MOST_BLOCK`` characters,
walks on the keyboard of three characters and more (runs of digits and of the alphabet among them), and brute force by
character class. The least is taken over all such spans, exactly. Values are whole, however long; one that
opens with a double quote ends at the next. A value whose cost is at least ``HARD`` is a secret and adds a
span, also over base spans, which stay; the values of assign matches are judged in full in the same way. After a blank
or ``is`` a value of letters alone is taken for a word. Costs of assigned values are reported too.

Positions are code points, ends exclusive. Defined results: null is the empty text and has no spans; texts are whole,
however long; equal rows are reported once each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm.textbuf import Block, blocks

ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_VALUE = r"(?:\"((?:\\[!-~]|[!#-&(-\[\]-~]){8,})|'?((?!\")[!-&(-~]{8,}))"
VALUE = re.compile(_VALUE, re.ASCII)
CONTEXT = re.compile(r"(?i:\b(?:pwd|pass(?:word|wd|phrase|code)|secret|credentials?|auth(?:orization)?|bearer|login|token|(?:api|access|private|secret)[_ -]?key))[\"']?(?:\x20*[:=]\x20*|\x20+is\x20+|\x20+)" + _VALUE, re.ASCII)
HINTS = ("passw", "passp", "passc", "secret", "token", "key", "pwd", "credential", "auth", "bearer", "login")
KINDS = ("assign", "access", "hex", "guess")
HARD, MIXED, WORDLIKE = 10.0, 6.0, 5.5  # log10 of guesses
JOINERS = "-_./:@,'"  # symbols that stand between words in plain text, too
MOST_BLOCK = 12  # characters of a block that repeats count
# Frequent passwords and words of credentials, most frequent first.
COMMON = """123456 password 12345678 qwerty 123456789 12345 1234 111111 1234567 dragon 123123 baseball abc123 football monkey
letmein shadow master 666666 qwertyuiop 123321 mustang 1234567890 michael 654321 superman 1qaz2wsx 7777777 121212 000000
qazwsx 123qwe killer trustno1 jordan jennifer zxcvbnm asdfgh hunter buster soccer harley batman andrew tigger sunshine
iloveyou 2000 charlie robert thomas hockey ranger daniel starwars klaster 112233 george computer michelle jessica pepper
1111 zxcvbn 555555 11111111 131313 freedom 777777 pass maggie 159753 aaaaaa ginger princess joshua cheese amanda summer
love ashley nicole chelsea biteme matthew access yankees 987654321 dallas austin thunder taylor matrix admin root user
test guest login welcome hello secret token key api example changeme default null none true false your value here""".split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "0123456789", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujmikolp", "1qaz2wsx3edc4rfv5tgb6yhn")
_NEXT = {p for r in ROWS for p in zip(r, r[1:], strict=False)} | {p for r in ROWS for p in zip(r[1:], r, strict=False)}
DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:(?:19|20)\d\d|\d\d)|(?:19|20)\d\d)")
LEET = str.maketrans("013457@$!", "oleastasi")


def _class_log(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


@dataclass(frozen=True)
class Ranks:
    """Words by rank; name tells lists apart where costs are remembered."""

    name: str
    rank: dict = field(hash=False, compare=False)
    longest: int = 0


PASSWORDS = Ranks("passwords", RANK, max(map(len, RANK)))
_KEPT: dict[str, Ranks] = {}


def kept(ranks: Ranks) -> Ranks:
    """The list of that name that this process has: each task brings its own copy, and remembered costs would keep all of them."""
    return _KEPT.setdefault(ranks.name, ranks)


@functools.cache
def word_ranks(path: str, least: int = 3) -> Ranks:
    """The common passwords, and after them the words of a tokenizer's vocabulary (a JSON file as of the ``tokenizers`` library): entries of
    ``least`` small letters and more that end a word or begin one, in the order of their ids, which is about that of their frequency. Bounded by
    the vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    rank = dict(RANK)
    for token, _ in sorted(vocabulary.items(), key=lambda x: x[1]):
        word = token.removesuffix("</w>") if token.endswith("</w>") else token[1:] if token[:1] in "\u0120\u2581" else ""
        if len(word) >= least and word.isascii() and word.isalpha():
            rank.setdefault(word.lower(), len(rank) + 1)
    return Ranks(path, rank, max(map(len, rank)))


def guess_cost(value: str, ranks: Ranks = PASSWORDS) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for the empty value. The work grows in proportion to the value."""
    return _short_cost(value, ranks) if len(value) <= 200 else _cost(value, ranks)


def word_cost(value: str, low: str, leet: str, i: int, j: int, ranks: Ranks = PASSWORDS) -> float:
    """Of value[i:j] as one word; infinite if it is none."""
    w = low[i:j]
    rank = ranks.rank.get(w) or ranks.rank.get(leet[i:j])
    if not rank:
        return math.inf
    upper = sum(c.isupper() for c in value[i:j])
    cased = 0 if not upper else math.log10(2) if upper in (1, j - i) else math.log10(math.comb(j - i, min(upper, j - i - upper)) + 1)
    return math.log10(rank + 1) + cased + (0 if w in ranks.rank else math.log10(2))


def date_cost(length: int) -> float:
    return math.log10(120) if length == 4 else math.log10(365.0 * 120 * (4 if length > 8 else 1))


def walk_cost(length: int) -> float:
    return math.log10(2 * 47.0 * length)


def _cost(value: str, ranks: Ranks) -> float:
    """The least sum over all segmentations. Spans that begin later lose against earlier ones for good once they cost as
    much (logarithms of lengths are concave), so few starts of walks and repeats are open at any place."""
    n, low, rank = len(value), value.lower(), ranks.rank
    if len(low) != n:  # characters whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    leet = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    step = [(low[i], low[i + 1]) in _NEXT for i in range(n - 1)] + [False]
    sizes = range(1, min(MOST_BLOCK, n // 2) + 1)
    same = []  # for each block size: characters from i on that equal those a block later
    for size in sizes:
        run = [0] * (n + 1)
        for i in range(n - size - 1, -1, -1):
            if low[i] == low[i + size]:
                run[i] = run[i + 1] + 1
        same.append(run)
    repeats: list[list] = [[[] for _ in range(size)] for size in sizes]  # by place in the block: open starts (place, cost before and of the block)
    walks: list[tuple[int, float]] = []  # open starts of the walk that goes on here
    brute = math.inf  # the cheapest brute-force span that is open, with a small charge for being a span
    for i in range(n + 1):
        for size in sizes:
            s = i - size * (2 if size > 1 else 3)
            if s < 0:
                break
            if same[size - 1][s] >= i - s - size:
                starts = repeats[size - 1][s % size]
                if s < size or same[size - 1][s - size] < size:
                    starts.clear()  # another run of repeats begins
                starts.append((s, best[s] + guess_cost(value[s : s + size], ranks)))
                left, least = [], math.inf
                for x in starts:
                    c = x[1] + math.log10((i - x[0]) / size)
                    if c < least:
                        left.append(x)
                        least = c
                repeats[size - 1][s % size] = left
                best[i] = min(best[i], least)
        if i >= 3 and step[i - 2] and step[i - 3]:
            walks.append((i - 3, best[i - 3]))
            left, least = [], math.inf
            for x in walks:
                c = x[1] + walk_cost(i - x[0])
                if c < least:
                    left.append(x)
                    least = c
            walks = left
            best[i] = min(best[i], least)
        else:
            walks = []
        if i == n:
            return best[n]
        here = best[i]
        brute = min(brute, here + 0.3) + _class_log(value[i])
        best[i + 1] = min(best[i + 1], brute)
        for j in range(i + 3, min(n, i + ranks.longest) + 1):
            if low[i:j] in rank or leet[i:j] in rank:
                best[j] = min(best[j], here + word_cost(value, low, leet, i, j, ranks))
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], here + date_cost(j - i))
    return best[n]


_short_cost = functools.lru_cache(100_000)(_cost)


def _trimmed(m: re.Match) -> tuple[int, int]:
    """Start and end of a value, without the brackets and quotes before it and the punctuation after it."""
    v = m[m.lastindex]
    s = m.start(m.lastindex) + len(v) - len(v.lstrip("\"'([{<"))
    return s, max(s, m.start(m.lastindex) + len(v.rstrip("\"',;:.)]}>#*$%&")))


def _mixed(value: str) -> bool:
    """Whether small and capital letters, digits, and symbols that do not join words all occur."""
    return any(c.islower() for c in value) and any(c.isupper() for c in value) and any(c.isdigit() for c in value) and any(not c.isalnum() and c not in JOINERS for c in value)


def _plain(value: str, ranks: Ranks) -> bool:
    """Whether a value reads as two or three words that symbols join, or as an address without a parameter."""
    if value.lower().startswith(("http://", "https://", "www.")) and not any(c in value for c in "?=@"):
        return True
    parts = [p for p in re.split(f"[{re.escape(JOINERS)}]", value) if p]
    return 2 <= len(parts) <= 3 and all(p.isalpha() and guess_cost(p, ranks) <= WORDLIKE for p in parts)


def scan(text: str, deep: bool = True, ranks: Ranks = PASSWORDS) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Spans (start, kind's number, end) in order, and the costs of assigned and guessed values."""
    spans, costs = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            spans.append((m.start(), 0, m.end()))
            costs.append(guess_cost(m[2], ranks))
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if deep:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    values = {}  # by their start: end, and whether letters and joiners alone may be a secret
    for m in CONTEXT.finditer(text):
        s, e = _trimmed(m)
        values[s] = (e, any(c in ":=" for c in text[m.start() : m.start(m.lastindex)]))
    for m in ASSIGN.finditer(text):  # the same values in longer names, such as DB_PASSWORD
        v = VALUE.match(text, m.start(2) - (text[m.start(2) - 1] in "\"'"))
        if v:
            s, e = _trimmed(v)
            values[s] = (e, True)
    for s, (e, letters) in values.items():
        if e - s >= 8 and (letters or not all(c.isalpha() or c in JOINERS for c in text[s:e])):
            c = guess_cost(text[s:e], ranks)
            if c >= (MIXED if _mixed(text[s:e]) else HARD) and not _plain(text[s:e], ranks):
                spans.append((s, 3, e))
                costs.append(c)
    return sorted(spans), costs


def long_hex(b: Block) -> np.ndarray:
    """Documents of a block with 24 hex digits in a row."""
    is_hex = (b.buf >= 48) & (b.buf <= 57) | (b.buf >= 97) & (b.buf <= 102)
    gaps = np.flatnonzero(~is_hex)
    runs = gaps[:-1][np.diff(gaps) > 24] if len(gaps) else gaps
    out = np.zeros(b.n, bool)
    if len(gaps) and gaps[0] >= 24:
        out[0] = True
    out[np.searchsorted(b.start, runs + 1, "right") - 1] = True
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _found(text: str | None, hexes: bool, ranks: Ranks = PASSWORDS) -> tuple[list[tuple[int, int, int]], list[float]]:
    if not text:
        return [], []
    low = text.lower()
    if not hexes and "AKIA" not in text and not any(h in low for h in HINTS):
        return [], []
    return scan(text, ranks=ranks)


def _digest(ranks: Ranks):
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(ranks)
        for batch in batches:
            for i, j, b in blocks(batch):
                hexes = long_hex(b)
                texts = batch.column(1).slice(i, j - i).to_pylist()
                n = np.zeros((3, b.n), np.int64)
                sha, spans, cost = [none] * b.n, [""] * b.n, [None] * b.n
                for d, t in enumerate(texts):
                    found, costs = _found(t, bool(hexes[d]), own)
                    if found:
                        base = [x for x in found if x[1] < 3]
                        for _, k, _ in base:
                            n[k, d] += 1
                        sha[d], spans[d] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
                        cost[d] = max(costs) if costs else None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in n), pa.array(sha), pa.array(spans), pa.array(cost, pa.float64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "max_guess_log10"])

    return run


def find_secrets(docs: DataFrame, words: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, max_guess_log10 (null without a valued context). words: the file
    for ``word_ranks``, read by the driver; without it only common passwords are words."""
    ranks = word_ranks(words) if words else PASSWORDS
    return docs.select("doc_id", "text").mapInArrow(_digest(ranks), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_guess_log10 double")


def redact(text: str | None, mask: str = "[SECRET]", ranks: Ranks = PASSWORDS) -> str | None:
    """The text with each span of secrets (overlapping ones together) replaced; an assignment keeps its name."""
    if not text:
        return text
    spans, out, at = scan(text, ranks=ranks)[0], [], 0
    cut = []
    for s, k, e in spans:
        cut.append((ASSIGN.match(text, s).start(2) if k == 0 else s, e))
    for s, e in sorted(cut):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", words: str | None = None) -> DataFrame:
    """The documents with secrets masked in their text and n_chars counted anew; every document stays. words: as of
    ``find_secrets``."""
    names, ranks = docs.columns, word_ranks(words) if words else PASSWORDS
    at, schema = names.index("text"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(ranks)
        for batch in batches:
            hexes = np.concatenate([long_hex(b) for _, _, b in blocks(batch)] or [np.zeros(0, bool)])
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            new = [redact(t, mask, own) if _found(t, bool(h), own)[0] else t for t, h in zip(texts, hexes, strict=True)]
            columns[at] = pa.array(new, pa.string())
            if chars is not None:
                columns[chars] = pa.array([len(x) if x != t else n for x, t, n in zip(new, texts, batch.column(chars).to_pylist(), strict=True)], batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)
