import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from claimloom.llm.piece_nbest import Encoded, PieceModel, decode, decode_table, digest, encode

ROOT = Path(__file__).resolve().parents[2]
PATH = public_tokenizers.path("piece_bpe_32k.model")
M = PieceModel(PATH)
PIECE = {p: i for i, p in enumerate(M.pieces) if i > 258}
RNG = random.Random(6)
TEXTS = ["", None, "a", " ", "the cat", "Hello, World!  x", "naïve é 日本\n\tz", "▁x ▁", "🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "12345", "\x00\x7f"]
TEXTS += ["".join(RNG.choice("abet hn,é▁🙂") for _ in range(RNG.randrange(1, 11))) for _ in range(120)]


def ways(text):
    """Every segmentation by plain recursion: (score, number of pieces)."""
    s = "▁" + text.replace("▁", "").replace(" ", "▁")

    def go(i):
        if i == len(s):
            return [(0.0, 0)]
        out = []
        for j in range(i + 1, min(len(s), i + M.longest) + 1):
            w = s[i:j]
            score = M.score[PIECE[w]] if w in PIECE else M.unknown_score if j == i + 1 else None
            if score is not None:
                out += [(score + a, 1 + b) for a, b in go(j)]
        return out

    return sorted(go(0), key=lambda x: (-x[0], x[1]))


def test_nbest_against_all_segmentations():
    e = Encoded(M, TEXTS, 5)
    for d, t in enumerate(TEXTS):
        got = [(s, np.concatenate([np.zeros(0, int), *x]).astype(int)) for s, x, same in e.nbest(d) if same]
        if t and len(t) < 12:
            assert [s for s, _ in got] == [s for s, _ in ways(t)[:5]]
        if t and len(t) < 12 and "▁" not in t and t.isascii():  # of equal scores fewer pieces first
            assert [len(x) for _, x in got] == [n for _, n in ways(t)[:5]]
        assert len({tuple(x.tolist()) for _, x in got}) == len(got) or not t
        for _, ids in got:
            assert decode(M, ids) == (t or "")
        assert got[0][1].tolist() == e.document(d).tolist()


def test_tables(spark):
    rows = [*enumerate(TEXTS), (900, "word and " * 30000), (901, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("s"))
    got = {r.doc_id: r for r in digest(docs, PATH).collect()}
    assert len(got) == len(rows) and all(r.round_trip for r in got.values()) and got[0].n_pieces == got[1].n_pieces == 0
    assert all(r.score == r.nbest_scores[0] and r.nbest_scores == sorted(r.nbest_scores, reverse=True) for r in got.values())
    every = {r.doc_id: r for r in encode(docs, PATH).collect()}
    for i, r in got.items():
        ids = [np.array(x, "<u4") for x in every[i].nbest_ids]
        assert r.nbest_crc32 == [zlib.crc32(x.tobytes()) for x in ids] and r.nbest_scores == every[i].nbest_scores and len(ids[0]) == r.n_pieces
        assert {decode(M, x) for x in ids} == {dict(rows)[i] or ""}
    enc = encode(docs.where("doc_id < 900"), PATH, 2).select("doc_id", F.col("nbest_ids")[0].alias("ids"))
    back = {r.doc_id: r.text for r in decode_table(enc, PATH).collect()}
    assert back == {i: t or "" for i, t in rows if i < 900}
    assert digest(spark.createDataFrame([(None, "a")], "doc_id long, text string"), PATH).first().round_trip
    assert digest(docs.limit(0), PATH).count() == 0


def test_scores_are_exact_beyond_a_million_pieces():
    many = "日" * 700_000 + " ab"  # three bytes, so three ids and one piece of the lattice, for each character
    (score, parts, same), *_ = Encoded(M, [many], 2).nbest(0)
    assert same and score == M.unknown_score * 700_000 + Encoded(M, [" ab"], 1).nbest(0)[0][0] if "日" not in PIECE else same
    cats = Encoded(M, ["cat " * 1_500_000], 2).nbest(0)
    one, two = (Encoded(M, ["cat " * n], 2).nbest(0)[0][0] for n in (1, 2))
    assert cats[0][0] == one + (two - one) * 1_499_999 and cats[0][0] > cats[1][0]


def test_long_unbroken_run_in_bounded_memory():
    code = (
        "import resource, public_tokenizers as P; from claimloom.llm.piece_nbest import *;"
        "m = PieceModel(P.path('piece_bpe_32k.model')); e = Encoded(m, ['x' * 100_000 + 'ab' * 20_000], 4); n = e.nbest(0);"
        "print(len(n), all(decode(m, np.concatenate(p).astype(int)) == e.texts[0] for _, p, _ in n), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1000)"
    )
    n, same, mb = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True).stdout.split()
    assert (n, same) == ("4", "True") and int(mb) < 1000
