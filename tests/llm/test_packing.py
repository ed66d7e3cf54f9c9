import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from claimloom.llm.packing import Bins, crossover, decode_bins, encode_bins, evolve, pack, pack_documents
from claimloom.llm.textbuf import blocks
from claimloom.llm.word_bpe import WordBPE

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's I'm we're they'LL 'sam !'s 's's don't ''t 'x '", "", None, "naïve ÀÉ ×÷ x", "日本 <|endoftext|> a", "<|endoftext|> a", "a<|startoftext|><|ENDOFTEXT|>b", "<|", "tab\x01x", "a1b22 3.5€", "ÿß'd 'D", "O'", "'s", "é İ ſ ª", "\u0085x", "a\n\nb\t c"]


T = Tokenizer.from_file(PATH)


def reference(text):
    return [*T.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_equal_the_library():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aB'sretdlvm 1!.é\nÀ") for _ in range(rng.randrange(60))) for _ in range(400)]
    t, a = WordBPE(PATH), pa.array(texts)
    for size in (50, 1 << 20):
        for i, j, b in blocks(pa.record_batch([a], ["text"]), size=size):
            ids, ptr = t.encode_block(b, a.slice(i, j - i))
            for k in range(b.n):
                assert ids[ptr[k] : ptr[k + 1]].tolist() + [0] == reference(texts[i + k])


def checked(rows, texts, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == sorted({i for i, _ in texts})
    for i, t in texts:
        ids = reference(t)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        want = [(n, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for n, s in enumerate(range(0, len(ids), capacity))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == want
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


@pytest.mark.parametrize("shard", [30, 4096])
def test_packs_whole_documents(spark, shard):
    rng = random.Random(4)
    texts = list(enumerate([*ODD, *(" ".join(rng.choice(["the", "onnd", "x1", "théâtre"]) for _ in range(rng.randrange(200))) for _ in range(150)), "word " * 3000]))
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'a' AS shard", "7 AS length")
    rows = pack_documents(df, PATH, 256, shard_size=shard).collect()
    n = checked(rows, texts, 256)
    short = [r.length for r in rows if r.length < 256]
    assert n <= best_fit(np.array(short), 256) + (len(rows) - len(short)) + (6 if shard < 100 else 0)  # one for each tiny shard
    assert pack_documents(df.limit(0), PATH).count() == 0


def test_repeated_rows(spark):
    p = spark.createDataFrame([(1, 0, 0, 100, 5)] * 3 + [(2, 0, 0, 2048, 6)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    nameless = pack_documents(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id, r.length) for r in nameless) == [(None, 1), (None, 3)]
    rows = pack(p).collect()
    assert sorted(r.offset for r in rows if r.doc_id == 1) == [0, 100, 200] and len({r.sequence_id for r in rows}) == 2


def test_genetic_steps_keep_all_pieces():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 100, 300)
    a = Bins(size, 100)
    a.fit(list(range(300)))
    b = Bins(size, 100)
    b.fit(list(range(0, 300, 2)))
    b.fit(list(range(1, 300, 2)))
    for _ in range(5):
        c = crossover(a.bins, b.bins, size, 100, rng)
        assert sorted(i for x in c for i in x) == list(range(300)) and all(size[x].sum() <= 100 for x in c)
    best = evolve(size, 100, [b.bins], 1, 6, 20)
    assert len(best) <= len(b.bins) and sorted(i for x in best for i in x) == list(range(300))
    assert sorted(map(sorted, decode_bins(encode_bins(best, 300)))) == sorted(map(sorted, best))


def best_fit(size, capacity):
    b = Bins(size, capacity)
    b.fit(list(range(len(size))))
    return len(b.bins)


def test_search_improves_what_best_fit_leaves():
    rng, triples = np.random.default_rng(3), []
    for _ in range(60):  # three pieces that fill a bin
        a = int(rng.integers(380, 490))
        b = int(rng.integers(250, (1000 - a) // 2))
        triples += [a, b, 1000 - a - b]
    for size, capacity, saved in ((np.array(triples), 1000, 8), (rng.integers(20, 101, 1000), 150, 3)):
        found = evolve(size, capacity, [], 1)
        assert sorted(i for b in found for i in b) == list(range(len(size))) and max(size[b].sum() for b in found) <= capacity
        assert len(found) <= best_fit(size, capacity) - saved
        assert evolve(size, capacity, [found], 2) and len(evolve(size, capacity, [found], 2)) <= len(found)


def test_remainders_of_shards_are_packed_together(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 900, 1200))]
    got = pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), shard_size=60).collect()
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(r.doc_id for r in got) == list(range(1200)) and max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(r[3] for r in rows) // 2048) + 5  # twenty shards, each of which would round up
