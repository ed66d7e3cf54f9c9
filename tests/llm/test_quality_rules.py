import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.quality_rules import js_distance, judge, measure
from claimloom.llm.textbuf import Block


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g in grams if grams.count(g) > 1}
    hit = {i + k for i, g in enumerate(grams) if g in many for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts_equal_plain_python(spark):
    rng = random.Random(3)
    bits = ["the", " ", " ", "\n", "\n", "a#*b", "é日", "\t", "\x1c", "%", "x y z u v w", "\r", " ", "| one two three four five\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "\n\n", "a b c d e f " * 4000]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumn("kept", F.lit(1))
    got = judge(df).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id == len(texts) - 1:
            assert (r.n_words, r.n_repeat_words, r.base_failed) == (24000, 24000, True)
            continue
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert judge(spark.createDataFrame([(None, "a b", None)], "doc_id long, text string, lang string")).first().n_words == 2
    assert judge(df.limit(0)).count() == 0


def test_method_rejects_strange_texts(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of", "and", "to", "in", "is", *(f"{rng.choice('bcdfg')}o{rng.choice('lmnr')}e{k}n".replace(str(k), "a") for k in range(9))])
    good = [" ".join(word() for _ in range(80)).capitalize() + "." for _ in range(200)]
    bad = [" ".join(word() + rng.choice(["%%%", "***", "$$$"]) for _ in range(80)), "!! ".join(word().upper() for _ in range(80))]
    rows = [(i, t, "en" if i < 200 else None) for i, t in enumerate(good + bad)]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(200)) and not got[200].kept and not got[201].kept
    nothing = spark.createDataFrame([r[:2] + (None,) for r in rows], "doc_id long, text string, lang string")
    assert all(r.kept != r.base_failed for r in judge(nothing).collect())


def test_distance():
    p = np.array([[1.0, 0, 0], [0, 2, 2], [0, 0, 0]])
    assert np.allclose(js_distance(p, np.array([5.0, 0, 0])), [0, 1, 1])
    m = measure(Block(pa.array(["Ab1 é\n", ""])))
    assert m["classes"][0].tolist() == [1, 1, 1, 1, 1, 0, 0, 0, 1, 0] and m["classes"][1].sum() == 0
