import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from claimloom.llm.tiered_search import search


def brute(docs, items, best=10):
    """Every document scored for every item."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")
    terms = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(s))
    held = [Counter(terms(t)) for _, t in docs]
    n, length = sum(1 for h in held if h), sum(sum(h.values()) for h in held)
    df = Counter(t for h in held for t in h)
    out = []
    for item, text in items:
        scores = []
        for row, ((doc, _), h) in enumerate(zip(docs, held, strict=True)):
            score = 0
            for t in terms(text):
                if t in h:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 25 + (75 * sum(h.values()) * n) // length
                    score += w * ((10**9 * h[t]) // (1000 * h[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc, row))
        scores.sort(key=lambda s: (s[0], s[1], s[2] if s[2] is not None else 0))
        out += [(item, i + 1, s[2], -s[0]) for i, s in enumerate(scores[:best])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in "aeiou" for c in "lmnrst12"]
    common = ["the", "The", "of", "öl", "日本", "x-y", "a1"]
    text = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(common) if rng.random() < 0.5 else words[min(int(rng.expovariate(0.02)), len(words) - 1)] for _ in range(k))
    docs = [(i, text(rng.randrange(120))) for i in range(n)]
    passage = text(30)
    docs += [(1000 + i, f"{text(10)} {passage} {text(5)}") for i in range(4)] + [(2000 + i, docs[7][1]) for i in range(30)] + [(2000, docs[7][1]), (None, docs[7][1]), (None, passage), (3, None), (4, ""), (5, "!!! --"), (9, "the " * 60_000 + "unique")]
    items = [(1, passage), (2, docs[7][1][:200]), (3, text(25)), (4, "the of"), (5, None), (6, "zzz qqq"), (7, "the the the bal"), (8, ""), (3, text(12)), (None, "unique the")]
    return docs, items + [(10 + i, text(rng.randrange(1, 40))) for i in range(20)]


SCHEMA = "doc_id long, text string"


def test_equal_to_brute_force_in_all_tiers(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, SCHEMA).withColumn("row", F.lit(7)).withColumn("score", F.lit("s")).withColumn("terms", F.lit(1))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(7))
    told = []
    want = brute(docs, items)
    assert got(search(d, q, told=told)) == want and any(r[3] for r in want)
    assert sum(p for _, _, p in told) == len([t for _, t in items if t is not None]) and any(p for k, _, p in told if k < 5), told  # some are proven early
    assert got(search(d, q, best=3, tiers=2, most_items=4)) == brute(docs, items, 3)  # blocks of items, two tiers
    assert got(search(d, q, tiers=1)) == want


def test_without_documents_or_items(spark):
    docs, items = corpus(20)
    d, q = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    assert search(d.limit(0), q).count() == 0 and search(d, q.limit(0)).count() == 0
    assert search(spark.createDataFrame([(1, None), (2, "..")], SCHEMA), q).count() == 0
    assert got(search(spark.createDataFrame([(1, "bal")], SCHEMA), spark.createDataFrame([(1, "bal Bal")], "item_id long, text string"))) == brute([(1, "bal")], [(1, "bal Bal")])
