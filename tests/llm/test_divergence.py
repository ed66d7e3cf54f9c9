import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm import divergence
from claimloom.llm.divergence import audit, folded


def brute(rows, least=10, best=10):
    """Every source with every other over every kept term."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(map(lower, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")))
        counts[lang, source] += terms
        counts[lang, None] += terms
        held[lang] += Counter(terms.keys())
    out = set()
    for lang in {k for k, _ in counts}:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for k, s in counts if k == lang and s is not None)
        p = {}
        for s in [*sources, None]:
            total = sum(counts[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total + 2 * len(kept)) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-gap(p[s][t], p[None][t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(sorted(pairs))}
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(sorted(terms)[:best])}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    words = ["the", "The", "öl", "ÖL", "straße", "x1y", "日本", "don't", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8))]
    rows = [(i, rng.choice([" ", "\n", "-"]).join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", None, "xx"]), rng.choice(["s1", "s1", "s1", "s2", "S2", None, "s10", "é"])) for i in range(n)]
    return [*rows, (1, None, "en", "only null"), (2, "", "one", "alone"), (2, "", "one", "alone"), (None, "x\x00y the " * 20000, "en", "s1"), (5, "rare terms here", "few", "a"), (6, "rare", "few", "b")]


def test_equal_to_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit(1)).withColumn("value", F.lit("v"))
    want = brute(rows)
    assert found(audit(df)) == want and {r[0] for r in want} == {"en", "de", "", "xx", "few"}
    assert found(audit(df, 3, 2)) == brute(rows, 3, 2)
    assert audit(df.limit(0)).count() == 0


def test_shards_add_up_again_and_again(spark, monkeypatch):
    rows = corpus(120, 9)
    monkeypatch.setattr(divergence, "FULL", 50)  # also in the tasks: the counts of a batch are written out many times
    batches = [pa.RecordBatch.from_pydict({"lang": [r[2] or ""], "source": [r[3] or ""], "text": [r[1] or ""]}) for r in rows]
    parts = [b for b in divergence._count(iter(batches)) if b.num_rows]
    kept = pa.Table.from_batches(list(divergence._keep(10)(iter(parts)))).to_pylist()
    whole = {(r["lang"], r["term"]): r["n"] for r in kept if r["whole"]}
    one = pa.Table.from_batches(list(divergence._keep(10)(divergence._count(iter([pa.Table.from_batches(batches).combine_chunks().to_batches()[0]]))))).to_pylist()
    assert whole and whole == {(r["lang"], r["term"]): r["n"] for r in one if r["whole"]}


def test_folded():
    t = pa.array(["Hé llo A9b", None, "Z[{@`", ""])
    assert folded(t).to_pylist() == ["hé llo a b", "", "z    ", ""] and folded(t.slice(2)).to_pylist() == ["z    ", ""] and folded(t.slice(0, 0)).to_pylist() == []
