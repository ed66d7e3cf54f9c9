import random
import re

import pytest
from pyspark.sql import functions as F

from claimloom.functions import quotes
from claimloom.functions import text as X

CASES = [
    (X.clean, "  NFAT1 – x, ", "NFAT1 - x"), (X.clean, "histone deacetylase (HDAC)", "histone deacetylase"), (X.clean, "receptor (CD25", "receptor"),
    (X.clean, "cell (TC)", "cell (TC)"), (X.clean, "(lactate)", "lactate"), (X.clean, None, ""), (X.clean, "a (b", "a (b"),
    (X.lookup_key, "IFN-γ", "ifn gamma"), (X.lookup_key, "IFN-α", "ifn alpha"), (X.lookup_key, "NAD(+)", "nad+"), (X.lookup_key, "NAD⁺", "nad+"), (X.lookup_key, "NAD+", "nad+"),
    (X.local_id, "Histone lactylation", "LOCAL:histone_lactylation"), (X.local_id, "", "LOCAL:unknown"),
    (X.singular, "regulatory T cells", "regulatory T cell"), (X.singular, "diabetes", "diabetes"), (X.singular, "bodies", "body"), (X.singular, "HDACs", "HDACs"), (X.singular, "virus", "virus"), (X.singular, "mass", "mass"),
    (X.lexical_relation, "Up_regulates", ""), (X.lexical_relation, "is required for", "required_for"), (X.lexical_relation, "no-effect on", "no_effect"), (X.lexical_relation, "sufficient_for", "sufficient_for"), (X.lexical_relation, "unresolved", ""), (X.lexical_relation, None, ""),
    (X.species, "interleukin-10 (chicken)", "other"), (X.species, "interleukin-10", "agnostic"), (X.species, "x (Homo sapiens)", "human"), (X.species, "x (IL-2)", "agnostic"),
]
PAIRS = [
    (X.split_change, "age-related NAD+ decline", ("NAD+", "down")), (X.split_change, "bone loss", ("bone loss", "")), (X.split_change, "deficiency of the vitamin D", ("vitamin D", "down")), (X.split_change, "Tet2 loss", ("Tet2", "down")),
    (X.split_attribute, "IFNG expression", ("IFNG", "expression")), (X.split_attribute, "Treg differentiation", ("Treg", "differentiation")), (X.split_attribute, "cell numbers", ("cell numbers", "none")), (X.split_attribute, "induction of the Treg cells", ("Treg cells", "differentiation")), (X.split_attribute, "levels of IL-6", ("IL-6", "amount")),
    (X.split_location, "Bone marrow, splenic and Peyer's patch regulatory T cells", ("regulatory T cells", "bone marrow, spleen, Peyer's patch")), (X.split_location, "Tregs in the mesenteric lymph nodes", ("Tregs", "lymph node")), (X.split_location, "lung", ("lung", "")), (X.split_location, "colonic cells", ("colonic cells", "")), (X.split_location, "splenic colon", ("colon", "spleen")),
    (X.entity_of, "colonic Treg induction", ("Treg", "differentiation", "colon")), (X.entity_of, "TGF-beta-induced Treg cells", ("Treg cells", "none", "")),
    (X.entity_parts, "NFAT1 and SMAD3", (["NFAT1", "SMAD3"], "")), (X.entity_parts, "Tet2−/− bone marrow", (["Tet2−/− bone marrow"], "")), (X.entity_parts, "GPR81/HCAR1", (["GPR81", "HCAR1"], "")),
    (X.entity_parts, "signal transducer and activator of transcription 3", (["signal transducer and activator of transcription 3"], "")), (X.entity_parts, "splenic CD4, CD8 and NK", (["CD4", "CD8", "NK"], "spleen")),
]


def value(spark, f, s):
    return spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("v")).first().v


@pytest.mark.parametrize(("f", "s", "want"), CASES)
def test_names(spark, f, s, want):
    assert value(spark, f, s) == want


@pytest.mark.parametrize(("f", "s", "want"), PAIRS)
def test_parts(spark, f, s, want):
    assert tuple(value(spark, f, s)) == want


def test_five_spellings_are_one_entity(spark):
    forms = ["regulatory T cells", "colonic regulatory T cells", "Regulatory T cell", "regulatory T cells in the spleen", "induction of regulatory T cells"]
    df = spark.createDataFrame([(s,) for s in forms], "s string")
    assert {r[0] for r in df.select(X.lookup_key(X.singular(X.entity_of(F.col("s"))["entity"]))).collect()} == {"regulatory t cell"}


def test_alias_prefilter_and_blocks(spark):
    df = spark.createDataFrame([("sodium lactate", "lactate"), ("abcd x", "abcd y"), ("ifng", "interferon gamma"), ("xy", "zq")], "a string, b string")
    assert [r[0] for r in df.select(X.maybe_alias(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
    got = spark.range(1).select(X.block_keys(F.lit("C1"), F.array(F.lit("P1")), F.lit("Sodium lactate cells"))).first()[0]
    assert got == ["C1", "P1", "stem:sodiu", "stem:lacta"]


def test_quotes_with_words_left_out_equal_a_plain_scan():
    """Sentence by sentence and stretch by stretch, word after word."""
    rng, words = random.Random(8), ["lactate", "raises", "cells", "not", "no", "in", "the", "marked", "never", "ifng", "strongly", "trial"]

    def scan(quote, have):
        if not quotes.NEGATION_TOKENS & set(quote) <= set(have):
            return False
        at = hits = 0
        for w in quote:
            if w in have[at:]:
                at, hits = have.index(w, at) + 1, hits + 1
        return hits / len(quote) >= quotes.LEAST_SHARE

    def plain(span, source):
        s, text = quotes.unified(span), quotes.unified(source)
        if len(s) < 20 or s in text:
            return len(s) >= 20
        quote, have = quotes.content_words(s), quotes.content_words(text)
        wide = max(2 * len(quote), len(quote) + 10)
        parts = [quotes.content_words(x) for x in re.split(r"(?<=[.!?])\s+", text)] + [have[i : i + wide] for i in range(max(1, len(have) - wide + 1))]
        return any(scan(quote, p) for p in parts) if quote else False

    seen = set()
    for _ in range(1500):
        source = " ".join(rng.choice(words) + rng.choice(["", "", "", "."]) for _ in range(rng.randrange(60)))
        cut = source.replace(".", "").split()
        i = rng.randrange(len(cut) + 1)
        span = " ".join(w for w in cut[i : i + rng.randrange(4, 16)] if rng.random() < 0.9)
        if rng.random() < 0.3:
            span = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 12)))
        got = quotes.anchored(span, source)
        assert got == (plain(span, source) if span and source else False), (span, source)
        seen.add((got, quotes.unified(span) in quotes.unified(source)))
    assert {(True, False), (True, True), (False, False)} <= seen
    assert quotes.anchored("lactate strongly raises ifng in cells", ("the trial marked cells. " * 20_000) + "lactate strongly then raises ifng in the cells")
