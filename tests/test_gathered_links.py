"""Edges with lists of ids: claims are shuffled neither by edge nor by paper, and give what listed verdicts give."""

import itertools
import random

from pyspark.sql import functions as F

from claimloom.operators import links as L

from .factory import claim, claims

SAME = lambda lo, hi: lo("control") & (lo("s") < hi("s")) & (lo("r") == hi("r"))


def made(spark, n=150):
    rng = random.Random(11)
    rows = [
        claim(
            f"c{i:03}", rng.choice(["p1", "p2", "p3", "p4", None]), rng.choice(["increases", "increases", "decreases", "no_effect", "associated_with", "required_for"]), rng.choice(["weak", "moderate", "strong"]),
            subject_concept=rng.choice(["a", "b", "c", None]), object_concept=rng.choice(["x", "x1", "x2", "y"]), comparator_present=rng.random() < 0.5, study_type=rng.choice(["animal", "review", None]),
            context_cell_type=rng.choice(["", "B Cell", "cd8"]), system=rng.choice(["animal_in_vivo", "human_in_vivo", "cell_line"]), text_access=rng.choice(["abstract_only", "full_text"]),
        )
        for i in range(n)
    ]
    rows.append(rows[0])  # a claim twice
    c = claims(spark, *rows)
    pairs = [(a["id"], b["id"], True) for a, b in itertools.permutations(rows, 2) if a["pmid"] and a["pmid"] == b["pmid"] and a["comparator_present"] and (a["subject_concept"] or "~") < (b["subject_concept"] or "") and a["relation_norm"] == b["relation_norm"]]
    group = lambda r: F.concat_ws("|", "subject_concept", "object_concept", "text_access", r)
    c = c.withColumn("conflict", group(F.when(F.col("relation_norm") == "increases", "+").when(F.col("relation_norm").isin("decreases", "no_effect"), "-").otherwise("")))
    aside = c.where("relation_norm = 'increases'").select(group(F.lit("+")).alias("lo"), group(F.lit("-")).alias("hi")).distinct()
    return c, spark.createDataFrame(pairs, "lo string, hi string, same_finding boolean"), aside


def test_a_rule_gives_what_listed_verdicts_give(spark):
    c, verdicts, aside = made(spark)
    up = spark.createDataFrame([("x1", "x"), ("x2", "x1")], "id string, parent string")
    prior = spark.createDataFrame([("a|increases|x", 2, 1, False), ("q|binds|z", 2, 2, True)], "key string, times_targeted int, zero_yield_count int, exhausted boolean")
    extra = spark.createDataFrame([("b|modulates|y",), ("b|modulates|z",)], "key string")
    labels = spark.createDataFrame([("a", "Alpha")], "id string, label string")
    plain = {r.key: r for r in L.build_links(c, prior, verdicts, aside, None, labels, extra, hierarchy=up).collect()}
    got = {r.key: r for r in L.build_links(c, prior, None, aside, None, labels, extra, hierarchy=up, same=SAME).collect()}
    assert got == plain
    assert any(r.corroborating_ids for r in got.values()) and any(L.OTHER_CONTEXT in r.uncounted.values() for r in got.values()) and any("|".join(("", "increases", "x")) in k for k in got)
    none = spark.createDataFrame([], verdicts.schema)
    assert {r.key: r for r in L.build_links(c).collect()} == {r.key: r for r in L.build_links(c, verdicts=none).collect()}


def test_no_claim_is_shuffled_for_lists(spark):
    c, _, aside = made(spark)
    up = spark.createDataFrame([("x1", "x")], "id string, parent string")
    for df in (L.build_links(c, discounted=aside, hierarchy=up, same=SAME), L.build_links(c)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "collect_set" in plan and "Exchange hashpartitioning" not in plan
