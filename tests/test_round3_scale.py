"""Queries whose work must follow the rows, not the pairs of equal rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import links as L
from claimloom.operators import pairs as P
from claimloom.sources import corpus as C

from .factory import claim, claims



def test_blocked_counts_and_pairs_of_classes(spark):
    rng = random.Random(5)
    rows = [claim(f"c{i:03}", subject_concept=rng.choice("ab") if i % 7 else None, object_concept=rng.choice("xyz"), subject_parents=rng.sample(["p", "q", "a"], rng.randrange(3)), subject_label="", object_label="") for i in range(80)]
    keys = {r["id"]: {(s, r["object_concept"]) for s in {r["subject_concept"], *r["subject_parents"]} - {None}} for r in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(keys), 2) if keys[a] & keys[b]}
    c = claims(spark, *rows, rows[1])
    got = [(r.lo, r.hi) for r in P.blocked_pairs(c).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert tuple(P.blocked_counts(c).first()) == (len(want), len({a for a, _ in want}))
    assert tuple(P.blocked_counts(c.limit(0)).first()) == (0, 0)


def test_blocked_counts_of_one_hot_block(spark):
    n = 300_000
    none = F.expr("cast(array() as array<string>)")
    hot = spark.range(n).select("id", F.lit("s").alias("subject_concept"), F.lit("o").alias("object_concept"), none.alias("subject_parents"), none.alias("object_parents"), F.lit("").alias("subject_label"), F.lit("").alias("object_label"))
    assert tuple(P.blocked_counts(hot).first()) == (n * (n - 1) // 2, n - 1)  # 4.5 * 10^10 pairs


def test_search_of_common_phrases(spark):
    n = 60_000
    papers = spark.range(n).select(F.col("id").alias("pmid"), (n - F.col("id")).alias("place"), F.array(F.lit("sun"), F.concat(F.lit("k"), F.col("id") % 7)).alias("keywords"))
    asked = spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("SUN of k"), F.col("id") % 9).alias("query"), (F.col("id") % 4).cast("int").alias("retmax"))
    got = C.CorpusTable(papers).search(asked)  # 3.6 * 10^9 hits
    first = {i: list(range(n - 1, n - 1 - i, -1)) for i in range(4)}
    assert {(r.k, tuple(r.pmids)): r.n for r in got.groupBy((F.col("query_id") % 4).alias("k"), "pmids").agg(F.count("*").alias("n")).collect()} == {(i, tuple(first[i])): n // 4 for i in range(4)}


def test_edges_of_reviews_and_pairs_of_conflicts(spark):
    rows = [claim("c0", "p0", "associated_with", study_type="review")]  # its grade stays open
    rows += [claim(f"u{i}", f"p{i}", "increases", context_cell_type="xy"[i % 2], system="human_in_vivo" if i % 3 else "in_vitro", text_access="ab"[i % 2]) for i in range(1, 9)]
    rows += [claim(f"d{i}", f"q{i}", "decreases", context_cell_type="xyz"[i % 3], system="animal_in_vivo" if i % 2 else "in_vitro", text_access="ab"[i % 2]) for i in range(1, 9)]
    c = claims(spark, *rows).withColumn("conflict", F.concat("text_access", F.when(F.col("relation_norm") == "increases", "+").otherwise("-")))
    classes = spark.createDataFrame([("a+", "a-"), ("b+", "b-")], "lo string, hi string")
    of = lambda access, r: [x["id"] for x in rows if x["text_access"] == access and x["relation_norm"] == r]
    listed = spark.createDataFrame([(x, y) for a in "ab" for x in of(a, "increases") for y in of(a, "decreases")], "lo string, hi string")
    got = {r.key: r for r in L.build_links(c, discounted=classes).collect()}
    want = {r.key: r for r in L.build_links(c.drop("conflict"), discounted=listed).collect()}
    assert got == want and any(L.OTHER_CONTEXT in r.uncounted.values() for r in got.values()) and any(r.contradicting_ids for r in got.values())
    assert got["LOCAL:a|associated_with|LOCAL:b"].grade == "ungraded" and got["LOCAL:a|associated_with|LOCAL:b"].reason == "only secondary sources (reviews)"


def test_families_within_papers(spark):
    rng = random.Random(8)
    rows = [claim(f"c{i:03}", f"p{i % 9}", rng.choice(["increases", "decreases", "no_effect", "binds"])) for i in range(120)]
    pairs = [(a["id"], b["id"], a["pmid"], True, rng.random() < 0.6) for a, b in itertools.combinations(rows, 2) if a["pmid"] == b["pmid"]]
    c = claims(spark, *rows)
    v = spark.createDataFrame(pairs + pairs[:50] + [("c000", "zzz", "p0", True, True)], "lo string, hi string, within string, same_finding boolean, same_context boolean")
    within = c.withColumn("within", F.col("pmid"))
    want = {r.key: (r.claim_ids, r.discordant) for r in P.families(c, v.drop("within")).collect()}
    assert {r.key: (r.claim_ids, r.discordant) for r in P.families(within, v).collect()} == want
    ok = v.where("same_context").select("lo", "hi", "within")
    few = P.complete_linkage(within.select("id", "within"), ok, few=50)  # all groups are too large for one task
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, P.complete_linkage(c.select("id"), ok.drop("within")).collect()))


def test_conflicts_of_claims_of_one_finding(spark):
    rng = random.Random(9)
    rows = [claim(f"c{i:03}", f"p{i % 6}", rng.choice(["increases", "decreases", "no_effect", "binds"])) for i in range(60)]
    c = claims(spark, *rows).withColumn("finding", F.col("pmid"))
    fams = spark.createDataFrame([("SEM::x", ["c000", "c006", "c012"], 1), ("SEM::y", ["c001", "c007"], 0)], "key string, claim_ids array<string>, discordant int")
    listed = spark.createDataFrame([(a["id"], b["id"], True) for a, b in itertools.combinations(rows, 2) if a["pmid"] == b["pmid"]], "lo string, hi string, same_finding boolean")
    got, want = (sorted((r.key, r.claim_ids, r.discordant) for r in x.collect()) for x in (P.conflict_candidates(c, fams), P.conflict_candidates(c, fams, listed)))
    assert got == want and len(got) > 50


def test_flags_of_chains_take_one_shuffle_of_the_claims(spark):
    from claimloom.operators import paths as H
    from claimloom.plans import catalog

    cats = F.map_from_entries(F.transform(H.nodes(F.col("links")), lambda n: F.struct(n, n)))
    flags = H.logic_flags(F.col("links"), F.col("contexts"), cats, F.lit("up"))
    assert str(flags).count("map_from_entries") == 1  # not once more for each step
    plan = catalog.chain_flags(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sections_of_a_long_body_in_one_walk(spark):
    n = 20_000  # cut by columns, 8 * 10^8 pieces were met
    body = "<body>" + "".join(f"<sec><title>t{i} \n</title> <p>a  b\tc</p></sec>" for i in range(n)) + "</body>"
    b = spark.createDataFrame([(1, "", body), (2, None, "")], "pmid long, abstract string, body string")
    out = C.sectioned_text(b, C.sections_of(b), 10**7)
    assert "zip_with" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.pmid: r.text for r in out.collect()}
    assert got == {1: "ABSTRACT: \n\nOTHER: " + " ".join(f"t{i} a b c" for i in range(n)), 2: "ABSTRACT: "}
