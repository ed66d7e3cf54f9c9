from pyspark.sql import functions as F

from claimloom.operators.links import build_links, discounted_pairs, exhausted_searches

from .factory import claim, claims


def edge(df, key="LOCAL:a|increases|LOCAL:b"):
    return df.where(F.col("key") == key).first()


def test_weak_support_keeps_the_grade_and_contradiction_blocks(spark):
    c = [claim("c1", "p1"), claim("c2", "p2")]
    two = edge(build_links(claims(spark, *c)))
    three = edge(build_links(claims(spark, *c, claim("c3", "p3", grade="weak"))))
    assert two.grade == three.grade == "strong" and two.status == "supported" and two.reason == "2 papers, best grade strong" and three.n_studies == 3
    bad = edge(build_links(claims(spark, claim("c1"), claim("c4", "p4", "decreases"), claim("c5", "p5", "no_effect"))))
    assert bad.status == "contradicted" and bad.reason == "2 opposing vs 1 supporting papers" and bad.contradicting_ids == ["c4", "c5"]


def test_opposing_context(spark):
    pairs = spark.createDataFrame([("c1", "c4"), ("c1", "c5")], "lo string, hi string")
    run = lambda **kw: edge(build_links(claims(spark, claim("c1"), claim("c4", "p4", "decreases", **kw), claim("c5", "p5", "no_effect", **kw)), discounted=pairs))
    assert run().status == "contradicted"
    other = run(context_cell_type="tumor")
    assert other.status == "insufficient" and set(other.uncounted) == {"c4", "c5"} and other.uncounted["c4"].startswith("different context")
    assert run(context_cell_type="tumor", system="human_primary_cells").status == "contradicted"
    conflicts = spark.createDataFrame([("context_dependent", ["c4", "c1", "c5"]), ("true_conflict", ["x", "y"])], "verdict string, claim_ids array<string>")
    assert {tuple(r) for r in discounted_pairs(conflicts).collect()} == {("c1", "c4"), ("c1", "c5"), ("c4", "c5")}


def test_floor_null_asymmetry_and_reviews(spark):
    weak = edge(build_links(claims(spark, claim("c1", grade="weak"), claim("c2", "p2", grade="weak"))))
    assert weak.status == "insufficient" and weak.reason == "only weak evidence (2 papers)"
    null = edge(build_links(claims(spark, claim("c1"), claim("c2", "p2"), claim("n1", "p3", "no_effect", "moderate"), claim("n2", "p4", "no_effect", "moderate"))))
    assert null.status == "supported" and set(null.uncounted) == {"n1", "n2"} and null.n_contra_studies == 0
    review = edge(build_links(claims(spark, claim("c1"), claim("r1", "p2", grade="weak", study_type="review"))))
    assert review.n_studies == 1 and review.uncounted == {"r1": "secondary source (review)"} and review.reason == "1 of 2 required papers"
    only = edge(build_links(claims(spark, claim("r1", "p2", grade="weak", study_type="review"))))
    assert only.reason == "only secondary sources (reviews)" and only.completeness == 0


def test_rollup_to_ancestors(spark):
    c = claims(spark, claim("c1", object_concept="sub1"), claim("c2", "p2", object_concept="sub2"), claim("n", "p3", "no_effect", object_concept="sub1"), claim("t", "p9", "binds", object_concept="top"))
    up = spark.createDataFrame([("sub1", ["top", "sub1"]), ("sub2", ["top", "elsewhere"])], "concept string, ancestors array<string>")
    extra = spark.createDataFrame([("LOCAL:a|increases|top",)], "key string")
    got = edge(build_links(c, ancestors=up, extra=extra), "LOCAL:a|increases|top")
    assert got.status == "supported" and got.n_studies == 2 and got.n_contra_studies == 0
    assert edge(build_links(c, extra=extra), "LOCAL:a|increases|top").status != "supported"


def test_required_for_is_refuted_by_nulls(spark):
    got = edge(build_links(claims(spark, claim("c1", relation="required_for", grade="weak"), claim("n1", "p2", "no_effect", "moderate"), claim("n2", "p3", "no_effect", "moderate"))), "LOCAL:a|required_for|LOCAL:b")
    assert got.status == "contradicted"


def test_partners_corroborate_and_counts_do_not_double(spark):
    v = spark.createDataFrame([("c1", "c9", True), ("c1", "c8", False)], "lo string, hi string, same_finding boolean")
    c = claims(spark, claim("c1"), claim("c9", "p9", subject_concept="LOCAL:z"), claim("c8", "p8", subject_concept="LOCAL:y"), claim("c7", "p9"))
    got = edge(build_links(c, verdicts=v))
    assert got.corroborating_ids == ["c9"] and got.support_ids == ["c1", "c7"] and got.n_studies == 2


def test_states_and_reasons(spark):
    prior = spark.createDataFrame([("x|increases|y", 2, 1, False, "X", "Y"), ("x|increases|z", 2, 2, True, "X", "Z")], "key string, times_targeted int, zero_yield_count int, exhausted boolean, subject_label string, object_label string")
    got = {r.key: r for r in build_links(claims(spark), prior=prior).collect()}
    assert got["x|increases|y"].reason == "not found in 1 targeted search" and got["x|increases|y"].subject_label == "X"
    assert got["x|increases|z"].reason == "no study found in 2 targeted searches"
    targets = spark.createDataFrame([("x|increases|y", 2, 1), ("x|increases|z", 1, 1)], "key string, ok int, clean int")
    papers = spark.createDataFrame([("p", "included", ["other"], [])], "pmid string, screen_status string, retrieved_for array<string>, read_for array<string>")
    after = {r.key: r for r in exhausted_searches(prior, targets, papers, claims(spark), 2, False).collect()}
    assert after["x|increases|y"].zero_yield_count == 2 and after["x|increases|y"].exhausted and after["x|increases|z"].zero_yield_count == 2
    assert build_links(claims(spark)).count() == 0
