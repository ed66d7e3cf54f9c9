import itertools

from pyspark.sql import functions as F

from claimloom.functions import quotes as Q
from claimloom.functions.grading import graded, is_retracted, screened, study_type_of_publication, verify_methods
from claimloom.functions.text import lookup_key, maybe_alias
from claimloom.operators import memo as M
from claimloom.operators import resolve as R

from .factory import claim, claims

CACHE = "key string, id string, label string, category string, source string, confidence double, ancestors array<string>, parents array<string>"


def test_cascade(spark):
    cache = spark.createDataFrame([("treg", "CL:1", "Treg", "cell_type", "ols", 0.9, [], [])], CACHE)
    terms = spark.createDataFrame([("CHEBI:2", "lactate", ["lactic acid"], "chebi"), ("NCIT:9", "lactate", [], "ncit"), ("PR:5", "interleukin-10 (chicken)", ["IL-10"], "pr"), ("PR:6", "interleukin-10 (human)", ["IL-10"], "pr"), ("NCIT:7", "HDAC9 wt Allele", ["HDAC9"], "ncit")], "obo_id string, label string, synonym array<string>, ontology_name string")
    verdicts = spark.createDataFrame([("milk acid", "lactates", "chemical", 0.8), ("odd thing", "Strange", "", 0.4)], "surface string, normalized_label string, category string, confidence double")
    surfaces = spark.createDataFrame([(s,) for s in ("Tregs", "Lactic acid", "IL-10", "GO:123", "milk acid", "odd thing", "HDAC9", "")], "surface string")
    got = {r.surface: r for r in R.resolve(surfaces, cache, terms, verdicts).collect()}
    assert {k: v.id for k, v in got.items()} == {"Tregs": "CL:1", "Lactic acid": "CHEBI:2", "IL-10": "PR:6", "GO:123": "GO:123", "milk acid": "CHEBI:2", "odd thing": "LOCAL:strange", "HDAC9": "LOCAL:hdac9", "": "LOCAL:unknown"}
    assert got["odd thing"].source == "llm" and got["odd thing"].category == "unknown" and got["Lactic acid"].category == "chemical"
    assert {r.key for r in R.saved_cache(cache, R.resolve(surfaces, cache, terms, verdicts)).collect()} == {"treg", "lactic acid", "il 10", "go 123", "milk acid", "odd thing"}


def test_hierarchy_and_aliases(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "id string, parent string")
    up = {r.id: r.ancestors for r in R.ancestors_of(e).collect()}
    assert up["n0"] == [f"n{i}" for i in range(1, 10)] and up["n8"] == ["n9"]
    roots = {r.child: r.root for r in R.canonical(e.toDF("child", "parent")).collect()}
    assert roots == {f"n{i}": "n9" for i in range(9)}
    concepts = [("CHEBI:1", "lactate", "chemical", 0.9), ("LOCAL:sodium_lactate", "sodium lactate", "unknown", 0.8), ("LOCAL:lactic_acid", "lactic acid", "chemical", 0.8), ("CL:1", "lactate cell", "cell_type", 0.9), ("X:1", "zzz", "chemical", 0.1)]
    c = spark.createDataFrame(concepts, "id string, label string, category string, confidence double")
    got = {(r.lo, r.hi) for r in R.alias_candidates(c).collect()}
    keys = {r.id: r.k for r in c.select("id", lookup_key(F.col("label")).alias("k")).collect()}
    cat = {i: k for i, _, k, _ in concepts}
    pairs = spark.createDataFrame([(a, b, keys[a], keys[b]) for a, b in itertools.combinations(sorted(keys), 2)], "lo string, hi string, a string, b string")
    want = {(r.lo, r.hi) for r in pairs.where(maybe_alias(F.col("a"), F.col("b"))).collect() if cat[r.lo] == cat[r.hi] or "unknown" in (cat[r.lo], cat[r.hi])}
    assert got == want and ("CHEBI:1", "LOCAL:sodium_lactate") in got and ("CHEBI:1", "CL:1") not in got
    asked = spark.createDataFrame([("CHEBI:1", "LOCAL:sodium_lactate", "lactate", "sodium lactate")], "lo string, hi string, label_lo string, label_hi string")
    v = R.alias_verdicts(asked, spark.createDataFrame([("sodium lactate", "lactate", True), ("q", "r", True)], "label_a string, label_b string, same_entity boolean"))
    assert {(r.child, r.parent) for r in R.alias_groups(c, v).collect()} == {("LOCAL:sodium_lactate", "CHEBI:1")}


def test_claims_get_concepts(spark):
    c = claims(spark, claim("c1", subject="colonic Treg differentiation", object="IFNG expression in the spleen", context_cell_type="", context_tissue="colon"))
    ents = spark.createDataFrame([("Treg",), ("IFNG",)], "surface string")
    got = R.with_concepts(c, R.resolve(ents, spark.createDataFrame([], CACHE)), spark.createDataFrame([("LOCAL:ifng", "LOCAL:treg")], "child string, root string")).first()
    assert (got.subject_concept, got.object_concept, got.object_label) == ("LOCAL:treg", "LOCAL:treg", "Treg") and got.subject_attribute == "differentiation" and got.context_tissue == "colon, spleen" and got.context_concept == ""


def test_upserts_and_reading(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert {tuple(r) for r in M.upsert(old, new, "k").collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {tuple(r) for r in M.first_wins(old, new, "k").collect()} == {(1, "a"), (2, "b"), (3, "C")}
    assert {tuple(r) for r in M.last_wins(old.unionByName(new).withColumn("n", F.when(F.col("v") < "Z", 2).otherwise(1)), "k", "n").collect()} == {(1, "a", 1), (2, "B", 2), (3, "C", 2)}
    papers = spark.createDataFrame([("p1", "included", 50, ["k"], []), ("p2", "included", 90, [], []), ("p3", "included", 70, [], []), ("p4", "excluded", 99, ["k"], []), ("p5", "included", 10, [], [])], "pmid string, screen_status string, relevance_score int, retrieved_for array<string>, read_for array<string>")
    order = M.reading_order(papers, spark.createDataFrame([("p1",), ("p5",)], "pmid string"), 2).orderBy("place").collect()
    assert [(r.pmid, r.pending) for r in order] == [("p1", ["k"]), ("p2", [])]
    hits = spark.createDataFrame([("p2", "k"), ("p2", "j"), ("p1", "k")], "pmid string, target string")
    assert {r.pmid: r.retrieved_for for r in M.retrieved_for(papers, hits).collect()}["p2"] == ["j", "k"]


def test_numbering_and_duplicates(spark):
    known = spark.createDataFrame([("p1", "Span one", "a", "increases", "b")], "pmid string, span string, subject string, relation string, object string")
    rows = spark.createDataFrame([("p1", 0, "span one!", "a", "increases", "b", ""), ("p1", 1, "span two", "aa and cc", "increases", "b", "x"), ("p1", 2, "span two", "aa", "increases", "b", ""), ("p2", 0, "s", "a", "r", "b", "")], "pmid string, n int, span string, subject string, relation string, object string, context_tissue string")
    got = M.fresh_claims(M.split_entities(rows), known.limit(1)).collect()
    assert sorted((r.id, r.subject) for r in got) == [("Cp1_1", "aa"), ("Cp1_2", "cc"), ("Cp2_0", "a")]


def test_verdicts_by_position(spark):
    pairs = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f")], "lo string, hi string")
    asked = M.pair_batches(pairs, pairs.where("lo = 'c'"), 30)
    answers = spark.createDataFrame([(0, 1, True, True), (0, 9, True, True)], "batch int, pair int, same_finding boolean, same_context boolean")
    ok, failed = M.positional_verdicts(asked, answers)
    assert [(r.lo, r.hi) for r in ok.collect()] == [("a", "b")] and [(r.lo, r.hi) for r in failed.collect()] == [("e", "f")]
    assert [M.semantic_status(*x) for x in ((0, 0, 0), (3, 2, 0), (3, 2, 2), (3, 2, 1))] == ["NO_CANDIDATES", "COMPLETE", "UNAVAILABLE", "PARTIAL"]


def test_relations_are_typed_once(spark):
    c = claims(spark, *(claim(i, relation="", relation_raw=raw, subject=s) for i, raw, s in (("c1", "increased", "Tet2 loss"), ("c2", "weird", "x"), ("c3", "odd", "y"))), claim("c4", relation="decreases", subject="Tet2 loss"))
    v = spark.createDataFrame([("c2", "binds", 0.7)], "claim_id string, canonical_relation string, confidence double")
    got = {r.id: (r.relation_norm, r.relation_source) for r in M.typed_relations(c, v).collect()}
    assert got["c1"] == ("decreases", "lexical") and got["c2"] == ("binds", "llm") and got["c3"][0] == "" and got["c4"][0] == "decreases"


def test_queries(spark):
    t = spark.createDataFrame([("a|increases|b", "a", "b", "Alpha", "Beta")], "key string, subject string, object string, subject_label string, object_label string")
    s = spark.createDataFrame([("a", "al"), ("a", "alp"), ("a", "alph"), ("a", "alphaa"), ("b", "Beta")], "id string, name string")
    q = M.synonym_queries(t, s)
    assert q.first().query == "((al) OR (alp) OR (alph) OR (Alpha)) AND ((Beta))"
    planned = spark.createDataFrame([("q1", "gap_null", "a|increases|b"), ("q2", "gap_null", "zz")], "query string, intent string, target string")
    assert M.kept_queries(planned, t, q).count() == 2
    log = M.search_log(planned.withColumn("query_id", F.col("query")), spark.createDataFrame([("q1", True, ["1"], ["x"])], "query_id string, ok boolean, pmids array<string>, ignored_terms array<string>"))
    assert [tuple(r) for r in M.target_searches(log).orderBy("key").collect()] == [("a|increases|b", 1, 0), ("zz", 0, 0)]
    assert M.search_status(log, 0).first().status == "ZERO_NEW_RESULTS"


def test_grading(spark):
    full = {"text_access": "full_text", "relation": "increases"}
    c = claims(
        spark, claim("rct", study_type="human_rct", perturbation_class="pharmacological", system="human_in_vivo", **full), claim("open", study_type="human_rct", perturbation_class="pharmacological", comparator_present=False, **full),
        claim("abs", study_type="human_rct", perturbation_class="pharmacological", system="human_in_vivo"), claim("mouse", study_type="human_cohort", perturbation_class="knockout", rescue_arm=True, system="animal_in_vivo", **full),
        claim("null", study_type="human_primary", **(full | {"relation": "no_effect"})), claim("rev", study_type="review", **full), claim("raw", **(full | {"relation": ""})),
    )
    g = {r.id: r for r in graded(c, "human").collect()}
    assert {k: r.grade for k, r in g.items()} == {"rct": "strong", "open": "weak", "abs": "moderate", "mouse": "moderate", "null": "moderate", "rev": "weak", "raw": "weak"}
    assert g["mouse"].grade_detail.caps == ["indirect_system"] and g["abs"].grade_detail.caps == ["abstract_only"] and g["null"].grade_detail.caps == ["null_without_power"] and g["raw"].grade_detail.caps == ["unresolved_relation"]
    assert g["open"].grade_detail.limiting_axis == "causal" and not g["null"].grade_detail.causal_applicable


def test_methods_screening_and_types(spark):
    c = claims(spark, claim("c1", perturbation_class="knockout", rescue_arm=True, span="Tbx21−/− mice versus controls"), claim("c2", perturbation_class="knockdown", span="nothing said", methods_span="siRNA was used"))
    got = {r.id: r for r in verify_methods(c, F.lit(False)).collect()}
    assert got["c1"].perturbation_class == "knockout" and not got["c1"].rescue_arm and got["c1"].comparator_present and got["c1"].method_checks == ["rescue_arm not evidenced"]
    assert got["c2"].perturbation_class == "none" and "perturbation 'knockdown' not evidenced" in got["c2"].method_checks
    assert {r.id: r for r in verify_methods(c, F.lit(True)).collect()}["c2"].perturbation_class == "knockdown"
    t = spark.createDataFrame([(["Review", "Meta-Analysis"],), (["Journal Article"],), (["Expression of Concern"],)], "t array<string>")
    assert [tuple(r) for r in t.select(study_type_of_publication(F.col("t")), is_retracted(F.col("t"))).collect()] == [("meta_analysis", False), (None, False), (None, True)]
    papers = spark.createDataFrame([(p, "unscreened", p == "p4", None, None, None, "human_rct" if p == "p1" else None) for p in ("p1", "p2", "p3", "p4", "p5")], "pmid string, screen_status string, retracted boolean, relevance_score int, relevance_reason string, study_type string, pubtype_study_type string")
    v = spark.createDataFrame([("p1", True, 80, "ok", "animal"), ("p2", True, 40, "meh", "animal"), ("p3", False, 90, "off", "animal"), ("p4", True, 99, "x", "animal")], "pmid string, relevant boolean, relevance_score int, reason string, study_type string")
    s = {r.pmid: (r.screen_status, r.relevance_reason, r.study_type) for r in screened(papers, v).collect()}
    assert s == {"p1": ("included", "ok", "human_rct"), "p2": ("excluded", "below relevance cut-off: meh", "animal"), "p3": ("excluded", "off", "animal"), "p4": ("excluded", "retracted / expression of concern", None), "p5": ("unscreened", None, None)}


def test_quotes(spark):
    src = "Mice were fed. Lactate strongly increased histone lactylation in T cells of the colon. It was not seen before (HDAC9)."
    assert Q.anchored("Lactate strongly increased histone lactylation in T cells", src) and not Q.anchored("Mice stitched fed lactate from seen before elsewhere", src) and not Q.anchored("short", src)
    assert not Q.anchored("Lactate increased never histone lactylation cells colon", src)
    df = spark.createDataFrame([("Lactate strongly increased  histone lactylation", src), ("x", src), (None, src)], "a string, b string")
    assert [r[0] for r in df.select(Q.is_anchored(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    span = "Lactate strongly increased histone lactylation in T cells of the colon."
    neg = "Lactate did not increase histone lactylation here at all."
    far = "Lactate, which was not among the agents, increased histone lactylation in cells."
    but = "Butyrate but not lactate increased the histone lactylation of all cells."
    short = "Sodium butyrate (NaB) was added. We saw that NaB increased histone lactylation (H3K) in cells. It raised H3K much more than before."
    cases = [
        ("lactate", "increased", "histone lactylation", span, src, "", []), ("lactate", "no effect", "histone lactylation", span, src, "null claim but the quote reports an effect", []),
        ("lactate", "increased", "GPR81", span, src, "object not named in quote", []), ("mannose", "increased", "GPR81", span, src, "subject not named in quote", []),
        ("lactate", "binds", "histone", span, src, "", ["relation wording not in quote"]), ("lactate", "is", "histone", span, src, "", ["relation wording not in quote"]),
        ("lactate", "increases", "histone", neg, neg, "quote negates the claimed effect", []), ("lactate", "no effect", "histone", neg, neg, "", []), ("lactate", "increases", "histone", far, far, "", []),
        ("lactate", "increases", "histone", but, but, "", []), (" It.", "increased", "GPR81", span, src, "subject not specified", []), ("lactate", "increased", "n/a", span, src, "object not specified", []),
        ("sodium butyrate", "increased", "lactylation", "We saw that NaB increased histone lactylation (H3K) in cells.", short, "", []),
        ("NaB", "raised", "H3K", "It raised H3K much more than before.", short, "", []), ("vorinostat", "raised", "H3K", "It raised H3K much more than before.", short, "subject not named in quote", []),
        ("mice", "increased", "histone", span, src, "subject not named in quote", []), ("T", "increased", "histone", span, src, "", []), ("q", "increased", "histone", span, src, "subject not named in quote", []),
        ("lactate", "increased", "histone", "nothing of this stands in the source", src, "quote not found in source", []), ("lactate", "increased", "histone", None, None, "quote not found in source", []),
    ]
    df = claims(spark, *({**claim(f"c{i}", f"p{i}", span=s, subject=a, object=o), "relation": r} for i, (a, r, o, s, *_) in enumerate(cases)))
    got = {r.id: r for r in Q.checked_claims(df, spark.createDataFrame([(f"p{i}", c[4]) for i, c in enumerate(cases)], "pmid string, source_text string")).collect()}
    for i, (*_, reason, warnings) in enumerate(cases):
        r = got[f"c{i}"]
        assert (r.drop_reason, r.method_checks, r.anchored) == (reason, warnings, reason == ""), cases[i]
    tiers = ["X does not induce Y", "X induced Y", "X may reduce Y", "more induced regulatory T cells", "We do not establish that X causes Y", "", None, "Not so: X, of all of these, induces Y", "no X reduced Y but Z drives Y", "[induces1] X is linked to Y", "needs to suggest", "re-induces"]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(tiers)), "i int, s string").orderBy("i").select(Q.sentence_tier(F.col("s"))).collect()] == [1, 4, 3, 0, 0, 0, 0, 4, 4, 1, 0, 4]
    prose = ["# T\n- A b c. Next one\n```\ncode\n```\n|t|\nEnd [L1]. [H1] x.", "a\r\n``` x\nin\n  ```y\n1) B. c! D\n```\nopen", None, "", "e.g. x. [T1] y?  Z"]
    assert [r[0] for r in spark.createDataFrame(list(enumerate(prose)), "i int, s string").orderBy("i").select(Q.prose_sentences(F.col("s"))).collect()] == [["A b c.", "Next one End [L1].", "[H1] x."], ["a B. c!", "D"], [], [], ["e.g. x.", "[T1] y?", "Z"]]
    known = spark.createDataFrame([(short,)], "s string").select(Q.abbreviations(F.col("s"))).first()[0]
    assert [tuple(k) for k in known] == [("nab", "sodium butyrate"), ("h3k", "saw that nab increased histone lactylation")]
    assert spark.createDataFrame([("B here.", "One. Two more!  B here.")], "a string, b string").select(Q.sentence_before(F.col("a"), F.col("b"))).first()[0] == "two more!"
    c = Q.checked_claims(claims(spark, claim("c1", span=span, subject="lactate", object="GPR81", relation="increased")), spark.createDataFrame([("p1", src)], "pmid string, source_text string")).first()
    assert c.drop_reason == "object not named in quote" and not c.anchored
    c = Q.checked_claims(claims(spark, claim("c1", span=span, subject=" It.", object="GPR81", relation="increased")), spark.createDataFrame([("p1", src)], "pmid string, source_text string")).first()
    assert c.drop_reason == "subject not specified"
