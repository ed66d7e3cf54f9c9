import pytest
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.operators import report as R
from claimloom.operators import telemetry as T
from claimloom.sources import corpus as C

from .factory import claim, claims


def test_sections_in_priority_and_budget(spark):
    body = "<body><sec><title>Methods</title><p>mm <b>m</b></p></sec><sec><title>Results</title><p>rr</p><fig><caption>legend &amp; more</caption></fig></sec><sec><title>Aims</title><p>oo</p></sec></body>"
    b = spark.createDataFrame([("p1", "abs", body), ("p2", "abc", "<body/>")], "pmid string, abstract string, body string")
    got = {r.pmid: r.text for r in C.sectioned_text(b, C.sections_of(b)).collect()}
    assert got["p1"].split("\n\n") == ["ABSTRACT: abs", "RESULTS: Resultsrr", "FIGURE LEGENDS: legend & more", "METHODS: Methodsmm m", "OTHER: Aimsoo"] and got["p2"] == "ABSTRACT: abc"
    short = {r.pmid: r.text for r in C.sectioned_text(b, C.sections_of(b), 10).collect()}
    assert short["p1"] == "ABSTRACT: abs\n\nRESULTS: Results"


def test_sections_hold_the_sections_inside_them(spark):
    inner = "<sec><title>Outer results</title><p>Outer text.</p><sec><title>Methods</title><p>In <b>ner</b></p><sec><p>Deep</p></sec></sec><p> After. </p></sec>"
    odd = "<body><sec-meta>no</sec-meta><sec/><sec id='2'><fig-group><fig><title>Results</title><caption> <title>Leg</title>\n <p>end &#945;&#x3b2;&amp;#x41; &#99999999;</p></caption></fig></fig-group><title>Procedures</title><!-- <sec> </sec> --> <p>M <xref>1</xref> x</p><table-wrap><caption>Tab</caption><p>t</p></table-wrap></sec></sec><p>loose</p></body>"
    rows = [("p1", "", f"<body>{inner}</body>"), ("p2", "a", odd), ("p3", None, None), ("p4", "", "<body><SEC><p>open</p>"), ("p5", "", ""), ("p6", "", "<body>" + "".join(f"<sec><title>t{i}</title></sec>" for i in range(300)) + "</body>")]
    b = spark.createDataFrame(rows, "pmid string, abstract string, body string")
    got = {r.pmid: r.text for r in C.sectioned_text(b, C.sections_of(b)).collect()}
    assert got["p1"] == "ABSTRACT: \n\nRESULTS: Outer resultsOuter text.MethodsIn nerDeepAfter."
    assert got["p2"] == "ABSTRACT: a\n\nFIGURE LEGENDS: Leg\n end αβ&#x41; &#99999999; Tab\n\nMETHODS: Procedures M 1 x"
    assert (got["p3"], got["p4"], got["p5"]) == ("ABSTRACT: ", "ABSTRACT: \n\nOTHER: open", "ABSTRACT: ")
    assert got["p6"] == "ABSTRACT: \n\nOTHER: " + " ".join(f"t{i}" for i in range(300))


def test_fulltext_records_and_search(spark):
    papers = spark.createDataFrame([("p1", "a" * 10, "a" * 10, "abstract_only"), ("p2", "b", "b", "abstract_only")], "pmid string, abstract string, source_text string, text_access string")
    got = {r.pmid: r for r in C.adopt_fulltext(papers, spark.createDataFrame([("p1", "x" * 600), ("p2", "y" * 100)], "pmid string, text string")).collect()}
    assert got["p1"].text_access == "full_text" and got["p1"].source_text == "x" * 600 and got["p2"].source_text == "b"
    xml = '<PubmedArticle><PMID Version="1">77</PMID><Journal><Title>J</Title><PubDate><MedlineDate>1999 Jan</MedlineDate></PubDate></Journal><ArticleTitle>T &lt;i&gt;</ArticleTitle><Abstract><AbstractText Label="aims">one</AbstractText><AbstractText>two</AbstractText></Abstract><PublicationTypeList><PublicationType UI="D">Meta-Analysis</PublicationType></PublicationTypeList></PubmedArticle>'
    r = C.parse_records(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.pmid, r.title, r.abstract, r.journal, r.year, r.publication_types, r.pubtype_study_type, r.retracted) == ("77", "T <i>", "AIMS: one two", "J", "1999", ["Meta-Analysis"], "meta_analysis", False)
    table = spark.createDataFrame([(0, "a", ["shade"]), (1, "b", ["shade", "sun"]), (2, "c", ["rain"])], "place int, pmid string, keywords array<string>")
    q = spark.createDataFrame([("q1", "SHADE and sun", 1), ("q2", "none", 5)], "query_id string, query string, retmax int")
    assert {r.query_id: r.pmids for r in C.CorpusTable(table).search(q).collect()} == {"q1": ["a"], "q2": []}


def test_questions_and_missing_cache(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\n  Does A affect B? \nC?\n")
    assert [r.line for r in C.read_questions(spark, f"file://{tmp_path}/q.txt").collect()] == ["Does A affect B?", "C?"]
    assert C.read_cache(spark, f"file://{tmp_path}/none", "k string").count() == 0


def test_verify_text(spark):
    c = claims(spark, claim("C1_0", grade="weak"), claim("C1_1", grade="strong"), claim("C1_2", grade="strong", relation="associated_with"))
    text = "Lactate induced loss [C1_0]. Lactate induced gain [C1_1]. It causes this [C1_2] surely. Five words stand here alone. Nothing induces it [NO_EVIDENCE]. Unknown one increases [C9_9]. Short one."
    need = spark.createDataFrame([("d", "H1"), ("d", "C1_0")], "doc string, tag string")
    v = R.verify_text(spark.createDataFrame([("d", text), ("e", "")], "doc string, text string"), c, need).orderBy("doc").collect()
    assert v[0].n_sentences == 7 and v[0].uncited == ["Five words stand here alone."] and v[0].unknown_ids == ["C9_9"] and v[0].missing_tags == ["H1"] and not v[0].passed
    assert [(o.used, o.allowed) for o in v[0].overclaims] == [(4, 1), (4, 1), (4, 1)] and v[1].passed and v[1].n_sentences == 0
    j = spark.createDataFrame([("d", 0, "unsupported", "w"), ("d", 1, "entailed", "x"), ("d", 99, "partial", "y")], "doc string, sentence_index int, verdict string, rationale string")
    assert [r.sentence for r in R.entailment(spark.createDataFrame([("d", text)], "doc string, text string"), c, j).collect()] == ["Lactate induced loss [C1_0]."]


def test_usage_and_shares(spark):
    calls = spark.createDataFrame([("a", "m", 2, False, 100, 10, 0, 1.0), ("a", "m", 1, True, 50, 5, 0, 0.5), ("b", "z", 1, False, 1, 1, 0, 0.1)], "task string, model string, items int, failed boolean, tokens_in long, tokens_out long, tokens_reasoning long, seconds double")
    got = {r.task: r for r in T.usage(calls, spark.createDataFrame([("m", 1000.0, 2000.0)], "model string, price_in double, price_out double")).collect()}
    assert got["a"].cost == 0.18 and got["a"].failures == 1 and got["a"].cost_complete and not got[None].cost_complete and got[None].calls == 3 and got["b"].cost is None
    assert spark.range(1).select(T.share(F.lit(1), F.lit(3)), T.share(F.lit(1), F.lit(0))).first() == (0.333, None)
    h = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "round int, leader string")
    assert tuple(T.leader_changes(h).first()) == (3, 1, False)


def test_signals(spark):
    m = spark.createDataFrame([(0.5, 10, 0, 100, 3, 0, "completed", None)], "drop_rate double, claims_kept int, alias_merges int, queries int, queries_ignored int, pathways_supported int, status string, inclusion_rate double")
    assert [r.signal for r in T.signals(m).collect()] == ["claim drop rate", "no pathway supported"]
    assert len(T.SIGNALS) == 23
    w = T.run_warnings({"gate": "BUDGET", "claims_dropped": 3, "pending_relations": 2, "embedder": "hashing"}, [("quote not found in source", 3)])
    assert len(w) == 4 and w[-1].startswith("2 claim relations")


def test_every_signal_can_fire(spark):
    bad = {
        "drop_rate": 0.5, "relation_unverified": 20, "claims_kept": 40, "method_fields_uncredited": 30, "local_share": 0.9, "fragmentation": 0.9, "alias_merges": 0, "never_extracted": 5, "included": 10, "full_text_share": 0.1, "queries_ignored": 4, "queries": 8,
        "queries_zero_hits": 5, "inclusion_rate": 0.1, "pending_relations": 1, "unresolved_relations": 20, "pathways_supported": 0, "steps_unfound": 9, "steps": 10, "leader_last_changed": True, "verified": False, "llm_failures": 2, "status": "failed",
        "stop_reason": "token budget reached", "semantic_status": "PARTIAL", "pairs_asked": 10, "pairs_judged": 2, "duplicate_labels": 1,
    }
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in bad.items()])
    assert [r.signal for r in T.signals(row).collect()] == [name for name, _ in T.SIGNALS] and len(T.SIGNALS) == 23


def test_entailment_without_a_judge(spark):
    c, texts = claims(spark, claim("C1_0")), spark.createDataFrame([("d", "Lactate increases IFNG [C1_0]. No one cites this sentence here.")], "doc string, text string")

    def down(asked, claims):
        raise C.Unavailable("no answer")

    def wrong(asked, claims):
        raise KeyError("a mistake")

    def strict(asked, claims):
        return asked.select("doc", F.col("n").alias("sentence_index"), F.lit("unsupported").alias("verdict"), F.lit("w").alias("rationale"))

    assert [(r.sentence, r.verdict) for r in R.checked_entailment(texts, c, down).collect()] == [("Unavailable", "check_unavailable")]
    assert [(r.sentence, r.verdict) for r in R.checked_entailment(texts, c, strict).collect()] == [("Lactate increases IFNG [C1_0].", "unsupported")]
    assert R.checked_entailment(texts.withColumn("text", F.lit("Nothing cited at all.")), c, down).count() == 0
    with pytest.raises(KeyError):
        R.checked_entailment(texts, c, wrong)


def test_summary_row(spark):
    papers = spark.createDataFrame([("p1", "included", False, "full_text"), ("p2", "included", False, "abstract_only"), ("p3", "excluded", True, "abstract_only")], "pmid string, screen_status string, retracted boolean, text_access string")
    links = spark.createDataFrame([("k", "no study found in 2 targeted searches", True)], "key string, reason string, exhausted boolean")
    log = spark.createDataFrame([("q", True, 0, ["x"]), ("r", False, None, [])], "query string, ok boolean, hits int, ignored_terms array<string>")
    c = claims(spark, claim("c1"), claim("c2", relation=""))
    m = T.summary(papers, c, c.limit(1), links, spark.createDataFrame([("H1", "supported")], "id string, status string"), log, papers.select("pmid").limit(1)).first()
    assert (m.retrieved, m.included, m.never_extracted, m.full_text_share, m.drop_rate, m.pending_relations, m.steps_unfound, m.queries_zero_hits, m.queries_ignored, m.pathways_supported) == (3, 2, 1, 1.0, 0.333, 1, 1, 1, 1, 1)


@pytest.mark.parametrize(("status", "message", "fatal"), [(401, "", True), (None, "Incorrect API key given", True), (500, "overloaded", False)])
def test_fatal_errors(spark, status, message, fatal):
    df = spark.createDataFrame([(status, message)], "s int, m string")
    assert df.select(T.is_fatal(F.col("s"), F.col("m"))).first()[0] is fatal


def test_vocabularies():
    assert set(S.CAUSAL) | set(S.ASSOCIATIVE) | set(S.NULL_RELATIONS) | set(S.PHYSICAL) | {"unresolved"} == set(S.RELATIONS)
