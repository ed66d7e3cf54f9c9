import json

import pytest
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.operators import report as R
from claimloom.plans.engine import Engine, Run, finish
from claimloom.plans.scripted import Scripted, synthesis
from claimloom.sources import corpus as C


def paper(pmid, keywords, *claims, **kw):
    said = " ".join(c["span"] for c in claims)
    return {"pmid": pmid, "title": pmid, "abstract": f"We kept plants in a greenhouse. {said} Nothing else was measured.", "keywords": keywords, "study_type": "animal", "claims": list(claims), **kw}


def finding(subject, relation, obj, span, **kw):
    return {"claim_type": "observation", "subject": subject, "relation": relation, "object": obj, "span": span, "system": "animal_in_vivo", "perturbation_class": "environmental", "comparator_present": True, "rescue_arm": False, "orthogonal_validation": False, **kw}


SHADE = lambda n: finding("shade", "reduced", "sugar", f"Shade exposure reduced leaf sugar compared with controls in trial number {n}.")
GROW = lambda n: finding("leaf sugar", "promoted", "growth", f"Leaf sugar given to plants promoted growth versus untreated controls in series {n}.")
SCENARIO = {
    "question": "Does shade reduce growth?",
    "parsed": {"exposure": "shade", "outcome": "growth", "outcome_readouts": [], "target_system": "any", "exposure_change": "up", "expected_direction": "down"},
    "round1_queries": [{"query": "shade and plants", "intent": "broad"}],
    "entities": {"sugar": ["sugar", "chemical"], "leaf sugar": ["leaf sugar", "chemical"]}, "alias_groups": [["sugar", "leaf sugar"]], "relation_map": {"tinted": "associated_with"},
    "seed_pathways": [{"name": "Water route", "rationale": "", "links": [{"source": "shade", "relation": "decreases", "target": "water"}, {"source": "water", "relation": "increases", "target": "growth"}]}],
    "expansion_pathways": [],
    "papers": [
        paper("p1", ["shade"], SHADE(1)), paper("p2", ["shade"], SHADE(2)), paper("p3", ["shade"], GROW(3)), paper("p4", ["shade"], GROW(4)),
        paper("p5", ["shade"], SHADE(5), publication_types=["Retracted Publication"]), paper("p6", ["shade"], {**SHADE(6), "span": "A sentence that stands nowhere in this abstract at all."} , abstract="Quite different words about shade and sugar in pots."),
        paper("p7", ["shade"], SHADE(7), relevant=False), paper("p8", ["water"], finding("shade", "tinted", "water", "Shade exposure tinted water compared with controls in pots.")),
    ],
}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("s") / "scenario.json"
    f.write_text(json.dumps(SCENARIO, indent=1))
    scenario = C.read_scenario(spark, f"file://{f}")
    row = scenario.first()
    engine = Engine(spark, C.CorpusTable(C.scenario_papers(scenario)), Scripted(spark, row), S.Settings(max_rounds=2))
    return engine, engine.run({k: v for k, v in SCENARIO["parsed"].items()})


def test_the_unseeded_pathway_wins(finished):
    engine, st = finished
    ranked = st.ranked.orderBy("rank").collect()
    assert ranked[0].origin == "ledger_path" and ranked[0].status == "supported" and ranked[0].logic_flags == []
    assert ranked[1].name == "Water route" and ranked[1].status == "insufficient"
    link = st.links.where("relation = 'decreases' and n_studies = 2").first()
    assert link.status == "supported" and sorted(link.support_ids) == ["Cp1_0", "Cp2_0"]
    assert st.gate in ("CONVERGED", "MAX_ROUNDS") and len(st.history) == st.round


def test_bad_rows_vanish_and_aliases_merge(finished):
    _, st = finished
    status = {r.pmid: r.screen_status for r in st.papers.collect()}
    assert status["p5"] == status["p7"] == "excluded"
    assert [(r.pmid, r.drop_reason) for r in st.dropped.collect()] == [("p6", "quote not found in source")]
    ends = {r[0] for r in st.claims.where("object_label = 'sugar' or subject_label like '%sugar%'").select(F.when(F.col("object_label") == "sugar", F.col("object_concept")).otherwise(F.col("subject_concept"))).collect()}
    assert len(ends) == 1
    assert st.pair_verdicts.count() == st.pair_verdicts.select("lo", "hi").distinct().count()
    assert {r.grade for r in st.claims.where("pmid in ('p1', 'p2')").collect()} == {"moderate"}


def test_the_report_verifies_itself(finished):
    engine, st = finished
    text = finish(engine, st, synthesis(st, st.claims))
    assert "- PASS" in text and "| H" in text and "Search stopped after" in text


def test_chat_context_and_rows(finished):
    _, st = finished
    used = R.used_claims(st.ranked, st.links, st.claims, corroborating=False, most=150)
    assert {"Cp1_0", "Cp2_0", "Cp3_0", "Cp4_0"} <= {r.id for r in used.collect()}
    rows = R.portfolio_rows(st.ranked, st.links).orderBy("rank").collect()
    assert rows[0].pathway.startswith("shade → ") and rows[0].verdict == "Supported" and rows[0].source == "Found in literature graph"


def test_measures_and_signals_of_the_run(spark, finished):
    from claimloom.plans.session import measures

    engine, st = finished
    log = spark.createDataFrame(st.log, "query_id string, query string, target string, ok boolean, hits int, ignored_terms array<string>")
    m = measures(spark, st, log, {"passed": False})
    assert m["pairs_asked"] >= m["pairs_judged"] > 0 and m["llm_failures"] == 0 and m["concepts"] > 0 and 0 <= m["local_share"] <= 1 and m["duplicate_labels"] == 0
    assert "verification failed" in m["signals"] and "run did not finish" not in m["signals"]
    assert "run did not finish" in measures(spark, st, log, None, "failed")["signals"]


def test_a_source_that_is_down_is_not_a_mistake_in_code(spark, finished):
    engine, st = finished

    class Down:
        def __init__(self, error):
            self.error = error

        def search(self, queries):
            return queries.select("query_id", F.lit(True).alias("ok"), F.array(F.lit("p99")).alias("pmids"), F.expr("cast(array() as array<string>)").alias("ignored_terms"))

        def fetch(self, ids):
            raise self.error

    def searched(error):
        other = Engine(spark, Down(error), engine.judge, engine.settings)
        run = Run(**{**st.__dict__, "targets": [], "log": []})
        return other.search(run)[1]

    assert searched(C.Unavailable("no answer")) is True
    with pytest.raises(KeyError):
        searched(KeyError("a mistake"))
