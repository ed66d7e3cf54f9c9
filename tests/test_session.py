import json

from claimloom.operators.links import build_links
from claimloom.plans.session import FatalError, answer, preflight, ready, run_context, run_questions, save_json

from .factory import claim, claims


def test_preflight_and_session(spark, tmp_path):
    def bad():
        raise ValueError("no answer")

    rows = preflight([("search", lambda: "3 hits", True), ("ontology", bad, False)])
    assert [r["ok"] for r in rows] == [True, False] and ready(rows) and not ready(preflight([("model", bad, True)]))

    def run(q):
        if q == "b":
            raise ValueError("x")
        if q == "c":
            raise FatalError("no credit")
        return {"rounds": 1}

    saved = []
    s = run_questions(["a", "b", "c", "d"], run, lambda x: saved.append(len(x["runs"])), rows)
    assert [r["status"] for r in s["runs"]] == ["completed", "failed", "aborted"] and s["status"] == "aborted" and saved == [1, 2, 3, 3]
    assert run_questions(["a"], run, lambda x: None, preflight([("model", bad, True)]))["runs"] == []
    save_json(spark, f"file://{tmp_path}/s")(s)
    assert json.loads(spark.read.text(f"file://{tmp_path}/s").first().value)["runs"][0]["question"] == "a"


def test_follow_up(spark):
    c = claims(spark, claim("C1_0"), claim("C2_0", "p2"), claim("C3_0", "p3", object_concept="LOCAL:z"))
    links = build_links(c)
    hyps = spark.createDataFrame([(1, "H1", "Direct", "supported", "every step has independent support", 1.0, ["LOCAL:a|increases|LOCAL:b"])], "rank int, id string, name string, status string, reason string, score double, links array<string>")
    text = run_context(hyps, links, c, "q?", "CONVERGED", 2, [])
    assert "[H1] Direct: Supported" in text and "[C1_0] (strong)" in text and "C3_0" not in text
    reply, issues = answer(spark, text, "why?", [{"role": "user", "content": "x"}] * 9, c, lambda prompt: f"A increases B [C1_0]. It is so [C9_9]. {prompt.count('user: x')}")
    assert issues == ["unknown claim id C9_9"] and reply.endswith("6")
