"""Several runs in one session, and questions asked of a finished run."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.operators import report as R
from claimloom.operators import telemetry as T


class FatalError(Exception):
    """An error that no retry mends: it ends the session, not only one run."""


def preflight(checks: list[tuple[str, Callable[[], object], bool]]) -> list[dict]:
    """(check, ok, required, seconds, detail or error) of named calls, each tried whatever the others do."""
    out = []
    for name, call, required in checks:
        began, row = time.perf_counter(), {"check": name, "required": required}
        try:
            row |= {"ok": True, "detail": str(call())[:200]}
        except Exception as e:  # noqa: BLE001 - what a check raises is its result
            row |= {"ok": False, "error": f"{type(e).__name__}: {e}"[:500]}
        out.append(row | {"seconds": round(time.perf_counter() - began, 1)})
    return out


def ready(rows: list[dict]) -> bool:
    return all(r["ok"] or not r["required"] for r in rows)


def run_questions(questions: list[str], run: Callable[[str], dict], save: Callable[[dict], None], checks: list[dict] | None = None) -> dict:
    """Runs each question and saves the session after each; a failed run is recorded and the next one starts, a fatal
    error ends the session. Nothing runs if a required check failed."""
    now = lambda: datetime.now(timezone.utc).isoformat(timespec="seconds")
    session = {"started": now(), "preflight": checks or [], "runs": [], "status": "running"}
    if checks is not None and not ready(checks):
        session |= {"status": "aborted", "finished": now()}
        save(session)
        return session
    for n, q in enumerate(questions, 1):
        began, row = time.perf_counter(), {"index": n, "question": q}
        try:
            row |= {"status": "completed"} | run(q)
        except FatalError as e:
            row |= {"status": "aborted", "error": f"{type(e).__name__}: {e}"[:2000]}
        except Exception as e:  # noqa: BLE001 - one run's failure must not lose the others
            row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:2000]}
        session["runs"].append(row | {"wall_seconds": round(time.perf_counter() - began, 1)})
        save(session)
        if row["status"] == "aborted":
            break
    session |= {"status": "aborted" if any(r["status"] == "aborted" for r in session["runs"]) else "completed", "finished": now()}
    save(session)
    return session


def save_json(spark: SparkSession, path: str) -> Callable[[dict], None]:
    """Writes a session as one JSON document through Spark's file systems, replacing it each time."""

    def save(session: dict) -> None:
        text = json.dumps(session, ensure_ascii=False, default=str)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    return save


def measures(spark: SparkSession, st, log: DataFrame, verification: dict | None = None, status: str = "completed") -> dict:
    """The row that the signals read, and the signals that fire, of a run. verification: what ``report.verify_text`` says of its report,
    if there is one; status: how the run ended (``run_questions`` tells a failed or aborted one)."""
    row = T.summary(st.papers, st.claims, st.dropped, st.links, st.ranked, log, st.extracted)
    leaders = spark.createDataFrame([(h["round"], h["leader"]) for h in st.history], "round int, leader string")
    changed = T.leader_changes(leaders).select(F.col("last_changed").alias("leader_last_changed"), F.col("changes").alias("leader_changes"))
    ends = st.claims.select(F.explode(F.array("subject_concept", "object_concept")).alias("id")).distinct()
    concepts = ends.join(st.concepts, "id")
    named = concepts.agg(F.count("*").alias("concepts"), F.count_if(F.col("source") == "local").alias("local"))
    named = named.withColumn("local_share", T.share(F.col("local"), F.col("concepts")))
    more = {
        "alias_merges": F.lit(st.alias.count()), "semantic_status": F.lit(st.semantic_status), "stop_reason": F.lit(S.STOP_LABEL.get(st.gate, st.gate)), "status": F.lit(status),
        "pairs_asked": F.lit(st.pairs_asked), "pairs_judged": F.lit(st.pair_verdicts.count()), "llm_failures": F.lit(sum(st.unanswered.values())),
        "duplicate_labels": F.lit(T.duplicate_labels(concepts.select("id", "label")).count()), "verified": F.lit(None if verification is None else bool(verification["passed"])).cast("boolean"),
    }
    one = row.withColumns(more).withColumn("__k", F.lit(1))
    for part in (changed, named):
        one = one.join(part.withColumn("__k", F.lit(1)), "__k")
    one = one.drop("__k")
    return one.first().asDict() | {"signals": [r.signal for r in T.signals(one).collect()]}


def run_context(hyps: DataFrame, links: DataFrame, claims: DataFrame, question: str, gate: str, rounds: int, warnings: list[str], most: int = 150) -> str:
    """What a follow-up question may draw on: the pathways, their steps, and at most ``most`` claims that they use."""
    h = hyps.orderBy("rank").collect()
    keys = [k for x in h for k in x.links]
    by = {r.key: r for r in links.where(F.col("key").isin(keys)).collect()}
    lines = [f"Question: {question}", f"Search stopped: {S.STOP_LABEL[gate]} after {rounds} rounds.", f"Warnings: {'; '.join(warnings) or 'none'}", "", "Pathways:"]
    for x in h:
        lines.append(f"[{x.id}] {x.name}: {S.STATUS_LABEL[x.status]} ({x.reason}), score {x.score}")
        lines += [f"  step {r.subject_label} -{r.relation}-> {r.object_label}: {S.STATUS_LABEL[r.status]} ({r.reason}); support {r.support_ids}; opposing {r.contradicting_ids}; not counted {r.uncounted}" for r in (by[k] for k in x.links if k in by)]
    used = R.used_claims(hyps, links, claims, corroborating=False, most=most)
    lines += ["", "Claims:"] + [f"[{c.id}] ({c.grade}) {c.subject_label} {c.relation_norm} {c.object_label} | {c.study_type} | {c.context_cell_type} | PMID {c.pmid}" for c in used.orderBy("id").collect()]
    return "\n".join(lines)


def answer(spark: SparkSession, context: str, question: str, history: list[dict], claims: DataFrame, reply: Callable[[str], str]) -> tuple[str, list[str]]:
    """(reply, issues): a reply from the context and the last six messages, held against the claims that it cites."""
    recent = "\n".join(f"{m['role']}: {m['content'][:1500]}" for m in history[-6:])
    text = reply(f"RUN CONTEXT\n{context}\n\nCONVERSATION\n{recent}\n\nQUESTION\n{question}")
    v = R.verify_text(spark.createDataFrame([("chat", text)], "doc string, text string"), claims).first()
    return text, [f"stronger wording than the evidence allows: {o.sentence[:100]}" for o in v.overclaims] + [f"unknown claim id {i}" for i in v.unknown_ids]
