"""What a report is made of, and whether its sentences stay within the evidence they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.functions.grading import claim_cap
from claimloom.functions.quotes import STRUCTURE_TAG, TAG, prose_sentences, sentence_tier
from claimloom.sources.corpus import Unavailable, is_unavailable
from claimloom.sources.scratch import materialize


def sentences(texts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, n, sentence, tags, ids, tier) of the prose in texts (key, text)."""
    s = texts.select(key, F.posexplode(prose_sentences(F.col("text"))).alias("n", "sentence"))
    s = s.withColumn("tags", F.regexp_extract_all("sentence", F.lit(TAG), F.lit(1))).withColumn("tier", sentence_tier(F.col("sentence")))
    return s.withColumn("ids", F.filter("tags", lambda t: ~t.rlike(STRUCTURE_TAG)))


def verify_text(texts: DataFrame, claims: DataFrame, required: DataFrame | None = None, key: str = "doc") -> DataFrame:
    """(key, n_sentences, uncited, overclaims, unknown_ids, missing_tags, passed) of each text. claims: id, grade,
    relation_norm; required: key, tag.

    Sentences meet the claims they cite in one equi-join; a sentence may use no stronger verb than its weakest claim
    allows, and without a claim none above tier 1."""
    s = sentences(texts, key)
    caps = claims.select("id", claim_cap(F.col("grade"), F.col("relation_norm")).alias("cap"))
    cited = s.select(key, "n", F.explode("ids").alias("id")).join(caps, "id", "left")
    met = cited.groupBy(key, "n").agg(F.min("cap").alias("allowed"), F.collect_set(F.when(F.col("cap").isNull(), F.col("id"))).alias("unknown"))
    df = s.join(met, [key, "n"], "left")
    bare = F.size("ids") == 0
    none = bare & F.array_contains("tags", "NO_EVIDENCE")
    over = F.when(none & (F.col("tier") > 1), F.struct("n", "sentence", F.col("tier").alias("used"), F.lit(1).alias("allowed"))).when(~bare & (F.col("tier") > F.col("allowed")), F.struct("n", "sentence", F.col("tier").alias("used"), F.col("allowed").cast("int").alias("allowed")))
    uncited = F.when(bare & ~none & (F.size(F.split(F.btrim("sentence"), r"(?U)\s+")) >= 5), F.struct("n", "sentence"))
    got = df.groupBy(key).agg(
        F.count("*").cast("int").alias("n_sentences"), F.transform(F.sort_array(F.collect_list(uncited)), lambda x: x["sentence"]).alias("uncited"),
        F.transform(F.sort_array(F.collect_list(over)), lambda x: F.struct(x["sentence"].alias("sentence"), x["used"].alias("used"), x["allowed"].alias("allowed"))).alias("overclaims"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("unknown", F.array().cast("array<string>")))))).alias("unknown_ids"),
    )
    out = texts.select(key, "text").join(got, key, "left")
    if required is not None:
        want = required.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("want"))
        out = out.join(want, key, "left")
    wanted = F.coalesce("want" if required is not None else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    out = out.withColumn("missing_tags", F.filter(wanted, lambda t: ~F.contains(F.coalesce("text", F.lit("")), F.concat(F.lit("["), t, F.lit("]")))))
    empty = {c: F.coalesce(c, F.expr(f"cast(array() as {kind})")) for c, kind in (("uncited", "array<string>"), ("overclaims", "array<struct<sentence:string,used:int,allowed:int>>"), ("unknown_ids", "array<string>"))}
    out = out.select(key, F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"), *[v.alias(k) for k, v in empty.items()], "missing_tags")
    return out.withColumn("passed", (F.size("uncited") == 0) & (F.size("overclaims") == 0) & (F.size("unknown_ids") == 0) & (F.size("missing_tags") == 0))


def entailment(texts: DataFrame, claims: DataFrame, verdicts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, sentence, verdict, why) of judged sentences that are not entailed; verdicts: key, sentence_index, verdict,
    rationale; numbers without a sentence that cites a known claim fall away."""
    s = sentences(texts, key)
    known = s.select(key, "n", F.explode("ids").alias("id")).join(claims.select("id"), "id", "left_semi").select(key, "n").distinct()
    v = verdicts.where("verdict <> 'entailed'").withColumnRenamed("sentence_index", "n")
    return v.join(known, [key, "n"], "left_semi").join(s.select(key, "n", "sentence"), [key, "n"]).select(key, "sentence", "verdict", F.col("rationale").alias("why"))


def checked_entailment(texts: DataFrame, claims: DataFrame, judge, key: str = "doc") -> DataFrame:
    """``entailment`` of what a judge says of the sentences (key, n, sentence, ids) that cite known claims; where the judge is unavailable, one
    row with the verdict check_unavailable and the error's name as its sentence. Without such a sentence nobody is asked."""
    asked = sentences(texts, key)
    known = asked.select(key, "n", F.explode("ids").alias("id")).join(claims.select("id"), "id", "left_semi").select(key, "n").distinct()
    asked = materialize(asked.join(known, [key, "n"], "left_semi").select(key, "n", "sentence", "ids"), "asked")
    schema = f"{key} string, sentence string, verdict string, why string"
    if asked.isEmpty():
        return texts.sparkSession.createDataFrame([], schema)
    try:
        verdicts = materialize(judge(asked, claims), "entailed")
    except Exception as e:
        if not is_unavailable(e):
            raise
        return texts.sparkSession.createDataFrame([(None, Unavailable.__name__, "check_unavailable", None)], schema)
    return entailment(texts, claims, verdicts, key).select(F.col(key).cast("string").alias(key), "sentence", "verdict", "why")


def used_claims(hyps: DataFrame, links: DataFrame, claims: DataFrame, corroborating: bool = True, most: int | None = None) -> DataFrame:
    """Claims that an edge of a pathway counts, opposes, sets aside or (for a synthesis, not for a chat) is corroborated by."""
    steps = hyps.select(F.explode("links").alias("key")).distinct().join(links, "key")
    ids = F.concat("support_ids", "contradicting_ids", F.map_keys("uncounted"), *(["corroborating_ids"] if corroborating else []))
    out = claims.join(steps.select(F.explode(ids).alias("id")).distinct(), "id", "left_semi")
    return out.orderBy("id").limit(most) if most else out


def step_tags(hyps: DataFrame) -> DataFrame:
    """(key, tag): L1, L2 ... by first appearance along the ranked pathways (columns rank, links)."""
    first = hyps.select("rank", F.posexplode("links").alias("pos", "key")).groupBy("key").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.select("key", F.concat(F.lit("L"), F.row_number().over(Window.orderBy("at")).cast("string")).alias("tag"))  # a few pathways' steps


def step_label(status: Column, grade: Column, support: Column) -> Column:
    label = S.mapped(S.STATUS_LABEL, status)
    return F.when((status == "contradicted") | (F.size(support) == 0), label).otherwise(F.concat(label, F.lit(", "), grade))


def portfolio_rows(hyps: DataFrame, links: DataFrame) -> DataFrame:
    """(rank, id, pathway, verdict, why, score, source) of the pathways."""
    from claimloom.operators.paths import labelled

    return hyps.join(labelled(hyps, links), "id").select("rank", "id", "pathway", S.mapped(S.STATUS_LABEL, F.col("status")).alias("verdict"), F.col("reason").alias("why"), "score", S.mapped(S.ORIGIN_LABEL, F.col("origin")).alias("source"))


def portfolio_table(hyps: DataFrame, links: DataFrame) -> DataFrame:
    """(rank, line): the pathways as lines of a Markdown table."""
    steps = hyps.select("id", F.posexplode("links").alias("pos", "key")).join(links, "key").join(step_tags(hyps), "key")
    text = F.concat("tag", F.lit(" "), "subject_label", F.lit("→"), "object_label", F.lit(" ("), step_label(F.col("status"), F.col("grade"), F.col("support_ids")), F.lit(")"))
    steps = steps.groupBy("id").agg(F.concat_ws("; ", F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"])).alias("steps"))
    flags = F.concat_ws("; ", F.transform("logic_flags", lambda f: S.mapped(S.FLAG_LABEL, f)))
    cells = [F.concat("id", F.lit(" "), "name"), S.mapped(S.STATUS_LABEL, F.col("status")), F.col("reason"), F.col("score").cast("string"), S.mapped(S.ORIGIN_LABEL, F.col("origin")), F.when(flags == "", "-").otherwise(flags), F.coalesce("steps", F.lit(""))]
    return hyps.join(steps, "id", "left").select("rank", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def report(synthesis: str, hyps: DataFrame, links: DataFrame, header: str, warnings: list[str], verification: dict) -> str:
    """The Markdown report of a finished run; a handful of pathways are collected."""
    head = ["| Pathway | Verdict | Why | Score | Source | Logic warnings | Steps |", "|---|---|---|---|---|---|---|"]
    lines = head + [r.line for r in portfolio_table(hyps, links).orderBy("rank").collect()]
    v = verification
    problems = [f"- uncited: {s[:120]}" for s in v["uncited"][:5]] + [f"- overclaim (tier {o['used']} > {o['allowed']}): {o['sentence'][:120]}" for o in v["overclaims"][:5]]
    problems += [f"- unknown claim id: {i}" for i in v["unknown_ids"][:5]] + [f"- missing tag: {t}" for t in v["missing_tags"][:10]]
    parts = [synthesis + "\n\n---\n## Pathway portfolio (computed)\n" + header, "\n".join(lines), "## Run-quality warnings\n" + ("\n".join(f"- {w}" for w in warnings) or "- none"), "## Verification\n" + ("- PASS" if v["passed"] else "\n".join(problems))]
    return "\n\n".join(parts)
