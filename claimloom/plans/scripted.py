"""A deterministic adjudicator: verdict tables read from a scenario, pure functions of the rows asked about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.functions.grading import stance
from claimloom.functions.text import lookup_key

CLAIM_DEFAULTS = {"context_tissue": "", "context_model": "", "context_cell_type": "", "context_dose": "", "context_timepoint": "", "subject_attribute": "none", "object_attribute": "none", "perturbation_class": "none", "methods_span": "", "system": "unclear"}


class Scripted:
    """Judgements of a scenario row (``sources.corpus.read_scenario``). Papers' own entries give screening and claims;
    entity, relation and alias maps give names; pairs with equal ends are one finding, and one context if system and
    cell type agree; conflicts within one context are true."""

    def __init__(self, spark: SparkSession, scenario: Row):
        self.spark, self.s = spark, scenario
        rows = [(p.pmid, p.relevant is not False, 70 if p.relevance is None else p.relevance, "fixture", p.study_type) for p in scenario.papers]
        self.screens = spark.createDataFrame(rows, "pmid string, relevant boolean, relevance_score int, reason string, study_type string")
        names = [f.name for f in S.CLAIM.fields if f.name in ("claim_type", "subject", "relation", "object", "span", "readout_is_inferred", "rescue_arm", "orthogonal_validation", "comparator_present", *CLAIM_DEFAULTS)]
        flags = ("readout_is_inferred", "rescue_arm", "orthogonal_validation", "comparator_present")
        kinds = ", ".join(f"{n} {'boolean' if n in flags else 'string'}" for n in names)
        got = [(p.pmid, n, *[bool(c[x]) if x in flags else (c[x] if c[x] is not None else CLAIM_DEFAULTS.get(x)) for x in names]) for p in scenario.papers for n, c in enumerate(p.claims)]
        self.claims = spark.createDataFrame(got, f"pmid string, n int, {kinds}")

    def plan(self, targets: list[Row]) -> list[tuple[str, str, str]]:
        if not targets:
            return [(q.query, q.intent, "") for q in self.s.round1_queries]
        words = {"gap_positive": "", "gap_alternative_terms": " mechanism", "gap_null": " no effect"}
        return [(f"{t.subject_label} {t.object_label}{w}", i, t.key) for t in targets for i, w in words.items()]

    def screen(self, papers: DataFrame) -> DataFrame:
        return self.screens.join(papers.select("pmid"), "pmid", "left_semi")

    def extract(self, papers: DataFrame) -> DataFrame:
        return self.claims.join(papers.select("pmid"), "pmid", "left_semi")

    def relations(self, claims: DataFrame) -> DataFrame:
        known = F.create_map(*[F.lit(x) for kv in (self.s.relation_map or {"": ""}).items() for x in kv])
        return claims.select(F.col("id").alias("claim_id"), F.coalesce(F.element_at(known, F.lower("relation_raw")), F.lit("unresolved")).alias("canonical_relation"), F.lit(0.9).alias("confidence"))

    def entities(self, surfaces: DataFrame) -> DataFrame:
        table = [(k, v[0], v[1]) for k, v in (self.s.entities or {}).items()]
        t = self.spark.createDataFrame(table, "key string, normalized_label string, category string")
        return surfaces.join(t, "key").select("surface", "normalized_label", "category", F.lit(0.8).alias("confidence"))

    def aliases(self, pairs: DataFrame) -> DataFrame:
        rows = [(n, x) for n, g in enumerate(self.s.alias_groups or []) for x in g]
        group = self.spark.createDataFrame(rows, "g int, name string").select("g", lookup_key(F.col("name")).alias("k"))
        side = lambda c, n: group.select(F.col("k").alias(c), F.col("g").alias(n)).distinct()
        p = pairs.withColumn("ka", lookup_key(F.col("label_a"))).withColumn("kb", lookup_key(F.col("label_b")))
        p = p.join(side("ka", "ga"), "ka", "left").join(side("kb", "gb"), "kb", "left")
        return p.groupBy("label_a", "label_b").agg(F.coalesce(F.max(F.col("ga") == F.col("gb")), F.lit(False)).alias("same_entity"))

    def pairs(self, asked: DataFrame, claims: DataFrame) -> DataFrame:
        c = lambda n: claims.select(F.col("id").alias(n), F.struct("subject_concept", "object_concept").alias(f"e_{n}"), F.struct("system", "context_concept").alias(f"c_{n}"))
        return asked.join(c("lo"), "lo").join(c("hi"), "hi").select("batch", "pair", (F.col("e_lo") == F.col("e_hi")).alias("same_finding"), (F.col("c_lo") == F.col("c_hi")).alias("same_context"))

    def conflicts(self, candidates: DataFrame, claims: DataFrame) -> DataFrame:
        each = candidates.select(F.col("key").alias("cluster_key"), "claim_ids", F.explode("claim_ids").alias("id")).join(claims.select("id", F.struct("system", "context_concept").alias("c"), stance().alias("st")), "id")
        one = each.groupBy("cluster_key").agg(F.first("claim_ids").alias("claim_ids"), (F.count_distinct("c") == 1).alias("same"))
        return one.select("cluster_key", F.when(F.col("same"), "true_conflict").otherwise("context_dependent").alias("verdict"), F.lit("by recorded context").alias("explanation"), F.lit("repeat in one system").alias("discriminating_experiment"), "claim_ids")

    def seeds(self) -> list[dict]:
        return [p.asDict(recursive=True) for p in self.s.seed_pathways or []]

    def expansions(self, novel: list[str]) -> list[dict]:
        names = {n.lower() for n in novel}
        fits = lambda p: any(x.source.lower() in names or x.target.lower() in names for x in p.links)
        return [p.asDict(recursive=True) for p in self.s.expansion_pathways or [] if fits(p)][:1]


def synthesis(st, claims: DataFrame) -> str:
    """A plain text over a finished run that says no more than its claims allow."""
    from claimloom.operators.report import step_tags

    tags = {r.key: r.tag for r in step_tags(st.ranked).collect()}
    links = {r.key: r for r in st.links.where(F.col("key").isin(list(tags))).collect()}
    ids = sorted({i for r in links.values() for i in [*r.support_ids, *r.contradicting_ids]})
    grade = {r.id: r.grade for r in claims.where(F.col("id").isin(ids)).select("id", "grade").collect()}
    cite = lambda xs: " ".join(f"[{x}]" for x in xs)
    lines = ["## Summary"]
    for h in st.ranked.orderBy("rank").collect():
        lines.append(f"\n### Pathway\nThe pathway {h.name} is ranked {h.rank} [{h.id}] [NO_EVIDENCE].")
        for k in h.links:
            r, weakest = links[k], min((S.GRADES.index(grade[i]) for i in links[k].support_ids), default=None)
            if weakest is None:
                lines.append(f"[{tags[k]}] No study in the ledger examined {r.subject_label} and {r.object_label} [NO_EVIDENCE].")
                continue
            verb = {"increases": "increases", "decreases": "reduces"}.get(r.relation, "is associated with") if weakest > 1 else "is associated with changes in"
            lines.append(f"[{tags[k]}] {r.subject_label} {verb} {r.object_label} {cite(r.support_ids)}.")
            if r.contradicting_ids:
                lines.append(f"[{tags[k]}] Other studies report null or opposite findings for this step {cite(r.contradicting_ids)}.")
    return "\n".join(lines)
