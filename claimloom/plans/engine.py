"""A run: rounds of searching, reading and weighing, each a fixed chain of DataFrame operators over keyed tables.

State lives in tables of the shared folder, written once a round, so lineage never grows over rounds and a lost executor
costs no more than the stage at hand. Judgements that code cannot make come from an ``Adjudicator``: every method takes
the rows it is asked about and gives back rows of verdicts. The driver holds what is small by definition: the question,
the round's queries and targets, and the few pathways.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from claimloom import schemas as S
from claimloom.functions import quotes
from claimloom.functions.grading import claim_study_type, graded, screened, verify_methods
from claimloom.functions.text import entity_of, link_key, split_change
from claimloom.operators import links as L
from claimloom.operators import memo as M
from claimloom.operators import pairs as P
from claimloom.operators import paths as H
from claimloom.operators import report as R
from claimloom.operators import resolve as E
from claimloom.sources.corpus import Unavailable, is_unavailable
from claimloom.sources.scratch import materialize

CACHE = "key string, id string, label string, category string, source string, confidence double, ancestors array<string>, parents array<string>"
PATHWAY = "name string, rationale string, links array<struct<source:string,relation:string,target:string>>"


class Adjudicator(Protocol):
    """Verdicts for rows. Each method may leave rows out; they are asked again in the next round."""

    def plan(self, targets: list[Row]) -> list[tuple[str, str, str]]: ...  # (query, intent, target)
    def screen(self, papers: DataFrame) -> DataFrame: ...  # pmid, relevant, relevance_score, reason, study_type
    def extract(self, papers: DataFrame) -> DataFrame: ...  # pmid, n, and the fields of a claim
    def relations(self, claims: DataFrame) -> DataFrame: ...  # claim_id, canonical_relation, confidence
    def entities(self, surfaces: DataFrame) -> DataFrame: ...  # surface, normalized_label, category, confidence
    def aliases(self, pairs: DataFrame) -> DataFrame: ...  # label_a, label_b, same_entity
    def pairs(self, asked: DataFrame, claims: DataFrame) -> DataFrame: ...  # batch, pair, same_finding, same_context
    def conflicts(self, candidates: DataFrame, claims: DataFrame) -> DataFrame: ...  # schemas.CONFLICT
    def seeds(self) -> list[dict]: ...  # PATHWAY
    def expansions(self, novel: list[str]) -> list[dict]: ...


@dataclass
class Run:
    """Tables and small values of a run."""

    papers: DataFrame
    claims: DataFrame
    dropped: DataFrame
    extracted: DataFrame
    cache: DataFrame
    concepts: DataFrame
    alias: DataFrame
    alias_verdicts: DataFrame
    pair_verdicts: DataFrame
    conflicts: DataFrame
    links: DataFrame | None = None
    ranked: DataFrame | None = None
    log: list[tuple] = field(default_factory=list)
    hyps: list[dict] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    targets: list[Row] = field(default_factory=list)
    round: int = 0
    gate: str = ""
    search_status: str = ""
    semantic_status: str = ""
    seeded: bool = False
    pairs_asked: int = 0
    unanswered: dict[str, int] = field(default_factory=dict)  # rows by judgement that came back without a verdict


class Engine:
    """Runs one question over a source with an adjudicator."""

    def __init__(self, spark: SparkSession, source, judge: Adjudicator, settings: S.Settings = S.Settings(), encode=None, review=None, tokens=None):
        """encode: texts to unit vectors (hashing vectors without it); review: gets the pathways after the first round and
        gives back ids to drop; tokens: the number of tokens used so far, for the budget."""
        self.spark, self.source, self.judge, self.settings, self.encode = spark, source, judge, settings, encode
        self.review, self.tokens = review, tokens or (lambda: 0)

    def _table(self, rows: list, schema) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def run(self, parsed: dict) -> Run:
        """parsed: exposure, outcome, outcome_readouts, target_system, exposure_change, expected_direction."""
        t = self._table
        concept = CACHE.split(", ", 1)[1]
        st = Run(t([], S.PAPER), t([], S.CLAIM), t([], S.CLAIM), t([], "pmid string"), t([], CACHE), t([], concept), t([], "child string, parent string"), t([], "lo string, hi string, same_entity boolean"), t([], S.PAIR_VERDICT), t([], S.CONFLICT))
        self.parsed = self._question(st, parsed)
        while True:
            stats, failed = self.search(st)
            self.screen(st)
            self.read(st)
            self.normalize(st)
            self.compare(st)
            if self.weigh(st, stats, failed) == "done":
                return st

    def _question(self, st: Run, parsed: dict) -> dict:
        bare = self.spark.createDataFrame([(parsed["exposure"],)], "s string").select(split_change(F.col("s")).alias("c")).first().c
        parsed = parsed | {"exposure": bare.entity, "exposure_change": bare.change or parsed.get("exposure_change", "up")}
        named = [parsed["exposure"], parsed["outcome"], *parsed.get("outcome_readouts", [])]
        ids = self.resolve_names(st, named)
        return parsed | {"ids": [ids[n] for n in named]}

    def resolve_names(self, st: Run, names: list[str]) -> dict[str, str]:
        """Concept ids of a few names, in order to speak of them on the driver."""
        asked = self._table([(n,) for n in dict.fromkeys(names)], "name string").withColumn("surface", entity_of(F.col("name"))["entity"])
        resolved = self._resolved(st, asked.select("surface"))
        return {r.name: r.id for r in asked.join(resolved, "surface").select("name", "id").collect()}

    def _resolved(self, st: Run, surfaces: DataFrame) -> DataFrame:
        todo = E.keyed(surfaces).join(st.cache.select("key"), "key", "left_anti")
        got = materialize(E.resolve(surfaces, st.cache, verdicts=self.judge.entities(todo.select("surface", "key"))), "resolved")
        st.cache = materialize(M.first_wins(st.cache, got.select("key", *E.CONCEPT), "key"), "cache")
        st.concepts = materialize(M.first_wins(st.concepts, got.select(*E.CONCEPT), "id"), "concepts")
        return got

    def search(self, st: Run) -> tuple[DataFrame, bool]:
        s, t = self.settings, self._table
        planned = self.judge.plan(st.targets)
        queries = t([(q, i, g) for q, i, g in planned], "query string, intent string, target string")
        if st.targets:
            rows = t([(k.key, k.subject, k.object, k.subject_label, k.object_label) for k in st.targets], "key string, subject string, object string, subject_label string, object_label string")
            surfaces = st.cache.select("id", F.col("key").alias("name"))
            queries = M.kept_queries(queries, rows, M.synonym_queries(rows, surfaces))
        got = sorted(queries.collect(), key=lambda q: (q.target or "", q.intent or "", q.query))  # a round's few, in an order that does not change
        numbered = t([(f"{st.round}:{n}", q.query, q.target or "", s.retmax_targeted if q.target else s.retmax_first) for n, q in enumerate(got)], "query_id string, query string, target string, retmax int")
        results = materialize(self.source.search(numbered), "results")
        log = materialize(M.search_log(numbered, results), "log")
        st.log += [tuple(r) for r in log.collect()]
        hits = numbered.join(results, "query_id").select("target", F.explode("pmids").alias("pmid"))
        new, fetched = M.unseen(hits.select("pmid").distinct(), st.papers, "pmid"), True
        try:
            came = materialize(self.source.fetch(new), "fetched")
        except Exception as e:  # a source may be down: the round goes on, but does not count as a search
            if not is_unavailable(e):
                raise
            print(f"fetch failed: {Unavailable.__name__}")
            came, fetched = t([], S.PAPER), False
        st.papers = materialize(M.retrieved_for(st.papers.unionByName(came), hits), "papers")
        st.search_status = M.search_status(log, came.count(), fetched).first().status
        return M.target_searches(log), st.search_status == "SEARCH_FAILED"

    def screen(self, st: Run) -> None:
        fresh = st.papers.where("screen_status = 'unscreened' and not retracted").withColumn("abstract", F.substring("abstract", 1, self.settings.abstract_chars))
        st.papers = materialize(screened(st.papers, self.judge.screen(fresh), self.settings.min_relevance), "papers")

    def read(self, st: Run) -> None:
        s = self.settings
        order = materialize(M.reading_order(st.papers, st.extracted, s.max_extract), "order")
        chosen = self.source.fulltext(st.papers.join(order.select("pmid"), "pmid", "left_semi"))
        chosen = materialize(chosen, "reading")
        raw = self.judge.extract(chosen).where(F.col("n") < s.claims_per_paper)
        known = st.claims.unionByName(st.dropped).select("pmid", "span", "subject", F.col("relation_raw").alias("relation"), "object")
        rows = M.fresh_claims(M.split_entities(raw), known)
        rows = rows.join(chosen.select("pmid", F.col("study_type").alias("__paper"), "pubtype_study_type", "text_access"), "pmid").withColumn("study_type", claim_study_type(F.col("__paper"), F.col("pubtype_study_type"), F.col("system")))
        fixed = {"relation_raw": F.col("relation"), "relation_norm": F.lit(""), "grade": F.lit("ungraded"), "round": F.lit(st.round + 1), "drop_reason": F.lit(""), "method_checks": F.expr("cast(array() as array<string>)")}
        rows = rows.select(*[(fixed[f.name] if f.name in fixed else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.CLAIM.fields])
        rows = materialize(quotes.checked_claims(rows, chosen), "checked")
        kept = rows.where("drop_reason = ''").join(chosen.select("pmid", F.col("source_text").alias("__src")), "pmid")
        kept = verify_methods(kept.withColumn("__ok", quotes.is_anchored(F.col("methods_span"), F.col("__src"))), "__ok").select(*S.CLAIM.fieldNames())
        st.claims = materialize(st.claims.unionByName(kept), "claims")
        st.dropped = materialize(st.dropped.unionByName(rows.where("drop_reason <> ''")), "dropped")
        st.extracted = materialize(st.extracted.union(order.select("pmid")).distinct(), "extracted")
        none = F.expr("cast(array() as array<string>)")
        seen = order.select("pmid", F.col("pending").alias("__p"))
        st.papers = materialize(st.papers.join(seen, "pmid", "left").withColumn("read_for", F.array_sort(F.array_union(F.coalesce("read_for", none), F.coalesce("__p", none)))).drop("__p").join(chosen.select("pmid", F.col("text_access").alias("__a"), F.col("source_text").alias("__s")), "pmid", "left").withColumn("text_access", F.coalesce("__a", "text_access")).withColumn("source_text", F.coalesce("__s", "source_text")).select(*S.PAPER.fieldNames()), "papers")

    def normalize(self, st: Run) -> None:
        pending = st.claims.where("relation_norm = ''").withColumn("span", F.substring("span", 1, self.settings.span_chars))
        typed = M.typed_relations(st.claims, self.judge.relations(pending))
        ends = typed.select(F.explode(F.array(entity_of(F.col("subject"))["entity"], entity_of(F.col("object"))["entity"], F.coalesce("context_cell_type", F.lit("")))).alias("surface")).where("surface <> ''").distinct()
        typed = materialize(typed, "typed")
        resolved = self._resolved(st, materialize(ends, "surfaces"))
        pathway_nodes = self._table([(e,) for h in st.hyps for k in h["links"] for e in (k.split("|")[0], k.split("|")[2])], "id string")
        used = resolved.select("id").union(pathway_nodes).distinct()
        roots = materialize(E.canonical(st.alias), "roots")
        concepts = E.canonicalized(used, "id", roots).distinct().join(st.concepts, "id").select("id", "label", "category", "confidence")
        asked = materialize(E.alias_candidates(concepts, st.alias_verdicts).orderBy("lo", "hi").limit(self.settings.alias_pairs), "alias-candidates")
        side = lambda n: concepts.select(F.col("id").alias(n), F.col("label").alias(f"label_{n}"))
        asked = materialize(asked.join(side("lo"), "lo").join(side("hi"), "hi"), "asked")
        answers = E.alias_verdicts(asked, self.judge.aliases(asked.select(F.col("label_lo").alias("label_a"), F.col("label_hi").alias("label_b"))))
        st.alias_verdicts = materialize(st.alias_verdicts.unionByName(answers), "alias-verdicts")
        st.alias = materialize(M.first_wins(st.alias, E.alias_groups(concepts, st.alias_verdicts), "child"), "alias")
        self.roots = materialize(E.canonical(st.alias), "roots")
        st.claims = materialize(graded(E.with_concepts(typed, resolved, self.roots), self.parsed.get("target_system", "any")).select(*S.CLAIM.fieldNames()), "claims")

    def compare(self, st: Run) -> None:
        s = self.settings
        pairs = materialize(P.candidate_pairs(st.claims, s.threshold_hashing if self.encode is None else s.threshold_sentence, s.pairs_per_claim, self.encode), "pairs")
        asked = materialize(M.pair_batches(pairs, st.pair_verdicts), "asked")
        ok, failed = M.positional_verdicts(asked, self.judge.pairs(asked, st.claims))
        st.pair_verdicts = materialize(st.pair_verdicts.unionByName(ok), "pair-verdicts")
        n_asked, n_failed = asked.count(), failed.count()
        st.pairs_asked += n_asked
        self._missed(st, "pair", n_failed)
        st.semantic_status = M.semantic_status(pairs.count(), n_asked, n_failed)
        fams = P.families(st.claims, st.pair_verdicts)
        cands = materialize(P.conflict_candidates(st.claims, fams, st.pair_verdicts), "candidates")
        ids = lambda df: df.withColumn("__ids", F.array_sort("claim_ids"))
        fresh = ids(cands).join(ids(st.conflicts).select("__ids").distinct(), "__ids", "left_anti").orderBy("key").limit(s.conflicts_asked)
        verdicts = self.judge.conflicts(fresh.drop("__ids"), st.claims).drop("claim_ids").join(fresh.select(F.col("key").alias("cluster_key"), "claim_ids"), "cluster_key")
        verdicts = materialize(verdicts.select(*S.CONFLICT.fieldNames()), "judged")
        self._missed(st, "conflict", fresh.count() - verdicts.select("cluster_key").distinct().count())
        st.conflicts = materialize(st.conflicts.unionByName(verdicts), "conflicts")

    def _missed(self, st: Run, task: str, n: int) -> None:
        if n:
            st.unanswered[task] = st.unanswered.get(task, 0) + n

    def _key(self, key: str, roots: dict[str, str]) -> str:
        s, r, o = key.split("|")
        return f"{roots.get(s, s)}|{r}|{roots.get(o, o)}"

    def _roots_of(self, ids) -> dict[str, str]:
        """Roots of a few concepts, those of pathways' steps or of the question."""
        few = self._table([(i,) for i in sorted(set(ids))], "child string")
        return {r.child: r.root for r in self.roots.join(F.broadcast(few), "child", "left_semi").collect()}

    def _proposed(self, st: Run, pathway: dict) -> list[str]:
        ids = self.resolve_names(st, [x[e] for x in pathway["links"] for e in ("source", "target")])
        roots = self._roots_of(ids.values())
        return [self._key(f"{ids[x['source']]}|{x['relation']}|{ids[x['target']]}", roots) for x in pathway["links"] if x["relation"] in S.RELATIONS[:-1]]

    def _build(self, st: Run, prior: DataFrame | None) -> DataFrame:
        extra = self._table([(k,) for k in {k for h in st.hyps for k in h["links"]}], "key string")
        up = st.concepts.where("size(ancestors) > 0").select(F.col("id").alias("concept"), "ancestors")
        labels = st.concepts.select("id", "label")
        return materialize(L.build_links(st.claims, prior, st.pair_verdicts, L.discounted_pairs(st.conflicts), up, labels, extra, self.settings), "links")

    def weigh(self, st: Run, stats: DataFrame, search_failed: bool) -> str:
        s, p, this = self.settings, self.parsed, st.round + 1
        roots = self._roots_of([*p["ids"], *(e for h in st.hyps for k in h["links"] for e in (k.split("|")[0], k.split("|")[2]))])
        for h in st.hyps:
            h["links"] = [self._key(k, roots) for k in h["links"]]
        prior = None
        if st.links is not None:
            ends = {e: F.split("key", r"\|")[i] for i, e in ((0, "s"), (1, "r"), (2, "o"))}
            old = st.links.select("key", "subject_label", "object_label", "times_targeted", "zero_yield_count", "exhausted")
            for e in ("s", "o"):
                old = E.canonicalized(old.withColumn(e, ends[e]), e, self.roots)
            old = old.withColumn("key", link_key(F.col("s"), ends["r"], F.col("o"))).drop("s", "o").dropDuplicates(["key"])
            prior = materialize(L.exhausted_searches(old, stats, st.papers, st.claims, this, search_failed, s.exhaust_after), "prior")
        if not st.seeded:
            for pw in self.judge.seeds()[: s.n_seed_hypotheses]:
                H.insert(st.hyps, self._proposed(st, pw), "llm_seed", pw["name"], pw.get("rationale", ""), True)
            st.seeded = True
        exposure, *named = [roots.get(i, i) for i in p["ids"]]
        outcomes = materialize(H.outcome_set(named, st.concepts), "outcomes")
        links = self._build(st, prior)
        routes = H.best_paths(links, exposure, outcomes, s.max_hypotheses * 4, s.max_path_len).orderBy(F.desc("least"), "links").collect() if len(st.hyps) < s.max_hypotheses else []
        steps = self._table(sorted({(k,) for r in routes for k in r.links}), "key string")
        label = {r.key: r.object_label for r in links.select("key", "object_label").join(F.broadcast(steps), "key", "left_semi").collect()} if routes else {}
        for r in routes:
            if len(st.hyps) >= s.max_hypotheses:
                break
            via = [label[k] for k in r.links[:-1]]
            H.insert(st.hyps, list(r.links), "ledger_path", "Literature-graph route" + (f" via {', '.join(via)}" if via else f": direct to {label[r.links[-1]]}"), "found by graph search over supported steps", False)
        hyps = lambda: self._table([(h["id"], h["name"], h["origin"], h["links"], h["rationale"]) for h in st.hyps], "id string, name string, origin string, links array<string>, rationale string")
        if len(st.hyps) < s.max_hypotheses:
            novel = [r.label for r in H.novel_intermediates(links, H.used_nodes(hyps(), exposure, outcomes)).join(st.concepts, "id").select("label").orderBy("label").limit(s.novel_labels).collect()]
            for pw in self.judge.expansions(novel) if novel else []:
                if H.insert(st.hyps, self._proposed(st, pw), "llm_expansion", pw["name"], pw.get("rationale", ""), True):
                    break
        st.links = self._build(st, links.select("key", "subject_label", "object_label", "times_targeted", "zero_yield_count", "exhausted"))
        sign = self.spark.range(1).select(H.pathway_sign(F.lit(p.get("expected_direction", "unknown")), F.lit(p["exposure_change"])).alias("x")).first().x
        st.ranked = materialize(H.evaluate(hyps(), st.links, st.concepts.select("id", "category"), sign, s), "pathways")
        ranked = st.ranked.orderBy("rank").collect()
        st.hyps = [{k: r[k] for k in ("id", "name", "origin", "links", "rationale")} for r in ranked]
        chosen = materialize(H.allocate(st.ranked, st.links, this, s), "targets").join(st.links, "key").orderBy("slot").collect()
        decision, st.gate = H.decide(ranked, chosen, this, s, self.tokens())
        st.targets = chosen if decision == "search_more" else []
        if st.targets:
            hit = self._table([(r.key,) for r in chosen], "key string").withColumn("__t", F.lit(1))
            st.links = materialize(st.links.join(hit, "key", "left").withColumn("times_targeted", (F.col("times_targeted") + F.coalesce("__t", F.lit(0))).cast("int")).drop("__t"), "links")
        st.round = this
        if self.review and this == 1 and decision == "search_more":
            drop = set(self.review(st.hyps))
            st.hyps = [h for h in st.hyps if h["id"] not in drop]
            st.ranked = st.ranked.where(~F.col("id").isin(*drop)) if drop else st.ranked
        st.history.append({"round": this, "gate": st.gate, "leader": ranked[0].id if ranked else None, "targets": [r.key for r in st.targets]})
        return decision


def finish(engine: Engine, st: Run, synthesis: str) -> str:
    """The verified Markdown report of a finished run."""
    spark, tags = engine.spark, [r.tag for r in R.step_tags(st.ranked).collect()]
    text = spark.createDataFrame([("run", synthesis)], "doc string, text string")
    need = spark.createDataFrame([("run", t) for t in [h["id"] for h in st.hyps] + tags], "doc string, tag string")
    v = R.verify_text(text, st.claims, need).first().asDict(recursive=True)
    head = f"Search stopped after {st.round} rounds: {S.STOP_LABEL[st.gate]}. Population: {engine.parsed.get('target_system', 'any')}. Scores rank pathways; they are not probabilities."
    return R.report(synthesis, st.ranked, st.links, head, [], v)
