"""Classification and grading of claims, as column expressions.

Expressions read the columns of ``schemas.CLAIM`` by name. A null relation counts as pending, like "".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom import schemas as S

# Publication types and the study types they stand for, the precedence of study types, and retractions.
PUBTYPE_STUDY = {
    "meta-analysis": "meta_analysis", "systematic review": "review", "randomized controlled trial": "human_rct", "controlled clinical trial": "human_rct",
    "clinical trial, phase iii": "human_rct", "clinical trial": "human_cohort", "observational study": "human_cohort", "multicenter study": "human_cohort",
    "review": "review", "scoping review": "review",
}
STUDY_PRECEDENCE = ("meta_analysis", "human_rct", "human_cohort", "review")
RETRACTION = ("retracted publication", "retraction of publication", "expression of concern")
# Wording that shows a method was used.
GIVEN = (
    r"administ|provision|provid|receiv|\bfed\b|feeding|gavage|inject|incubat|stimulat|titrat|exogenous|"
    r"\d\s?(?:mm|[µμu]m|nm|mg|mcg|iu|g)\b|in vitro|in vivo|ex vivo|"
    r"randomi[sz]|randomly|placebo|usual care|standard care|standard therapy|daily|weekly"
)
METHOD_CUES = {
    "knockout": r"knock-?out|delet|deficien|-/-|null mice|crispr|\bko\b",
    "knockdown": r"knock-?down|sirna|shrna|silenc|antisense",
    "overexpression": r"overexpress|transduc|transfect|forced expression",
    "pharmacological": r"inhibit|agonist|antagonist|treat|block|drug|compound|supplement|precursor|\bdose|" + GIVEN,
    "environmental": r"expos|treat|cultur|condition|supplement|medium|hypoxi|diet|acid|" + GIVEN,
    "transfer": r"transfer|adoptive|transplant",
    "genetic_association": r"variant|polymorphism|snp|allele|gwas|mendelian",
}
RESCUE_CUE = r"rescu|restor|re-?express|reconstitut|add-?back"
ORTHOGONAL_CUE = r"independent|orthogonal|second|alternative|validat|confirm"
COMPARATOR_CUE = (
    r"compar|versus|\bvs\.?|relative to|than|control|wild-?type|\bwt\b|vehicle|untreated|baseline|"
    r"scrambled|absence of|\bwhereas\b|\bwhile\b|\black(?:s|ed|ing)?\b|\bunlike\b|in contrast|"
    r"\bbut not\b|\bwithout\b|\balone\b|randomi[sz]|\btrials?\b|placebo|usual care|"
    r"standard care|standard therapy|\bsham\b"
)
UNVERIFIED = "relation wording not in quote"


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def _relation(c: str | Column = "relation_norm") -> Column:
    return F.coalesce(_c(c), F.lit(""))


def study_type_of_publication(types: Column) -> Column:
    """The first study type in order of precedence that a publication type names; null without one."""
    low = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)
    named = {study: [t for t, s in PUBTYPE_STUDY.items() if s == study] for study in STUDY_PRECEDENCE}
    return F.coalesce(*[F.when(F.arrays_overlap(low, F.array(*map(F.lit, names))), F.lit(study)) for study, names in named.items()])


def is_retracted(types: Column) -> Column:
    """Whether any publication type (in any case) is one of a retraction."""
    return F.coalesce(F.exists(types, lambda t: F.lower(t).isin(*RETRACTION)), F.lit(False))


def stance(relation: str | Column = "relation_norm") -> Column:
    """up, down, null, physical, effect, or unknown for pending and unresolved relations."""
    r = _relation(relation)
    return (
        F.when(r.isin("", "unresolved"), "unknown").when(r.isin(*S.NULL_RELATIONS), "null").when(r == "increases", "up")
        .when(r == "decreases", "down").when(r.isin(*S.PHYSICAL), "physical").otherwise("effect")
    )


def claim_study_type(paper_type: Column, pubtype: Column, system: Column) -> Column:
    """Pooled designs of the paper hold for each claim; otherwise the claim's own system decides."""
    human = ("human_rct", "human_cohort", "human_crosssectional", "computational_cohort")
    some = lambda c: F.when(c != "", c)
    return (
        F.when(pubtype.isin("meta_analysis", "review"), pubtype)
        .when(system == "human_in_vivo", F.coalesce(some(pubtype), F.when(paper_type.isin(*human), paper_type), F.lit("human_crosssectional")))
        .otherwise(F.coalesce(S.mapped(S.SYSTEM_STUDY, system), some(paper_type), F.lit("cell_line")))
    )


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def causal_support(relation: str = "relation_norm") -> Column:
    """0 to 3 for causal relations, null for others. A control arm of a randomised or pooled study stands for a check."""
    base = S.mapped(S.CAUSAL_BASE, F.col("perturbation_class"), 0)
    control = _flag("comparator_present")
    checked = _flag("rescue_arm") | _flag("orthogonal_validation") | ((base >= 2) & control & F.coalesce(F.col("study_type").isin("human_rct", "meta_analysis"), F.lit(False)))
    s = F.when((base >= 2) & checked, 3).otherwise(base)
    s = F.when((F.col("perturbation_class") == "pharmacological") & ~checked, F.least(s, F.lit(2))).otherwise(s)
    return F.when(_relation(relation).isin(*S.CAUSAL), F.when(~control, F.least(s, F.lit(1))).otherwise(s))


def system_rank(system: Column) -> Column:
    return S.mapped(S.SYSTEM_RANK, F.coalesce(S.mapped(S.SYSTEM_GROUP, system), F.lit("")), 0)


def graded(claims: DataFrame, target_system: str | Column = "any") -> DataFrame:
    """Adds grade and grade_detail: the axes (null where one does not apply), the tier before caps, the caps in the
    order they are tried, and the first axis that is least."""
    target = F.lit(target_system) if isinstance(target_system, str) else target_system
    r, study = _relation(), F.coalesce(F.col("study_type"), F.lit(""))
    checks = F.coalesce(F.col("method_checks"), F.array().cast("array<string>"))
    axes = {
        "directness": F.greatest(F.lit(1), S.mapped(S.DIRECTNESS, F.col("claim_type"), 1) - _flag("readout_is_inferred").cast("int")),
        "design": S.mapped(S.DESIGN, study, 1),
        "null_comparison": F.when((r == "no_effect") & ~_flag("comparator_present"), 1),
        "causal": causal_support(),
    }
    df = claims.withColumns({f"__{k}": v for k, v in axes.items()})
    axis = {k: F.col(f"__{k}") for k in axes}
    df = df.withColumn("__least", F.least(*axis.values())).withColumn("__tier0", F.greatest(F.lit(1), F.col("__least")))
    rank, wanted = system_rank(F.col("system")), S.mapped(S.TARGET_RANK, target, 0)
    caps = [  # name, when it holds, the tier it allows, whether it is named only if it lowers the tier
        ("associative", r.isin(*S.ASSOCIATIVE) & (study != "meta_analysis"), 2, True),
        ("null_without_power", r == "no_effect", 2, True),
        ("secondary_source", study == "review", 1, True),
        ("abstract_only", F.coalesce(F.col("text_access") == "abstract_only", F.lit(False)), 2, True),
        ("unresolved_relation", r.isin("unresolved", ""), 1, False),
        ("relation_unverified", F.array_contains(checks, UNVERIFIED), 1, True),
        ("indirect_system", (rank > 0) & (rank < wanted), 2, True),
    ]
    now, named = "__tier0", []
    for n, (name, holds, most, quiet) in enumerate(caps):
        before, after = F.col(now), f"__tier{n + 1}"
        df = df.withColumn(f"__cap{n}", F.when(holds & ((before > most) if quiet else F.lit(True)), F.lit(name)))
        df = df.withColumn(after, F.when(holds, F.least(before, F.lit(most))).otherwise(before))
        now = after
        named.append(F.col(f"__cap{n}"))
    limiting = F.coalesce(*[F.when(v == F.col("__least"), F.lit(k)) for k, v in axis.items()])
    detail = F.struct(
        *[v.alias(k) for k, v in axis.items()], axis["causal"].isNotNull().alias("causal_applicable"), F.col("__tier0").alias("uncapped_tier"),
        F.filter(F.array(*named), lambda x: x.isNotNull()).alias("caps"), limiting.alias("limiting_axis"),
    )
    kept = [c for c in claims.columns if c not in ("grade", "grade_detail")]
    return df.select(*kept, S.grade_of(F.col(now)).alias("grade"), detail.alias("grade_detail"))


def claim_cap(grade: Column, relation: Column) -> Column:
    """The strongest verb tier a sentence may use for a claim."""
    cap = S.mapped({"ungraded": 1, "weak": 1, "moderate": 3, "strong": 4}, grade, 1)
    return F.when(_relation(relation).isin(*S.ASSOCIATIVE), F.least(cap, F.lit(1))).otherwise(cap)


def verify_methods(claims: DataFrame, methods_anchored: str | Column) -> DataFrame:
    """Method fields without a cue in the quote (or in the methods sentence, where that is anchored) are reset, and what
    was reset is added to method_checks."""
    has = F.coalesce(_c(methods_anchored), F.lit(False)) & (F.length("methods_span") > 0)
    text = F.lower(F.concat(F.coalesce(F.col("span"), F.lit("")), F.when(has, F.concat(F.lit(" "), F.col("methods_span"))).otherwise(F.lit(""))))
    df = claims.withColumn("__text", F.translate(text, "−–", "--"))
    cue = F.coalesce(*[F.when(F.col("perturbation_class") == k, F.col("__text").rlike("(?U)" + p)) for k, p in METHOD_CUES.items()], F.lit(True))
    lost = {"perturbation_class": ~cue} | {f: _flag(f) & ~F.col("__text").rlike("(?U)" + p) for f, p in (("rescue_arm", RESCUE_CUE), ("orthogonal_validation", ORTHOGONAL_CUE), ("comparator_present", COMPARATOR_CUE))}
    df = df.withColumns({f"__lost_{k}": v for k, v in lost.items()})
    said = [F.when(F.col("__lost_perturbation_class"), F.concat(F.lit("perturbation '"), F.col("perturbation_class"), F.lit("' not evidenced")))]
    said += [F.when(F.col(f"__lost_{f}"), F.lit(f"{f} not evidenced")) for f in list(lost)[1:]]
    checks = F.concat(F.coalesce(F.col("method_checks"), F.array().cast("array<string>")), F.filter(F.array(*said), lambda x: x.isNotNull()))
    new = {"method_checks": checks, "perturbation_class": F.when(F.col("__lost_perturbation_class"), "none").otherwise(F.col("perturbation_class"))}
    new |= {f: F.when(F.col(f"__lost_{f}"), F.lit(False)).otherwise(F.col(f)) for f in list(lost)[1:]}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in claims.columns])


def loss_flipped(relation: Column, subject_lost: Column, object_lost: Column) -> Column:
    """increases and decreases change places if exactly one end is a loss phrase."""
    flipped = F.when(relation == "increases", "decreases").when(relation == "decreases", "increases").otherwise(relation)
    return F.when(subject_lost != object_lost, flipped).otherwise(relation)


def screened(papers: DataFrame, verdicts: DataFrame, min_relevance: int = 50) -> DataFrame:
    """Screening: retracted papers are excluded unseen; a judged paper is included if relevant and scored at least
    ``min_relevance``; the study type of the publication outranks the judged one; unjudged papers stay unscreened."""
    v = verdicts.select("pmid", F.col("relevant").alias("__relevant"), F.col("relevance_score").alias("__score"), F.col("reason").alias("__reason"), F.col("study_type").alias("__study"))
    df = papers.join(v, "pmid", "left")
    fresh, judged = F.col("screen_status") == "unscreened", F.col("__score").isNotNull()
    keep = F.coalesce(F.col("__relevant"), F.lit(False)) & (F.col("__score") >= min_relevance)
    status = F.when(~fresh, F.col("screen_status")).when(F.col("retracted"), "excluded").when(judged & keep, "included").when(judged, "excluded").otherwise("unscreened")
    below = judged & F.coalesce(F.col("__relevant"), F.lit(False)) & (F.col("__score") < min_relevance)
    reason = F.when(~fresh, F.col("relevance_reason")).when(F.col("retracted"), "retracted / expression of concern").when(below, F.concat(F.lit("below relevance cut-off: "), F.col("__reason"))).when(judged, F.col("__reason")).otherwise(F.col("relevance_reason"))
    live = fresh & ~F.col("retracted") & judged
    new = {"screen_status": status, "relevance_reason": reason, "relevance_score": F.when(live, F.col("__score")).otherwise(F.col("relevance_score")), "study_type": F.when(live, F.coalesce("pubtype_study_type", "__study")).otherwise(F.col("study_type"))}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in papers.columns])
