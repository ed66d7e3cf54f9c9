"""Record types, controlled vocabularies and parameters of the evidence graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of claims, relations and grades.
RELATIONS = ("increases", "decreases", "modulates", "no_effect", "required_for", "sufficient_for", "associated_with", "not_associated", "predicts", "binds", "modifies", "unresolved")
CAUSAL = ("increases", "decreases", "modulates", "required_for", "sufficient_for")
ASSOCIATIVE = ("associated_with", "not_associated", "predicts")
NULL_RELATIONS = ("no_effect", "not_associated")
PHYSICAL = ("binds", "modifies")
DIRECTION = {"increases": "up", "decreases": "down"}
SIGN = {"increases": 1, "decreases": -1, "required_for": 1, "sufficient_for": 1}
CLAIM_TYPES = ("observation", "author_interpretation", "mechanistic_speculation")
PERTURBATIONS = ("none", "genetic_association", "pharmacological", "environmental", "knockdown", "knockout", "overexpression", "transfer")
SYSTEMS = ("human_in_vivo", "human_primary_cells", "animal_in_vivo", "animal_cells", "organoid", "cell_line", "in_silico", "unclear")
SYSTEM_GROUP = {"human_in_vivo": "human", "human_primary_cells": "human", "animal_in_vivo": "animal", "animal_cells": "animal", "organoid": "cell", "cell_line": "cell", "in_silico": "in_silico"}
SYSTEM_RANK = {"human": 3, "animal": 2, "cell": 1, "in_silico": 1}
TARGET_RANK = {"human": 3, "animal": 2, "cell": 1, "any": 0}
ATTRIBUTES = ("none", "expression", "amount", "activity", "modification", "differentiation")
STUDY_TYPES = ("meta_analysis", "human_rct", "human_cohort", "human_crosssectional", "human_primary", "organoid_ipsc", "animal", "cell_line", "computational_cohort", "in_silico", "review")
GRADES = ("ungraded", "weak", "moderate", "strong")  # tiers 0 to 3
QUALITY = {"ungraded": 0.0, "weak": 0.4, "moderate": 0.7, "strong": 1.0}
DIRECTNESS = {"observation": 3, "author_interpretation": 2, "mechanistic_speculation": 1}
CAUSAL_BASE = {"none": 0, "genetic_association": 1, "pharmacological": 2, "environmental": 2, "knockdown": 2, "knockout": 3, "overexpression": 2, "transfer": 2}
DESIGN = {"meta_analysis": 3, "human_rct": 3, "human_cohort": 3, "human_primary": 3, "human_crosssectional": 2, "organoid_ipsc": 2, "animal": 2, "computational_cohort": 2, "cell_line": 1, "in_silico": 1, "review": 1}
SYSTEM_STUDY = {"human_primary_cells": "human_primary", "animal_in_vivo": "animal", "animal_cells": "animal", "organoid": "organoid_ipsc", "cell_line": "cell_line", "in_silico": "in_silico"}
LOGIC_PENALTY = {"disconnected": 0.5, "sign_mismatch": 0.5, "cycle": 0.7, "reverse_order": 0.8, "cross_context": 0.85, "sign_unknown": 0.9}
STATUS_LABEL = {"supported": "Supported", "contradicted": "Contradicted", "insufficient": "Insufficient evidence"}
ORIGIN_LABEL = {"llm_seed": "LLM proposal", "llm_expansion": "LLM expansion", "ledger_path": "Found in literature graph", "user": "Added by user"}
FLAG_LABEL = {"disconnected": "steps do not connect", "sign_mismatch": "net direction conflicts with the question", "cycle": "pathway loops back on itself", "reverse_order": "a phenotype acts on a molecule", "cross_context": "steps shown in different cell types", "sign_unknown": "net direction undefined"}
STOP_LABEL = {"MAX_ROUNDS": "round limit reached", "NO_TARGETS": "nothing left to search", "BUDGET": "token budget reached", "CONVERGED": "leading pathway cannot be overtaken", "TARGETED": "searching"}


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds of a run."""

    retmax_first: int = 20
    retmax_targeted: int = 5
    min_relevance: int = 50
    max_extract: int = 20
    claims_per_paper: int = 8
    fulltext_chars: int = 60_000
    min_studies_per_link: int = 2
    contradiction_threshold: float = 0.5
    max_rounds: int = 5
    n_seed_hypotheses: int = 4
    max_hypotheses: int = 6
    max_path_len: int = 4
    targets_per_round: int = 3
    exploration_slots: int = 1
    ucb_beta: float = 0.5
    softmax_temperature: float = 0.2
    exhaust_after: int = 2
    pairs_per_claim: int = 8
    threshold_sentence: float = 0.60
    threshold_hashing: float = 0.30
    threshold_default: float = 0.6
    token_budget: int | None = None
    abstract_chars: int = 3_000  # of a paper, when it is screened
    span_chars: int = 600  # of a claim, when its relation is judged
    alias_pairs: int = 200  # asked in a round; the others wait
    conflicts_asked: int = 20
    novel_labels: int = 500  # named when an expansion is asked for


def mapped(values: dict, key: Column, default=None) -> Column:
    """The value of a small fixed table at a column; ``default`` where it has none."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def tier(grade: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, GRADES)), grade).cast("int") - 1, F.lit(0))


def grade_of(tier_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, GRADES)), tier_ + 1)


_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_SS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PARSED_QUESTION = _struct(population_model=_S, exposure=_S, comparator=_S, outcome=_S, mechanism_hypothesis=_S, outcome_readouts=_SS, target_system=_S, exposure_change=_S, expected_direction=_S)
QUERY = _struct(query=_S, intent=_S, target=_S)
PAPER = _struct(
    pmid=_S, title=_S, abstract=_S, journal=_S, year=_S, source_text=_S, text_access=_S, publication_types=_SS, pubtype_study_type=_S, retracted=_B,
    screen_status=_S, relevance_score=_I, relevance_reason=_S, study_type=_S, retrieved_for=_SS, read_for=_SS,
)
CLAIM = _struct(
    id=_S, pmid=_S, claim_type=_S, subject=_S, subject_attribute=_S, relation=_S, object=_S, object_attribute=_S, system=_S, context_tissue=_S, context_model=_S,
    context_cell_type=_S, context_dose=_S, context_timepoint=_S, perturbation_class=_S, rescue_arm=_B, orthogonal_validation=_B, comparator_present=_B,
    readout_is_inferred=_B, span=_S, methods_span=_S, study_type=_S, text_access=_S, anchored=_B, subject_concept=_S, object_concept=_S, subject_label=_S,
    object_label=_S, subject_category=_S, object_category=_S, subject_parents=_SS, object_parents=_SS, context_concept=_S, round=_I, method_checks=_SS,
    drop_reason=_S, relation_raw=_S, relation_norm=_S, relation_source=_S, relation_confidence=_D, grade=_S,
)
CONCEPT = _struct(id=_S, label=_S, category=_S, source=_S, confidence=_D, ancestors=_SS, parents=_SS)
LINK = _struct(
    key=_S, subject=_S, relation=_S, object=_S, subject_label=_S, object_label=_S, support_ids=_SS, corroborating_ids=_SS, contradicting_ids=_SS,
    uncounted=T.MapType(_S, _S), n_studies=_I, n_contra_studies=_I, grade=_S, contra_grade=_S, contradiction_share=_D, completeness=_D, status=_S, reason=_S,
    contexts=_SS, times_targeted=_I, zero_yield_count=_I, exhausted=_B,
)
LINK_STATE = _struct(key=_S, times_targeted=_I, zero_yield_count=_I, exhausted=_B)
HYPOTHESIS = _struct(id=_S, name=_S, origin=_S, links=_SS, rationale=_S, status=_S, reason=_S, open=_B, score=_D, logic_factor=_D, logic_flags=_SS)
PAIR_VERDICT = _struct(lo=_S, hi=_S, same_finding=_B, same_context=_B)
CONFLICT = _struct(cluster_key=_S, verdict=_S, explanation=_S, discriminating_experiment=_S, claim_ids=_SS)
USAGE = _struct(task=_S, model=_S, calls=_I, items=_I, failures=_I, tokens_in=T.LongType(), tokens_out=T.LongType(), tokens_reasoning=T.LongType(), seconds=_D)
