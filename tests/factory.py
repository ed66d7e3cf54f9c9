"""Small claims with the defaults of the rule tables."""

from claimloom import schemas as S

DEFAULTS = {
    "claim_type": "observation", "subject": "a", "object": "b", "subject_attribute": "none", "object_attribute": "none", "relation": "increases", "system": "animal_in_vivo",
    "context_tissue": "", "context_model": "", "context_cell_type": "cd8", "perturbation_class": "none", "rescue_arm": False, "orthogonal_validation": False,
    "comparator_present": True, "readout_is_inferred": False, "span": "x" * 30, "methods_span": "", "study_type": "animal", "text_access": "abstract_only",
    "subject_concept": "LOCAL:a", "object_concept": "LOCAL:b", "subject_label": "a", "object_label": "b", "subject_parents": [], "object_parents": [], "context_concept": "",
    "round": 1, "method_checks": [], "drop_reason": "", "relation_raw": "", "relation_norm": "increases", "grade": "ungraded",
}


def claim(id, pmid="p1", relation="increases", grade="strong", **kw):
    return {**DEFAULTS, "id": id, "pmid": pmid, "relation_norm": relation, "grade": grade, **kw}


def claims(spark, *rows):
    names = S.CLAIM.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], S.CLAIM)
