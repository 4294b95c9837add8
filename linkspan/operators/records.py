"""The record of a run: an empty one with every field in its place, calibration that is filled in later, and what was suppressed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------------------------
VERSION = "3.3"
#: Calibration: what could not be got, by source and by call; what is wrong; what there was nothing to check of. Every value starts null.
CALIBRATION = {
    "technical_failures": {
        "by_source": {
            "pubmed": ("id_retrieval_shortfall", "layer3_fallback", "fetch_failure_rate", "fetch_failure_count", "no_abstract_rate", "no_abstract_count", "fetch_attempted_count"),
            "orphadata_epidemiology": ("data_availability", "stale_warning"),
            "orphadata_natural_history": ("data_availability", "stale_warning"),
            "orphadata_nomenclature": ("no_local_match",),
            "fda_table": ("table_source", "stale_warning"),
            "fda_approval": ("load_error",),
        },
        "by_model_call": {
            "claim_verification": ("unverified_count", "unverified_rate", "unverified_api_count", "unverified_no_abstract_count"),
            "citation_integrity": ("unverified_count", "unverified_rate", "unverified_unreachable_count", "unverified_unparseable_count"),
            "endpoint_plausibility": ("unverified_model_failure",),
            "endpoint_evidence_filter": ("fallback_rate", "batches_fallback", "articles_retained_unfiltered"),
            "generative_agent": ("generation_truncated", "generated_from_fallback", "malformed_endpoint_count", "defaulted_endpoint_type_count"),
            "category4_supplementary": ("retrieval_failed", "relevance_filter_applied", "no_abstract_count"),
        },
    },
    "content_errors": ("hallucination_count", "out_of_set_count", "pipeline_error_count", "contradiction_count"),
    "structural_signals": ("no_endpoints_to_verify", "no_framework_citations", "challenge_zero_articles"),
    "miscategorization_signals": ("gene_resolution_file_load_degraded",),
    "gene_resolution_worklist": ("gene_not_resolved",),
}
#: The parts of a disease's record; [] an empty list, {} an empty map, null nothing yet.
DISEASE = {
    "biology": {"report": {}},
    "evidence": {
        "pubmed_citations": [], "pubmed_total_found": 0, "pubmed_audit": {}, "pubmed_excluded_pmids": [], "pubmed_layer3_audit": {}, "pubmed_study_type_counts": {},
        "pico_components_used": [], "clinical_trials": [], "trials_total_found": 0, "fda_approval_history": {}, "endpoint_map": {},
    },
    "endpoints": {
        "fda_found": False, "fda_matched_entry": None, "fda_patient_population": None, "fda_surrogate_endpoint": None, "fda_approval_type": None,
        "fda_table_section": None, "fda_match_rationale": None, "generated_framework": {},
    },
    "classification": {"category": None, "category_rationale": ""},
    "audit_trail": {
        "comparator_output": {}, "endpoint_plausibility_output": {}, "citation_integrity_output": {}, "claim_verification_output": {}, "evidence_quality_output": {},
        "human_review_required": False, "minority_positions_documented": [], "evidence_cutoff_date": "", "agents_run_count": 0, "agents_suppressed_count": 0,
        "case_reports_stripped": [], "case_reports_stripped_count": 0,
    },
}
CATEGORIES = ("1", "2", "3", "4")
ENDPOINT_TYPES = ("BIOCHEMICAL_SURROGATE", "NON_BIOCHEMICAL")
GRADES = ("High", "Moderate", "Low", "Very Low")
# -------------------------------------------------------------------------------------------------------------------------


def _filled(fields: dict | tuple, values: dict[str, Column], path: str = "") -> Column:
    if isinstance(fields, tuple):
        return F.struct(*[values.get(f"{path}{f}", F.lit(None)).cast("string").alias(f) for f in fields])
    return F.struct(*[_filled(v, values, f"{path}{k}.").alias(k) for k, v in fields.items()])


def _value(v) -> Column:
    if isinstance(v, dict):
        return F.struct(*[_value(x).alias(k) for k, x in v.items()]) if v else F.create_map().cast("map<string,string>")
    if isinstance(v, list):
        return F.array().cast("array<string>")
    return F.lit(v).cast("string") if v is None else F.lit(v)


def names(fields: dict | tuple = CALIBRATION, path: str = "") -> list[str]:
    """Every value of the calibration block by its path."""
    if isinstance(fields, tuple):
        return [path + f for f in fields]
    return [n for k, v in fields.items() for n in names(v, f"{path}{k}.")]


def calibration(values: dict[str, Column] | None = None) -> Column:
    """The calibration block; ``values`` by path (part.part.name), every other value null. An unknown path is a KeyError."""
    values = values or {}
    if unknown := set(values) - set(names()):
        raise KeyError(f"not in the calibration block: {sorted(unknown)}")
    return _filled(CALIBRATION, values)


def rate(count: Column, of: Column) -> Column:
    """A share, null where there was nothing to count."""
    return F.round(F.try_divide(count, of), 6)


def disease_record(orpha_id: Column, name: Column, day: Column, values: dict[str, Column] | None = None) -> Column:
    """A struct with every part of a disease's record, empty but for its identity and what a run measured (``values``, see ``calibration``)."""
    meta = F.struct(
        orpha_id.alias("orpha_id"), name.alias("disease_name"), F.lit(VERSION).alias("schema_version"), day.cast("string").alias("pipeline_build_date"),
        *[_value(v).alias(k) for k, v in {"synonyms": [], "definition": "", "orphadata": {}, "canonical_disease_object": {}, "gene_lookup_result": {}, "agents_run": [], "agents_suppressed": []}.items()],
    )
    return F.struct(meta.alias("metadata"), *[_value(v).alias(k) for k, v in DISEASE.items()], calibration(values).alias("calibration"))


def suppression(agent: Column, reason: Column, threshold: Column, day: Column) -> Column:
    """The record of a step that was left out, and what evidence would bring it back."""
    return F.struct(agent.alias("agent"), reason.alias("suppression_reason"), threshold.alias("evidence_threshold_for_reactivation"), day.cast("string").alias("date_of_review"))
