"""The identifier that a record's content demands, for every record type with a payload of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import PREFIXES, canonical_struct, episode_id, members, prefixed_id, source_id, span_id

# The fields that make up a record's meaning; * marks lists whose order doesn't matter.
MEANING = {
    "candidate_claim": "subject predicate object claim_text claim_scope temporal_hint",
    "candidate_preference": "subject preference_text domain scope strength_hint counterevidence_span_ids*",
    "candidate_decision": "decision_text decision_scope alternatives_mentioned rationale_text decision_time_hint owner_hint reversibility",
    "candidate_task": "task_text task_kind project_refs owner_hint due_at_hint urgency_hint safety_lane autostart_eligible",
    "candidate_taste_signal": "domain signal_kind taste_text example_span_ids* contrast_span_ids* strength_hint",
    "fact_ledger_entry": "ledger_type subject predicate object scope valid_from evidence_span_ids*",
    "preference_ledger_entry": "ledger_type subject preference_text domain scope valid_from evidence_span_ids*",
    "decision_ledger_entry": "ledger_type decision_text decision_scope scope valid_from evidence_span_ids*",
    "taste_card": "subject domain scope project_refs* principle taste_kind valid_from evidence_span_ids*",
    "project_state_snapshot": "project_id project_name project_status as_of current_objective current_strategy current_priorities active_blockers open_questions active_fact_ids* active_preference_ids* active_decision_ids* active_taste_card_ids* evidence_span_ids*",
    "core_state_snapshot": "subject as_of current_priorities active_project_state_ids* standing_principles operating_style approval_boundaries constraints active_fact_ids* active_preference_ids* active_decision_ids* active_taste_card_ids* evidence_span_ids*",
}
# What stands beside the meaning in the hashed payload, or makes it up alone.
HEAD = {
    "candidate": "candidate_type evidence_span_ids*", "ledger": "ledger_type evidence_span_ids*", "taste_card": "evidence_span_ids*", "project_state_snapshot": "project_id as_of evidence_span_ids*",
    "core_state_snapshot": "subject as_of evidence_span_ids*", "memory_reducer_decision": "decision_type target_candidate_ids* target_ledger_entry_ids* evidence_span_ids* rationale",
    "taste_reducer_decision": "decision_type target_taste_signal_ids* target_taste_card_ids* evidence_span_ids* rationale",
    "state_reducer_decision": "decision_type target_project_state_ids* target_core_state_ids* evidence_span_ids* ledger_entry_ids* taste_card_ids* rationale",
}


def _fields(spec: str, columns: list[str]) -> dict[str, Column]:
    out = {}
    for field in spec.split():
        name = field.rstrip("*")
        column = F.col(name) if name in columns else F.lit(None).cast("string")
        out[name] = F.array_sort(column) if field.endswith("*") and name in columns else column
    return out


def expected_id(record_type: str, columns: list[str]) -> Column:
    """The identifier of a row of this type; columns that are missing count as null."""
    c = F.col
    if record_type == "source_record":
        return source_id(c("source_type"), c("origin_uri"), c("raw_ref"), c("content_hash_sha256"))
    if record_type == "episode_record":
        return episode_id(c("source_id"), c("episode_type"), c("episode_locator"))
    if record_type == "evidence_span":
        return span_id(c("source_id"), c("locator"))
    family = "candidate" if record_type.startswith("candidate_") else "ledger" if record_type.endswith("_ledger_entry") else record_type
    if family not in HEAD:
        raise ValueError(f"no payload is known for {record_type!r}")
    payload = _fields(HEAD[family], columns)
    if record_type in MEANING:
        meaning = _fields(MEANING[record_type], columns)
        payload["normalized_payload"] = members(meaning)
    return prefixed_id(PREFIXES[record_type], canonical_struct(**payload))


def with_id_check(rows: DataFrame, record_type: str) -> DataFrame:
    """`rows` with `expected_id` and `id_matches`."""
    return rows.withColumn("expected_id", expected_id(record_type, rows.columns)).withColumn("id_matches", F.col("id").eqNullSafe(F.col("expected_id")))
