"""The record catalogue: fields of every record type, as StructTypes and as JSON Schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations and identifier prefixes of the record model.
ENUMS = {
    "source_type": ("chatgpt_conversation", "codex_session", "email_thread", "whatsapp_thread", "meeting_transcript", "bookmark", "web_article", "pdf", "repo_diff", "manual_note", "other"),
    "privacy_class": ("public", "internal", "private", "sensitive", "highly_sensitive"),
    "custody_status": ("synthetic", "redacted", "local_ignored", "external_pointer", "unavailable"),
    "episode_type": ("conversation_segment", "meeting_segment", "email_thread", "bookmark_event", "task_event", "decision_event", "document_section", "other"),
    "excerpt_policy": ("none", "synthetic", "redacted", "short_quote_allowed"),
    "candidate_type": ("claim", "preference", "decision", "task", "taste_signal"),
    "ledger_type": ("fact", "preference", "decision"),
    "confidence": ("low", "medium", "high"),
    "report_status": ("pass", "fail"),
    "status": ("active", "stale", "superseded", "retracted", "contested", "archived"),
}

# Fields per record type. s string, n nullable string, l list of strings, o object, j free-form object,
# m map of strings, d nullable number, i integer, b boolean; a suffix after a colon names an enumeration or an id prefix.
_LEDGER = (
    "id:s schema_version:s ledger_type:s:ledger_type status:s:status confidence:s:confidence scope:s source_record_ids:l episode_record_ids:l evidence_span_ids:l candidate_ids:l "
    "reducer_decision_id:s observed_at:n asserted_at:n valid_from:n valid_until:n stale_after:n created_at:s updated_at:s supersedes:l superseded_by:l metadata:j freshness_score:d"
)
_CANDIDATE = (
    "id:s schema_version:s candidate_type:s:candidate_type source_record_ids:l episode_record_ids:l evidence_span_ids:l natural_language_summary:s extracted_by:o extracted_at:s "
    "confidence:s:confidence risk_class:s status:s review:o metadata:j"
)
_STATE = (
    "id:s schema_version:s state_type:s status:s as_of:s summary:s active_fact_ids:l active_preference_ids:l active_decision_ids:l active_taste_card_ids:l source_record_ids:l episode_record_ids:l "
    "evidence_span_ids:l reducer_decision_id:s valid_from:n valid_until:n stale_after:n created_at:s updated_at:s supersedes:l superseded_by:l metadata:j freshness_score:d"
)
_DECISION = "id:s schema_version:s decision_type:s {targets} evidence_span_ids:l rationale:s decided_by:o decided_at:s confidence:s:confidence risk_class:s checks:m metadata:j"
_PROPOSAL = (
    "id:s schema_version:s created_at:s metadata:j promotion_allowed_without_reducer:b proposed_action:s requires_reducer_decision:b resolver_input_bundle_id:s resolver_run_id:s "
    "supporting_candidate_ids:l supporting_intake_envelope_ids:l"
)
FIELDS: dict[str, str] = {
    "source_record": "id:s schema_version:s source_type:s:source_type title:s origin_uri:n raw_ref:o content_hash_sha256:s captured_at:s observed_at:n author_or_sender:n participants:l privacy_class:s:privacy_class custody_status:s:custody_status parser_version:s metadata:j",
    "episode_record": "id:s schema_version:s source_id:s episode_type:s:episode_type episode_locator:o title:s summary:s event_time_start:n event_time_end:n actors:l topics:l project_refs:l evidence_span_ids:l metadata:j",
    "evidence_span": "id:s schema_version:s source_id:s episode_id:n locator:o text_excerpt:n excerpt_policy:s:excerpt_policy span_hash_sha256:s privacy_class:s:privacy_class metadata:j",
    "candidate_claim": f"{_CANDIDATE} subject:s predicate:s object:s claim_text:s claim_scope:s temporal_hint:o",
    "candidate_preference": f"{_CANDIDATE} subject:s preference_text:s domain:s scope:s strength_hint:s counterevidence_span_ids:l",
    "candidate_decision": f"{_CANDIDATE} decision_text:s decision_scope:s alternatives_mentioned:l rationale_text:n decision_time_hint:n owner_hint:n reversibility:s",
    "candidate_task": f"{_CANDIDATE} task_text:s task_kind:s project_refs:l owner_hint:n due_at_hint:n urgency_hint:s safety_lane:s autostart_eligible:b",
    "candidate_taste_signal": f"{_CANDIDATE} domain:s signal_kind:s taste_text:s example_span_ids:l contrast_span_ids:l strength_hint:s",
    "fact_ledger_entry": f"{_LEDGER} subject:s predicate:s object:s fact_text:s",
    "preference_ledger_entry": f"{_LEDGER} subject:s preference_text:s domain:s strength:s",
    "decision_ledger_entry": f"{_LEDGER} decision_text:s decision_scope:s alternatives_considered:l rationale_text:n owner:n reversibility:s",
    "memory_reducer_decision": _DECISION.format(targets="target_candidate_ids:l target_ledger_entry_ids:l"),
    "taste_reducer_decision": _DECISION.format(targets="target_taste_signal_ids:l target_taste_card_ids:l"),
    "state_reducer_decision": _DECISION.format(targets="target_project_state_ids:l target_core_state_ids:l source_record_ids:l episode_record_ids:l ledger_entry_ids:l taste_card_ids:l"),
    "taste_card": "id:s schema_version:s card_type:s status:s subject:s domain:s scope:s project_refs:l principle:s rationale:s strength:s confidence:s:confidence taste_kind:s source_record_ids:l episode_record_ids:l evidence_span_ids:l candidate_taste_signal_ids:l positive_example_span_ids:l negative_example_span_ids:l contrast_pairs:p objection_patterns:l application_notes:l reducer_decision_id:s observed_at:n asserted_at:n valid_from:n valid_until:n stale_after:n created_at:s updated_at:s supersedes:l superseded_by:l metadata:j freshness_score:d",
    "project_state_snapshot": f"{_STATE} project_id:s project_name:s project_status:s current_objective:s current_strategy:s current_priorities:l active_blockers:l open_questions:l next_actions:l candidate_task_ids:l",
    "core_state_snapshot": f"{_STATE} subject:s current_priorities:l active_project_state_ids:l standing_principles:l operating_style:l approval_boundaries:l constraints:l",
    "context_pack": "id:s schema_version:s pack_type:s task:o authority:o state:o trusted_memory:o candidate_context:o evidence:o stale_or_superseded:o conflicts_and_uncertainties:p constraints:o retrieval_trace:o pack_hash_sha256:s metadata:j",
    "context_pack_build_receipt": "id:s schema_version:s context_pack_id:s created_at:s builder:o input_refs:o selection_policy:o excluded:p warnings:l metadata:j",
    "context_pack_validation_report": "id:s schema_version:s context_pack_id:s validated_at:s validator:o status:s:report_status checks:m errors:p warnings:l metadata:j",
    "taste_delta_proposal": f"{_PROPOSAL} summary_redacted:s target_taste_card_ids:l",
    "project_state_delta_proposal": f"{_PROPOSAL} requires_human_review:b project_id:n current_state_summary_redacted:s proposed_delta_summary_redacted:s staleness_effect:s supporting_evidence_span_ids:l target_project_state_ids:l",
    "core_state_delta_proposal": f"{_PROPOSAL} requires_human_review:b proposed_delta_summary_redacted:s target_core_state_ids:l",
    "conflict_resolution": "id:s schema_version:s conflict_id:s chosen_version_index:i chosen_record:j rejected_record_ids:l resolved_by:s resolved_at:s rationale:s superseded_at:n metadata:j",
}

# The members of object-valued fields, and of the objects in lists, by the field's name.
_PLACE, _MAKER, _LEDGER_IDS = "kind:s value:s", "agent:s model:n tool:n prompt_ref:n", "fact_ids:l preference_ids:l decision_ids:l taste_card_ids:l"
MEMBERS: dict[str, str] = {
    "raw_ref": _PLACE, "locator": _PLACE, "episode_locator": _PLACE, "extracted_by": _MAKER, "decided_by": _MAKER, "review": "reviewed_by:n reviewed_at:n review_notes:n",
    "temporal_hint": "observed_at:n asserted_at:n valid_from_hint:n valid_until_hint:n", "contrast_pairs": "preferred_span_id:s rejected_span_id:s reason:s",
    "task": "task_id:s task_title:s task_type:s task_summary:s project_id:n risk_class:s sensitivity:s:privacy_class", "authority": "created_by:s created_at:s source:s schema_pack_version:s kernel_commit:n",
    "state": "core_state_id:n project_state_ids:l", "trusted_memory": _LEDGER_IDS, "stale_or_superseded": f"{_LEDGER_IDS} project_state_ids:l core_state_ids:l",
    "candidate_context": "candidate_task_ids:l candidate_claim_ids:l candidate_preference_ids:l candidate_decision_ids:l candidate_taste_signal_ids:l",
    "evidence": "source_record_ids:l episode_record_ids:l evidence_span_ids:l primary_evidence_span_ids:l", "conflicts_and_uncertainties": "kind:s summary:s related_ids:l",
    "constraints": "permission_policy_id:s allowed_actions:l forbidden_actions:l privacy_notes:l token_budget:i", "retrieval_trace": "queries:l included_ids:l excluded:p build_inputs_hash:s", "excluded": "id:s reason:s",
    "builder": "agent:s model:n tool:n mode:s", "input_refs": "core_state_ids:l project_state_ids:l ledger_entry_ids:l taste_card_ids:l candidate_ids:l evidence_span_ids:l",
    "selection_policy": "current_cutoff:s include_stale:b include_contested:b include_candidates:b token_budget:i", "validator": "agent:s tool:s version:s", "errors": "code:s message:s related_ids:l",
}

_SPARK = {
    "s": T.StringType(), "n": T.StringType(), "l": T.ArrayType(T.StringType()), "j": T.StringType(), "m": T.MapType(T.StringType(), T.StringType()), "d": T.DoubleType(), "i": T.LongType(), "b": T.BooleanType(),
}
_JSON: dict[str, dict] = {
    "s": {"type": "string"}, "n": {"type": ["string", "null"]}, "l": {"type": "array", "items": {"type": "string"}}, "j": {"type": "object"}, "m": {"type": "object"},
    "d": {"type": ["number", "null"]}, "i": {"type": "integer"}, "b": {"type": "boolean"},
}


class SchemaNotFoundError(KeyError):
    """No record type of that name."""


def _parts(spec: str) -> list[tuple[str, str, str]]:
    return [(*parts, "")[:3] for parts in (f.split(":") for f in spec.split())]  # type: ignore[misc]


def fields_of(name: str) -> list[tuple[str, str, str]]:
    """(field, kind, enumeration or '') of a record type."""
    if name not in FIELDS:
        raise SchemaNotFoundError(name)
    return _parts(FIELDS[name])


def _spark(parts: list[tuple[str, str, str]]) -> T.StructType:
    def one(field: str, kind: str) -> T.DataType:
        if kind in ("o", "p"):
            inner = _spark(_parts(MEMBERS[field]))
            return inner if kind == "o" else T.ArrayType(inner)
        return _SPARK[kind]

    return T.StructType([T.StructField(f, one(f, k)) for f, k, _ in parts])


def struct_type(name: str) -> T.StructType:
    """The StructType with which JSON records of a type are read."""
    return _spark(fields_of(name))


def _closed(parts: list[tuple[str, str, str]]) -> dict:
    optional = {"freshness_score", "temporal_hint"}
    properties: dict[str, dict] = {}
    for field, kind, enum in parts:
        if kind in ("o", "p"):
            inner = _closed(_parts(MEMBERS[field]))
            properties[field] = inner if kind == "o" else {"type": "array", "items": inner}
        else:
            properties[field] = dict(_JSON[kind], **({"enum": list(ENUMS[enum])} if enum else {}))
    return {"type": "object", "additionalProperties": False, "required": [f for f in properties if f not in optional], "properties": properties}


def json_schema(name: str) -> dict:
    """A closed JSON Schema of a record type."""
    schema = _closed(fields_of(name))
    schema["properties"]["id"] = {"type": "string", "minLength": 1}
    return schema
