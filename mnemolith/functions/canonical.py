"""Canonical JSON, digests and content-derived identifiers as columns."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# Identifier prefixes by record type.
PREFIXES = {
    "source_record": "src", "episode_record": "ep", "evidence_span": "span", "candidate_claim": "cand_claim", "candidate_preference": "cand_pref", "candidate_decision": "cand_decision",
    "candidate_task": "cand_task", "candidate_taste_signal": "cand_taste", "fact_ledger_entry": "fact", "preference_ledger_entry": "pref", "decision_ledger_entry": "dec",
    "memory_reducer_decision": "redmem", "taste_card": "taste", "taste_reducer_decision": "redtaste", "project_state_snapshot": "projstate", "core_state_snapshot": "corestate",
    "state_reducer_decision": "redstate", "context_pack": "ctx", "context_pack_build_receipt": "ctxreceipt", "context_pack_validation_report": "ctxval",
    "conflict_resolution": "confres", "memory_hygiene_report": "hygiene", "taste_delta_proposal": "tastedelta", "project_state_delta_proposal": "projdelta", "core_state_delta_proposal": "coredelta",
}

_write = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _canonical_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return _write(json.loads(text))
    except ValueError:
        return None


@arrow_udf(StringType())
def canonical_json(text: pa.Array) -> pa.Array:
    """JSON text with sorted keys, no blanks and plain non-ASCII letters; null if it is no JSON.

    Spark's own VARIANT writer differs in whole floats, exponents and key order beyond the BMP, hence this
    one Arrow UDF; callers keep its result instead of calling it again.
    """
    return pa.array([_canonical_text(t) for t in text.to_pylist()], pa.string())


def members(fields: Mapping[str, Column]) -> Column:
    """A struct with its members in sorted order.

    Named by literals: aliases of constants are lost where Spark takes an expression out of a generator.
    """
    return F.named_struct(*[x for k in sorted(fields) for x in (F.lit(k), fields[k])])


def canonical_struct(**fields: Column) -> Column:
    """Canonical JSON of an object with the given members, inside codegen. Floats don't belong in it."""
    return F.to_json(members(fields), {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def prefixed_id(prefix: str | Column, payload: Column) -> Column:
    """prefix_ and the first 24 hex digits of the payload's SHA-256."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("_"), F.substring(sha256(payload), 1, 24))


def _locator(locator: Column) -> Column:
    return members({"kind": locator["kind"], "value": locator["value"]})


def source_id(source_type: Column, origin_uri: Column, raw_ref: Column, content_hash: Column) -> Column:
    """Of the origin's URI, or of the raw reference where there is none."""
    by_uri = canonical_struct(source_type=source_type, origin_or_raw_ref=origin_uri, content_hash_sha256=content_hash)
    by_ref = canonical_struct(source_type=source_type, origin_or_raw_ref=_locator(raw_ref), content_hash_sha256=content_hash)
    return prefixed_id("src", F.when(origin_uri.isNotNull(), by_uri).otherwise(by_ref))


def episode_id(source: Column, episode_type: Column, locator: Column) -> Column:
    return prefixed_id("ep", canonical_struct(source_id=source, episode_type=episode_type, locator_kind=locator["kind"], locator_value=locator["value"]))


def span_id(source: Column, locator: Column) -> Column:
    return prefixed_id("span", canonical_struct(source_id=source, locator_kind=locator["kind"], locator_value=locator["value"]))


def ledger_id(ledger_type: Column, spans: Column, semantic: Mapping[str, Column]) -> Column:
    """Of the type, the sorted evidence and the meaning of an entry, of which both are a part too."""
    prefix = F.when(ledger_type == "fact", "fact").when(ledger_type == "preference", "pref").when(ledger_type == "decision", "dec")
    whole = {**semantic, "ledger_type": ledger_type, "evidence_span_ids": F.array_sort(spans)}
    meaning = members(whole)
    return prefixed_id(prefix, canonical_struct(ledger_type=ledger_type, evidence_span_ids=F.array_sort(spans), normalized_payload=meaning))


def candidate_id(candidate_type: Column, spans: Column, semantic: Mapping[str, Column]) -> Column:
    prefix = F.lit(None).cast("string")
    for kind in ("claim", "preference", "decision", "task", "taste_signal"):
        prefix = F.when(candidate_type == kind, PREFIXES[f"candidate_{kind}"]).otherwise(prefix)
    meaning = members(semantic)
    return prefixed_id(prefix, canonical_struct(candidate_type=candidate_type, evidence_span_ids=F.array_sort(spans), normalized_payload=meaning))


def content_id(record_type: str, **payload: Column) -> Column:
    """The identifier of any other record type from its payload; lists of ids are to be sorted by the caller."""
    return prefixed_id(PREFIXES[record_type], canonical_struct(**payload))
