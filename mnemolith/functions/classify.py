"""What kind of record a row is, from the keys or values it has. Views that differ on purpose."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which key, in this order, tells an embedding's record type.
_KEYS = (("source_type", "source_record"), ("episode_type", "episode_record"), ("span_hash_sha256", "evidence_span"))
_LATER_KEYS = (("card_type", "taste_card"), ("pack_type", "context_pack"), ("decision_type", "memory_reducer_decision"))
# Identifier prefixes of each plane.
_PLANE_PREFIXES = (
    ("evidence", ("src_", "ep_", "span_")), ("candidate", ("cand_",)), ("ledger", ("fact_", "pref_", "dec_")), ("taste", ("taste_", "redtaste_")),
    ("state", ("projstate_", "corestate_", "redstate_")), ("contextpack", ("ctx_", "ctxreceipt_", "ctxval_")), ("reducer_decision", ("redmem_",)), ("audit", ("confres_", "hygiene_")),
)


def _has(keys: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(keys, key), F.lit(False))


def citation_kind(keys: Column) -> Column:
    """source, evidence or claim: the part a record plays in a citation graph; null if none."""
    return (
        F.when(_has(keys, "source_type") | _has(keys, "episode_type"), "source")
        .when(_has(keys, "span_hash_sha256"), "evidence")
        .when(_has(keys, "evidence_span_ids") | _has(keys, "evidence_id"), "claim")
    )


def claim_type(keys: Column, candidate_type: Column, ledger_type: Column) -> Column:
    """The type of a claim in a citation graph: what it says it is, else what its keys tell, else claim."""
    taste = _has(keys, "taste_card") | (_has(keys, "domain") & _has(keys, "signal_kind"))
    return (
        F.when(_has(keys, "ledger_type"), F.coalesce(ledger_type, F.lit("ledger_entry")))
        .when(_has(keys, "candidate_type"), F.coalesce(candidate_type, F.lit("candidate")))
        .when(taste, "taste_signal_candidate")
        .when(_has(keys, "context_pack_kind") | _has(keys, "primary_evidence_span_ids"), "context_pack")
        .otherwise("claim")
    )


def compiler_type(values: Mapping[str, Column]) -> Column:
    """The type by which the pack compiler groups records: the first member, in this order, that has a value.

    Null and empty values count as none; members that aren't given have none.
    """
    has = lambda name: F.coalesce(values[name] != "", F.lit(False)) if name in values else F.lit(False)
    value = lambda name: values.get(name, F.lit(""))
    out = F
    for name, kind in _KEYS:
        out = out.when(has(name), kind)
    out = out.when(has("candidate_type"), F.concat(F.lit("candidate_"), value("candidate_type"))).when(has("ledger_type"), F.concat(value("ledger_type"), F.lit("_ledger_entry")))
    for name, kind in _LATER_KEYS:
        out = out.when(has(name), kind)
    return out.otherwise("unknown")


def record_type(keys: Column, candidate_type: Column, ledger_type: Column) -> Column:
    """The full type name, by which texts are rendered."""
    out = F
    for key, name in _KEYS:
        out = out.when(_has(keys, key), name)
    out = out.when(_has(keys, "candidate_type"), F.concat(F.lit("candidate"), F.when(F.coalesce(candidate_type, F.lit("")) != "", F.concat(F.lit("_"), candidate_type)).otherwise("")))
    out = out.when(_has(keys, "ledger_type"), F.concat(ledger_type, F.lit("_ledger_entry")))
    for key, name in _LATER_KEYS:
        out = out.when(_has(keys, key), name)
    out = out.when(_has(keys, "context_pack_id") & _has(keys, "builder"), "context_pack_build_receipt")
    return out.when(_has(keys, "context_pack_id") & _has(keys, "validator"), "context_pack_validation_report").otherwise("unknown")


def plane_of_type(kind: Column) -> Column:
    """The plane of a full type name."""
    return (
        F.when(kind.isin("source_record", "episode_record", "evidence_span"), "evidence")
        .when(kind.startswith("candidate_"), "candidate")
        .when(kind.endswith("_ledger_entry"), "ledger")
        .when(kind.isin("taste_card", "taste_card_signal"), "taste")
        .when(kind == "context_pack", "contextpack")
        .when(kind.contains("state"), "state")
        .otherwise("audit")
    )


def access_type(keys: Column, candidate_type: Column, ledger_type: Column) -> Column:
    """The short type name that scopes list; empty if none."""
    return (
        F.when(_has(keys, "ledger_type"), ledger_type)
        .when(_has(keys, "candidate_type"), candidate_type)
        .when(_has(keys, "source_type"), "source_record")
        .when(_has(keys, "episode_type"), "episode_record")
        .when(_has(keys, "pack_type"), "context_pack")
        .when(_has(keys, "span_hash_sha256"), "evidence_span")
        .otherwise("")
    )


def plane_of_id(key: Column) -> Column:
    """The plane of an identifier, by the prefixes that identifiers really have; other if none fits."""
    out = F
    for plane, prefixes in _PLANE_PREFIXES:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | key.startswith(prefix)
        out = out.when(test, plane)
    return out.otherwise("other")
