"""Row rules: named conditions that each row must meet, and what comes of it if not."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import PREFIXES
from ..functions.instants import ISO, instant
from ..schemas import ENUMS, fields_of


class ViolationError(ValueError):
    """A rule doesn't hold; the message names the first violation."""


def failed(rules: Mapping[str, Column]) -> Column:
    """ARRAY<STRING> of the rules that a row breaks, in order; a rule that is null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))


def violations(rows: DataFrame, rules: Mapping[str, Column], *, key: str = "id") -> DataFrame:
    """(rule_no, rule, id) for each rule that a row breaks."""
    names = F.array(*map(F.lit, rules))
    broken = rows.select(F.col(key).alias("id"), F.explode(failed(rules)).alias("rule"))
    return broken.select(F.array_position(names, F.col("rule")).cast("int").alias("rule_no"), "rule", "id")


def raise_on(found: DataFrame, *order: str) -> None:
    """Raise for the first violation, if there is any."""
    first = found.orderBy(*(order or found.columns[:1])).limit(1).collect()
    if first:
        raise ViolationError(", ".join(f"{k}={v}" for k, v in first[0].asDict().items()))


def iso_or_null(text: Column) -> Column:
    return text.isNull() | F.upper(text).rlike(ISO)


def all_start_with(ids: Column, *prefixes: str) -> Column:
    """Every element has one of the prefixes; a null list has no element."""
    test = lambda x: F.coalesce(F.rlike(x, F.lit("^(" + "|".join(prefixes) + ")")), F.lit(False))
    return F.coalesce(F.forall(ids, test), F.lit(True))


def ordered(earlier: Column, later: Column) -> Column:
    """Of two ISO strings the first is not after the second, if both are there."""
    return F.coalesce(instant(earlier) <= instant(later), F.lit(True))


#: Which prefix the ids of a list have, by the list's name.
_LIST_PREFIXES = {
    "source_record_ids": ("src_",), "episode_record_ids": ("ep_",), "candidate_ids": ("cand_",), "target_candidate_ids": ("cand_",), "target_ledger_entry_ids": ("fact_", "pref_", "dec_"), "active_fact_ids": ("fact_",),
    "active_preference_ids": ("pref_",), "active_decision_ids": ("dec_",), "active_taste_card_ids": ("taste_",), "active_project_state_ids": ("projstate_",), "target_taste_card_ids": ("taste_",),
}


def catalogue_rules(record_type: str, rows: DataFrame) -> dict[str, Column]:
    """The rules that the catalogue implies for a table's columns: ids and their prefixes, required texts,
    enumerations, times and their order."""
    columns, rules = dict(rows.dtypes), {}
    if "id" in columns:
        rules["id has its prefix"] = F.col("id").startswith(f"{PREFIXES.get(record_type, '')}_" if record_type in PREFIXES else "")
    for field, kind, enum in fields_of(record_type):
        if field not in columns:
            continue
        if kind == "s" and columns[field] == "string":
            rules[f"{field} is required"] = F.coalesce(F.trim(F.col(field)), F.lit("")) != ""
        if enum:
            rules[f"{field} is known"] = F.col(field).isin(*ENUMS[enum])
        if columns[field] == "string" and (field.endswith("_at") or field in ("valid_from", "valid_until", "stale_after", "as_of")):
            rules[f"{field} is a time"] = iso_or_null(F.col(field))
        if columns[field] == "array<string>" and (field in _LIST_PREFIXES or field.endswith("span_ids")):
            rules[f"{field} have their prefix"] = all_start_with(F.col(field), *_LIST_PREFIXES.get(field, ("span_",)))
    for later in ("valid_until", "stale_after"):
        if {"valid_from", later} <= set(columns):
            rules[f"{later} is not before valid_from"] = ordered(F.col("valid_from"), F.col(later))
    return rules


def span_rules() -> dict[str, Column]:
    c = F.col
    quoted = c("text_excerpt").isNotNull()
    return {
        "id has its prefix": c("id").rlike("^span_[0-9a-f]{16,}$"),
        "source_id has its prefix": c("source_id").startswith("src_"),
        "locator is complete": (F.coalesce(c("locator.kind"), F.lit("")) != "") & (F.coalesce(c("locator.value"), F.lit("")) != ""),
        "excerpt_policy is known": c("excerpt_policy").isin(*ENUMS["excerpt_policy"]),
        "excerpt follows its policy": ~(quoted & (c("excerpt_policy") == "none")),
        "span_hash_sha256 is a digest": c("span_hash_sha256").rlike("^[0-9a-f]{64}$"),
        "privacy_class is known": c("privacy_class").isin(*ENUMS["privacy_class"]),
    }


def ledger_rules() -> dict[str, Column]:
    c = F.col
    replaced = F.coalesce(F.array_size("superseded_by"), F.lit(0)) > 0
    return {
        "schema_version is known": c("schema_version").isin("1.0.0", "1.1.0"),
        "ledger_type is known": c("ledger_type").isin(*ENUMS["ledger_type"]),
        "status is known": c("status").isin(*ENUMS["status"]),
        "confidence is known": c("confidence").isin(*ENUMS["confidence"]),
        "evidence is given": F.coalesce(F.array_size("evidence_span_ids"), F.lit(0)) > 0,
        "evidence has its prefix": all_start_with(c("evidence_span_ids"), "span_"),
        "sources have their prefix": all_start_with(c("source_record_ids"), "src_"),
        "decision has its prefix": c("reducer_decision_id").startswith("redmem_"),
        "valid_from is a time": iso_or_null(c("valid_from")),
        "valid_until is a time": iso_or_null(c("valid_until")),
        "stale_after is a time": iso_or_null(c("stale_after")),
        "validity is ordered": ordered(c("valid_from"), c("valid_until")),
        "staleness is ordered": ordered(c("valid_from"), c("stale_after")),
        "links have their prefix": all_start_with(c("supersedes"), "fact_", "pref_", "dec_") & all_start_with(c("superseded_by"), "fact_", "pref_", "dec_"),
        "superseded names its successor": (c("status") != "superseded") | replaced,
        "superseded has an end": (c("status") != "superseded") | c("valid_until").isNotNull(),
        "active has no successor": (c("status") != "active") | ~replaced,
    }
