"""Taste cards from taste signals, each with the decision that makes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import content_id, members

_CHECKS = ("provenance", "specificity", "example_grounding", "contrast_grounding", "privacy", "usefulness")


def _list(signals: DataFrame, name: str) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.col(name), none) if name in signals.columns else none


def cards_from_signals(signals: DataFrame, *, now: Column, rationale: str = "promoted from a grounded signal") -> tuple[DataFrame, DataFrame]:
    """(cards, decisions) of taste signals: one of each per signal that cites evidence, linked to each other.

    The examples of a signal are the card's positive ones, its contrasts the negative ones, and the first of
    each, the second and so on make contrast pairs. All of them become evidence of the card. Signals without
    evidence are left out; of several rows of one id the greatest counts. Identifiers follow from content.
    """
    c, none, nobody = F.col, F.lit(None).cast("string"), F.array().cast("array<string>")
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    positive, negative = _list(signals, "example_span_ids"), _list(signals, "contrast_span_ids")
    rows = signals.select(
        c("id").alias("signal_id"), "domain", "signal_kind", "taste_text", "strength_hint", "confidence", F.array_sort(F.array_distinct(F.concat(_list(signals, "evidence_span_ids"), positive, negative))).alias("spans"), positive.alias("positive"),
        negative.alias("negative"), _list(signals, "source_record_ids").alias("sources"), _list(signals, "episode_record_ids").alias("episodes"),
    ).where("signal_id is not null and size(spans) > 0")
    rows = rows.groupBy("signal_id").agg(F.max(F.struct(*[x for x in rows.columns if x != "signal_id"])).alias("r")).select("signal_id", "r.*").withColumn("at", at)
    meaning = members({"subject": c("domain"), "domain": c("domain"), "scope": F.lit("global"), "project_refs": nobody, "principle": c("taste_text"), "taste_kind": c("signal_kind"), "valid_from": c("at"), "evidence_span_ids": c("spans")})
    rows = rows.withColumn("card_id", content_id("taste_card", evidence_span_ids=c("spans"), normalized_payload=meaning))
    decision = content_id("taste_reducer_decision", decision_type=F.lit("promote"), target_taste_signal_ids=F.array("signal_id"), target_taste_card_ids=F.array("card_id"), evidence_span_ids=c("spans"), rationale=F.lit(rationale))
    rows = rows.withColumn("decision_id", decision)
    pairs = F.transform(F.arrays_zip(F.slice("positive", F.lit(1), F.least(F.size("positive"), F.size("negative"))), F.slice("negative", F.lit(1), F.least(F.size("positive"), F.size("negative")))), lambda p: F.struct(p["0"].alias("preferred_span_id"), p["1"].alias("rejected_span_id"), F.lit("").alias("reason")))
    cards = rows.select(
        c("card_id").alias("id"), F.lit("1.0.0").alias("schema_version"), F.lit("taste_card").alias("card_type"), F.lit("active").alias("status"), c("domain").alias("subject"), "domain", F.lit("global").alias("scope"), nobody.alias("project_refs"),
        c("taste_text").alias("principle"), F.lit(rationale).alias("rationale"), c("strength_hint").alias("strength"), "confidence", c("signal_kind").alias("taste_kind"), c("sources").alias("source_record_ids"), c("episodes").alias("episode_record_ids"),
        c("spans").alias("evidence_span_ids"), F.array("signal_id").alias("candidate_taste_signal_ids"), c("positive").alias("positive_example_span_ids"), c("negative").alias("negative_example_span_ids"), pairs.alias("contrast_pairs"),
        nobody.alias("objection_patterns"), nobody.alias("application_notes"), c("decision_id").alias("reducer_decision_id"), c("at").alias("observed_at"), c("at").alias("asserted_at"), c("at").alias("valid_from"), none.alias("valid_until"),
        none.alias("stale_after"), c("at").alias("created_at"), c("at").alias("updated_at"), nobody.alias("supersedes"), nobody.alias("superseded_by"), F.lit("{}").alias("metadata"),
    )
    by = F.struct(F.lit("taste-reducer").alias("agent"), F.lit("deterministic").alias("model"), none.alias("tool"), none.alias("prompt_ref"))
    decisions = rows.select(
        c("decision_id").alias("id"), F.lit("1.0.0").alias("schema_version"), F.lit("promote").alias("decision_type"), F.array("signal_id").alias("target_taste_signal_ids"), F.array("card_id").alias("target_taste_card_ids"),
        c("spans").alias("evidence_span_ids"), F.lit(rationale).alias("rationale"), by.alias("decided_by"), c("at").alias("decided_at"), "confidence", F.lit("low").alias("risk_class"),
        F.create_map(*[F.lit(x) for check in _CHECKS for x in (check, "pass")]).alias("checks"), F.lit("{}").alias("metadata"),
    )
    return cards, decisions
