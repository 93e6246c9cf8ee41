"""Promotion of candidates: an ordered chain of checks, and a decision and a ledger entry for what passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import content_id, ledger_id
from ..functions.instants import instant
from ..schemas import ENUMS
from .blocks import numbered

#: Candidates older than this are stale.
RECENCY_DAYS = 90
# Strengths that an entry can have, and what any other hint becomes.
STRENGTHS, OTHER_STRENGTH = ("weak", "medium", "strong", "hard_constraint"), "medium"
# What each kind of candidate becomes; other kinds aren't promoted.
BECOMES = {"claim": "fact", "preference": "preference", "taste_signal": "preference"}
_CHECKS = ("provenance", "temporal_validity", "contradiction_scan", "privacy", "usefulness")


def _column(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def judge(candidates: DataFrame, spans: DataFrame, *, now: Column, min_confidence: str = "medium", recency_days: int = RECENCY_DAYS, require_evidence: bool = True) -> DataFrame:
    """Candidates with `reason` and `message`, null for those that pass.

    The first check that fails is the reason: no_evidence (none cited, or a cited span that isn't there;
    left out unless `require_evidence`), low_confidence, stale (extracted too long ago, or at no known
    time), missing_span (nothing to found an entry on). Of several rows of an id the one that was extracted
    last counts, then the greatest by evidence, confidence and type; blanks around a time don't matter.
    """
    extracted = F.col("extracted_at")
    place = F.struct(instant(extracted).alias("t"), extracted.alias("x"), "evidence_span_ids", "confidence", "candidate_type")
    rows = candidates.groupBy("id").agg(F.max_by(F.struct(*[c for c in candidates.columns if c != "id"]), place).alias("r")).select("id", "r.*")
    cited = rows.select("id", F.posexplode("evidence_span_ids").alias("at", "ref"))
    lost = cited.join(spans.select(F.col("id").alias("ref")), "ref", "left_anti").groupBy("id").agg(F.min(F.struct("at", F.coalesce("ref", F.lit("null")).alias("ref")))["ref"].alias("lost"))
    ranks = F.array(*map(F.lit, ENUMS["confidence"]))
    rank = F.coalesce(F.array_position(ranks, F.col("confidence")), F.lit(0))
    least = ENUMS["confidence"].index(min_confidence) + 1
    fresh = instant(extracted) >= now - F.make_dt_interval(F.lit(recency_days))
    none = F.coalesce(F.array_size("evidence_span_ids"), F.lit(0)) == 0
    wants = F.lit(require_evidence)
    said = lambda reason, *parts: F.struct(F.lit(reason).alias("reason"), F.concat_ws("", *parts).alias("message"))
    verdict = (
        F.when(wants & none, said("no_evidence", F.lit("no evidence is cited")))
        .when(wants & F.col("lost").isNotNull(), said("no_evidence", F.lit("not among the evidence: "), F.col("lost")))
        .when(rank < least, said("low_confidence", F.lit("confidence is "), F.coalesce("confidence", F.lit("not given")), F.lit(f", least is {min_confidence}")))
        .when(~F.coalesce(fresh, F.lit(False)), said("stale", F.lit("extracted at "), F.coalesce("extracted_at", F.lit("no known time")), F.lit(f", over {recency_days} days ago or unreadable")))
        .when(none, said("missing_span", F.lit("an entry needs a span")))
    )
    return rows.join(lost, "id", "left").withColumn("v", verdict).withColumns({"reason": F.col("v.reason"), "message": F.col("v.message")}).drop("lost", "v")


def spread_over_spans(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates with one span each as their evidence, dealt out in turn by id; without spans, with none.

    Both sides are numbered in range sorts, so dealing out needs neither one task nor the driver.
    """
    last = spans.where("id is not null").select("id").distinct()
    many = last.count()
    if not many:
        return candidates.withColumn("evidence_span_ids", F.array().cast("array<string>"))
    placed = numbered(last, [F.col("id")], "place").select(F.col("id").alias("span_id"), (F.col("place") - 1).alias("turn"))
    dealt = numbered(candidates, [F.col("id")], "place").withColumn("turn", F.pmod(F.col("place") - 1, F.lit(many)))
    return dealt.join(placed, "turn").withColumn("evidence_span_ids", F.array("span_id")).select(candidates.columns if "evidence_span_ids" in candidates.columns else [*candidates.columns, "evidence_span_ids"])


def rejections(judged: DataFrame) -> DataFrame:
    """(reason, candidates)."""
    return judged.where("reason is not null").groupBy("reason").agg(F.count("*").alias("candidates"))


def rejected(judged: DataFrame) -> DataFrame:
    """(candidate_id, reason_code, message, candidate_type, confidence): the trail of what isn't promoted."""
    return judged.where("reason is not null").select(F.col("id").alias("candidate_id"), F.col("reason").alias("reason_code"), "message", "candidate_type", "confidence")


def _built(judged: DataFrame, now: Column, first_source: Column) -> DataFrame:
    """One row per candidate that passes, with what decision and entry are made of."""
    c = lambda name: _column(judged, name)
    kind = F.lit(None).cast("string")
    for name, entry in BECOMES.items():
        kind = F.when(F.col("candidate_type") == name, entry).otherwise(kind)
    taste = F.col("candidate_type") == "taste_signal"
    domain = c("domain")
    scope = F.when(F.col("candidate_type") == "claim", c("claim_scope")).when(taste, "global").otherwise(c("scope"))
    strength = c("strength_hint")
    sources = _column(judged, "source_record_ids", "array<string>")
    passed = judged.where("reason is null").select(
        F.col("id").alias("candidate_id"), kind.alias("ledger_type"), "candidate_type", "confidence", c("risk_class").alias("risk_class"), F.get("evidence_span_ids", F.lit(0)).alias("span_id"),
        F.coalesce(F.get(sources, F.lit(0)), first_source).alias("source_id"), F.when(taste, domain).otherwise(c("subject")).alias("subject"), c("predicate").alias("predicate"), c("object").alias("object"),
        c("claim_text").alias("fact_text"), F.when(taste, c("taste_text")).otherwise(c("preference_text")).alias("preference_text"), domain.alias("domain"), scope.alias("scope"), strength.alias("hint"),
        F.when(strength.isin(*STRENGTHS), strength).otherwise(OTHER_STRENGTH).alias("strength"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
    ).where("ledger_type is not null")
    shared = {"scope": F.col("scope"), "valid_from": F.col("at"), "subject": F.col("subject")}
    fact = ledger_id(F.lit("fact"), F.array("span_id"), {**shared, "predicate": F.col("predicate"), "object": F.col("object")})
    preference = ledger_id(F.lit("preference"), F.array("span_id"), {**shared, "preference_text": F.col("preference_text"), "domain": F.col("domain")})
    last = F.when(F.col("candidate_type") == "claim", F.concat(F.lit("; scope="), F.coalesce("scope", F.lit("None")))).when(F.col("candidate_type") == "taste_signal", F.concat(F.lit("; strength_hint="), F.coalesce("hint", F.lit("None")))).otherwise(F.concat(F.lit("; domain="), F.coalesce("domain", F.lit("None"))))
    # Fixed value: the wording, which is a part of the decision's identifier.
    rationale = F.concat("candidate_type", F.lit(" grounded in span "), "span_id", last)
    made = passed.withColumn("entry_id", F.when(F.col("ledger_type") == "fact", fact).otherwise(preference)).withColumn("rationale", rationale)
    decision = content_id("memory_reducer_decision", decision_type=F.lit("promote"), target_candidate_ids=F.array("candidate_id"), target_ledger_entry_ids=F.array("entry_id"), evidence_span_ids=F.array("span_id"), rationale=F.col("rationale"))
    return made.withColumn("decision_id", decision)


def promote(judged: DataFrame, *, now: Column, first_source: Column | None = None) -> DataFrame:
    """(candidate_id, decision_id, entry_id, ledger_type, span_id) of what passes.

    Claims become facts, preferences and taste signals preferences; decisions and tasks aren't promoted.
    Identifiers are derived from content, so a rerun gives the same ones. The first cited span is carried over.
    """
    return _built(judged, now, F.lit("") if first_source is None else first_source).select("candidate_id", "decision_id", "entry_id", "ledger_type", "span_id")


def records(judged: DataFrame, *, now: Column, first_source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, entries) as whole records, one of each per candidate that passes, linked to each other.

    `first_source` stands in where a candidate names no source (default: an empty id).
    """
    built = _built(judged, now, F.lit("") if first_source is None else first_source)
    none, nobody = F.lit(None).cast("string"), F.array().cast("array<string>")
    by = F.struct(F.lit("reducer").alias("agent"), F.lit("deterministic").alias("model"), none.alias("tool"), none.alias("prompt_ref"))
    checks = F.create_map(*[F.lit(x) for check in _CHECKS for x in (check, "pass")])
    decisions = built.select(
        F.col("decision_id").alias("id"), F.lit("1.0.0").alias("schema_version"), F.lit("promote").alias("decision_type"), F.array("candidate_id").alias("target_candidate_ids"), F.array("entry_id").alias("target_ledger_entry_ids"),
        F.array("span_id").alias("evidence_span_ids"), "rationale", by.alias("decided_by"), F.col("at").alias("decided_at"), "confidence", "risk_class", checks.alias("checks"), F.lit("{}").alias("metadata"),
    )
    fact = F.col("ledger_type") == "fact"
    entries = built.select(
        F.col("entry_id").alias("id"), F.lit("1.0.0").alias("schema_version"), "ledger_type", F.lit("active").alias("status"), "confidence", "scope", F.array("source_id").alias("source_record_ids"), nobody.alias("episode_record_ids"),
        F.array("span_id").alias("evidence_span_ids"), F.array("candidate_id").alias("candidate_ids"), F.col("decision_id").alias("reducer_decision_id"), F.col("at").alias("observed_at"), F.col("at").alias("asserted_at"),
        F.col("at").alias("valid_from"), none.alias("valid_until"), none.alias("stale_after"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), nobody.alias("supersedes"), nobody.alias("superseded_by"), F.lit("{}").alias("metadata"),
        "subject", F.when(fact, F.col("predicate")).alias("predicate"), F.when(fact, F.col("object")).alias("object"), F.when(fact, F.col("fact_text")).alias("fact_text"), F.when(~fact, F.col("preference_text")).alias("preference_text"),
        F.when(~fact, F.col("domain")).alias("domain"), F.when(~fact, F.col("strength")).alias("strength"),
    )
    return decisions, entries
