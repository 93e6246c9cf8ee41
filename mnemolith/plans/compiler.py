"""Context packs compiled from a bundle: filter, score, rank, cap.

One DataFrame gains an `excluded` reason step by step, the first reason counting; only source coverage and
in-degrees need joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.access import Scope, access_decision
from ..functions.canonical import content_id
from ..functions.decay import DecayPolicy, decay_score
from ..functions.instants import instant
from ..operators.blocks import numbered
from ..operators.citations import Graph, in_degree, supported
from ..schemas import ENUMS

STRATEGIES = ("recent", "diverse", "frequent", "fresh")


@dataclass(frozen=True)
class Policy:
    """How many records (0: all), by which strategy, whether a source must back each, which statuses are out."""

    max_records: int = 50
    strategy: str = "recent"
    require_source_coverage: bool = True
    excluded_statuses: tuple[str, ...] = ("stale", "retracted", "contested")

    def __post_init__(self) -> None:
        if self.max_records < 0:
            raise ValueError("max_records must not be negative")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy!r}")


def score(columns: list[str]) -> Column:
    """Seconds of the first time that can be read, and up to two more for confidence."""
    times = [instant(F.col(c)) for c in ("asserted_at", "valid_from", "created_at", "observed_at") if c in columns]
    seconds = F.coalesce(*[F.unix_micros(t) / 1e6 for t in times], F.lit(0.0))
    grades = len(ENUMS["confidence"])
    place = F.array_position(F.array(*map(F.lit, ENUMS["confidence"])), F.col("confidence"))
    return seconds + F.when(place > 0, 2.0 * place / grades).otherwise(0.0)


def select_records(records: DataFrame, g: Graph | None, scope: Scope, policy: Policy, *, as_of: Column | None = None) -> DataFrame:
    """Every record once, with `excluded` (a reason, or null), `score` and `rank` (null if excluded).

    `records`: (pos, id, schema_version, record_type, status, confidence, privacy_class and times). The first
    row of an id counts, others are `duplicate_id`. Rank ties are broken by id. Strategies: recent by score;
    diverse takes the best of each type in turn; frequent by citations; fresh by decay at `as_of`.
    """
    first = records.groupBy("id").agg(F.min("pos").alias("first_pos"))
    decision = access_decision(F.col("privacy_class"), F.col("record_type"), scope)
    rows = records.join(first, "id").withColumn("score", score(records.columns))
    rows = rows.withColumn(
        "excluded",
        F.when(F.col("pos") > F.col("first_pos"), "duplicate_id")
        .when(decision["action"] != "allow", "outside_scope")
        .when((F.coalesce("id", F.lit("")) == "") | F.col("schema_version").isNull(), "schema_invalid")
        .when(F.col("status").isin(*policy.excluded_statuses), F.concat(F.lit("status_"), F.col("status"))),
    )
    if policy.require_source_coverage and g is not None:
        backed = supported(g).unionByName(g.nodes.where("kind = 'source'").select("id")).distinct().withColumn("backed", F.lit(True))
        rows = rows.join(backed, "id", "left").withColumn("excluded", F.coalesce("excluded", F.when(F.col("backed").isNull(), "no_source_backing"))).drop("backed")
    kept, out = rows.where("excluded is null"), rows.where("excluded is not null")
    if policy.strategy == "diverse":
        kept = _turns(kept, policy.max_records)
        order = [F.asc("turn"), F.asc("record_type")]
    elif policy.strategy == "frequent" and g is not None:
        kept = kept.join(in_degree(g), "id", "left").withColumn("turn", -F.coalesce("in_degree", F.lit(0))).drop("in_degree")
        order = [F.asc("turn"), F.desc("score"), F.asc("id")]
    elif policy.strategy == "fresh" and as_of is not None:
        kept = kept.withColumn("turn", -decay_score(F.col("asserted_at"), as_of, F.col("supersedes"), F.col("evidence_span_ids"), DecayPolicy())["score"])
        order = [F.asc("turn"), F.asc("id")]
    else:
        kept = kept.withColumn("turn", F.lit(0))
        order = [F.desc("score"), F.asc("id")]
    columns = ["id", "record_type", "score", "excluded"]
    if policy.max_records:
        top = kept.where("turn is not null").orderBy(*order).limit(policy.max_records)  # a top-k: no global sort
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        over = kept.join(ranked.select("id"), "id", "left_anti").select("id", "record_type", "score", F.lit("exceeded_max_records").alias("excluded"), F.lit(None).cast("int").alias("rank"))
        ranked = ranked.select(*columns, "rank").unionByName(over)
    else:
        ranked = numbered(kept, order, "rank").select(*columns, "rank")
    return ranked.unionByName(out.select(*columns, F.lit(None).cast("int").alias("rank")))


def _turns(kept: DataFrame, most: int) -> DataFrame:
    """`kept` with `turn`, each record's place within its type; null beyond `most` (0: no limit).

    With a limit, the rank filter becomes a limit per task before the shuffle. Without one, a type with most
    of the rows would be one task, so all records are numbered in one range sort by type and the numbers of
    each type are shifted to begin at 1.
    """
    best = [F.desc("score"), F.asc("id")]
    if most:
        first = kept.select("id", "record_type", "score").withColumn("turn", F.row_number().over(Window.partitionBy("record_type").orderBy(*best))).where(F.col("turn") <= most)
        return kept.join(first.select("id", "turn"), "id", "left")
    placed = numbered(kept, [F.asc("record_type"), *best], "place")
    starts = placed.groupBy("record_type").agg(F.min("place").alias("start"))
    return placed.join(starts, placed["record_type"].eqNullSafe(starts["record_type"])).drop(starts["record_type"]).withColumn("turn", F.col("place") - F.col("start") + 1).drop("place", "start")


def exclusions(selected: DataFrame) -> DataFrame:
    """(reason, records)."""
    return selected.where("excluded is not null").groupBy(F.col("excluded").alias("reason")).agg(F.count("*").alias("records"))


def primary_evidence(spans: DataFrame, selected: DataFrame, cites: DataFrame, *, most: int = 5) -> DataFrame:
    """The latest spans that selected records cite: (id, created_at), at most `most`, ties by id."""
    chosen = selected.where("rank is not null").select(F.col("id").alias("from_id"))
    cited = cites.join(chosen, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    latest = spans.groupBy("id").agg(F.max("created_at").alias("created_at")).join(cited, "id", "left_semi")
    return latest.orderBy(F.desc_nulls_last(instant(F.col("created_at"))), "id").limit(most)


def pack(selected: DataFrame, *, task_id: str, pack_type: str, created_at: str) -> DataFrame:
    """One row: the pack's id, its sections by record type, and what was left out, by reason.

    Holds at most the policy's `max_records` ids; exclusions are counted, not listed.
    """
    kept = selected.where("rank is not null").groupBy("record_type").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("ids"))
    sections = kept.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("record_type", F.col("ids.id"))))).alias("sections"))
    left_out = exclusions(selected).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "records")))).alias("excluded"))
    both = sections.unionByName(left_out, allowMissingColumns=True).agg(F.any_value("sections", F.lit(True)).alias("sections"), F.any_value("excluded", F.lit(True)).alias("excluded"))
    inputs = F.array_sort(F.flatten(F.map_values("sections")))
    key = content_id("context_pack", pack_type=F.lit(pack_type), task_id=F.lit(task_id), created_at=F.lit(created_at), record_ids=inputs)
    return both.select(key.alias("id"), F.lit(pack_type).alias("pack_type"), F.lit(task_id).alias("task_id"), F.lit(created_at).alias("created_at"), "sections", "excluded", F.sha2(F.to_json(inputs), 256).alias("build_inputs_hash"))


# What a pack forbids, what it allows, its budget and the checks of its report.
FORBIDDEN, ALLOWED, TOKEN_BUDGET = ("deploy", "delete", "mutate_trusted_memory", "publish", "run_workers", "send", "write_gbrain"), ("read",), 8000
CHECKS = (
    "evidence_present", "primary_evidence_present", "current_memory_active", "stale_memory_separated", "taste_present_for_taste_sensitive_task", "state_present", "permission_policy_present",
    "forbidden_actions_enforced", "no_worker_runtime_fields", "no_gbrain_write_authority", "receipt_consistent",
)
# The list of a pack that records of a type go to.
_SECTIONS = {
    "fact": "fact_ids", "preference": "preference_ids", "decision": "decision_ids", "taste_card": "taste_card_ids", "candidate_task": "candidate_task_ids", "candidate_claim": "candidate_claim_ids",
    "candidate_preference": "candidate_preference_ids", "candidate_decision": "candidate_decision_ids", "candidate_taste_signal": "candidate_taste_signal_ids", "evidence_span": "evidence_span_ids",
    "source_record": "source_record_ids", "episode_record": "episode_record_ids",
}
_TRUSTED = ("fact_ids", "preference_ids", "decision_ids", "taste_card_ids")
_CANDIDATES = tuple(f"candidate_{k}_ids" for k in ("task", "claim", "preference", "decision", "taste_signal"))


def _object(members: Mapping[str, object]) -> Column:
    """A struct with sorted members, as canonical JSON has them; plain values become literals, lists arrays."""

    def one(value: object) -> Column:
        if isinstance(value, Column):
            return value
        if isinstance(value, Mapping):
            return _object(value)
        if isinstance(value, (list, tuple)):
            return F.array(*map(F.lit, value)).cast("array<string>")
        return F.lit(value) if value is not None else F.lit(None).cast("string")

    return F.named_struct(*[x for k in sorted(members) for x in (F.lit(k), one(members[k]))])


def document(selected: DataFrame, g: Graph, spans: DataFrame, *, task: Mapping[str, str | None], state: Mapping[str, object], created_at: str, policy: Policy | None = None, created_by: str = "compiler") -> DataFrame:
    """One row: the context pack as a whole record, all its lists sorted.

    `task`: task_id, task_title, task_type, task_summary, project_id, risk_class, sensitivity; `state` as from
    `tools.state_reference`; `spans`: (id, source_id, episode_id, created_at). Evidence is every span that the
    selected records cite, its sources and episodes are declared, and the latest are primary. Without any
    evidence a policy that demands source coverage fails. What was left out is counted by `exclusions` and
    listed by `left_out`, not in the record, as it may be most of the bundle.
    """
    policy = policy or Policy()
    kind = F.regexp_replace("record_type", "_ledger_entry$", "")
    slot = F.create_map(*[F.lit(x) for pair in _SECTIONS.items() for x in pair])[kind]
    kept = selected.where("rank is not null")
    cites = g.edges.where("relation = 'cites'")
    cited = cites.join(kept.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).unionByName(kept.where(kind == "evidence_span").select("id")).distinct()
    places = spans.join(cited, "id", "left_semi").select("id", "source_id", "episode_id")
    primary = primary_evidence(spans, selected, cites)
    parts = [
        kept.select(slot.alias("slot"), "id"), places.select(F.lit("evidence_span_ids").alias("slot"), "id"), primary.select(F.lit("primary").alias("slot"), "id"),
        places.select(F.lit("source_record_ids").alias("slot"), F.col("source_id").alias("id")), places.select(F.lit("episode_record_ids").alias("slot"), F.col("episode_id").alias("id")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # No more ids than the policy's records and what they cite.
    names = [*_TRUSTED, *_CANDIDATES, "source_record_ids", "episode_record_ids", "evidence_span_ids", "primary"]
    lists = rows.where("id is not null").agg(*[F.array_sort(F.collect_set(F.when(F.col("slot") == n, F.col("id")))).alias(n) for n in names])
    c = F.col
    spans_, first = c("evidence_span_ids"), F.when(F.size("primary") > 0, c("primary")).otherwise(F.slice("evidence_span_ids", 1, 5))
    if policy.require_source_coverage:
        first = F.when(F.size(first) > 0, first).otherwise(F.raise_error(F.lit("a pack needs evidence")).cast("array<string>"))
    none = F.array().cast("array<string>")
    nothing = F.array().cast("array<struct<kind:string,related_ids:array<string>,summary:string>>")
    core, projects = state.get("core_state_id"), list(state.get("project_state_ids") or ())  # type: ignore[call-overload]
    known = F.array(*[F.lit(x) for x in [core, *projects] if x]).cast("array<string>")
    included = F.array_sort(F.array_distinct(F.concat(*[c(n) for n in (*_TRUSTED, *_CANDIDATES)], spans_, c("source_record_ids"), c("episode_record_ids"), known)))
    inputs = F.sha2(F.to_json(included), 256)
    body = {
        "task": _object(task), "state": _object({"core_state_id": core, "project_state_ids": projects}), "trusted_memory": _object({n: c(n) for n in _TRUSTED}), "candidate_context": _object({n: c(n) for n in _CANDIDATES}),
        "evidence": _object({"source_record_ids": c("source_record_ids"), "episode_record_ids": c("episode_record_ids"), "evidence_span_ids": spans_, "primary_evidence_span_ids": first}),
        "stale_or_superseded": _object({**dict.fromkeys(_TRUSTED, none), "project_state_ids": none, "core_state_ids": none}), "conflicts_and_uncertainties": nothing,
        "constraints": _object({"permission_policy_id": "default", "allowed_actions": ALLOWED, "forbidden_actions": FORBIDDEN, "privacy_notes": [f"compiled for {task.get('sensitivity')}"], "token_budget": TOKEN_BUDGET}),
    }
    identity = _object({**body, "retrieval_trace": _object({"build_inputs_hash": inputs})})
    made = lists.select(*[v.alias(k) for k, v in body.items()], included.alias("included"), inputs.alias("inputs"), identity.alias("identity"), F.to_json(identity, {"ignoreNullFields": "false"}).alias("text"))
    key = content_id("context_pack", task_id=F.lit(task.get("task_id")), evidence_span_ids=c("evidence.evidence_span_ids"), normalized_payload=c("identity"))
    authority = _object({"created_by": created_by, "created_at": created_at, "source": "compiler", "schema_pack_version": "1.0.0", "kernel_commit": None})
    trace = _object({"queries": [task.get("task_title")], "included_ids": c("included"), "excluded": F.array().cast("array<struct<id:string,reason:string>>"), "build_inputs_hash": c("inputs")})
    return made.select(key.alias("id"), F.lit("1.0.0").alias("schema_version"), F.lit("context_pack").alias("pack_type"), "task", authority.alias("authority"), *[k for k in body if k != "task"], trace.alias("retrieval_trace"), F.sha2("text", 256).alias("pack_hash_sha256"), F.lit("{}").alias("metadata"))


def left_out(selected: DataFrame) -> DataFrame:
    """(id, reason) of every record that a pack leaves out."""
    return selected.where("excluded is not null").select("id", F.col("excluded").alias("reason"))


def document_receipt(packs: DataFrame, *, policy: Policy | None = None, agent: str = "compiler", mode: str = "deterministic") -> DataFrame:
    """The build receipts of whole packs: what is in them, and by which policy."""
    policy = policy or Policy()
    c = F.col
    refs = _object({
        "core_state_ids": F.array_compact(F.array("state.core_state_id")), "project_state_ids": c("state.project_state_ids"), "ledger_entry_ids": F.array_sort(F.concat(*[c(f"trusted_memory.{n}") for n in _TRUSTED[:3]])),
        "taste_card_ids": c("trusted_memory.taste_card_ids"), "candidate_ids": F.array_sort(F.concat(*[c(f"candidate_context.{n}") for n in _CANDIDATES])), "evidence_span_ids": c("evidence.evidence_span_ids"),
    })
    said = _object({"current_cutoff": c("authority.created_at"), "include_stale": "stale" not in policy.excluded_statuses, "include_contested": "contested" not in policy.excluded_statuses, "include_candidates": True, "token_budget": TOKEN_BUDGET})
    rows = packs.select(c("id").alias("context_pack_id"), c("authority.created_at").alias("created_at"), refs.alias("input_refs"), said.alias("selection_policy"))
    key = content_id("context_pack_build_receipt", context_pack_id=c("context_pack_id"), input_refs=c("input_refs"), selection_policy=c("selection_policy"))
    builder = _object({"agent": agent, "model": None, "tool": None, "mode": mode})
    return rows.select(key.alias("id"), F.lit("1.0.0").alias("schema_version"), "context_pack_id", "created_at", builder.alias("builder"), "input_refs", "selection_policy", F.array().cast("array<struct<id:string,reason:string>>").alias("excluded"), F.array().cast("array<string>").alias("warnings"), F.lit("{}").alias("metadata"))


def document_report(packs: DataFrame, violations: DataFrame | None = None, *, agent: str = "validator", tool: str = "rules", version: str = "1") -> DataFrame:
    """The validation reports of whole packs; `violations` (rule, record_id, ref_id) of a pack make it fail.

    At most one error per rule is in a report, with the number of its references; the rows themselves are `violations`.
    """
    c = F.col
    errors = "array<struct<code:string,message:string,related_ids:array<string>>>"
    rows = packs.select(c("id").alias("context_pack_id"), c("authority.created_at").alias("validated_at"), (F.size("evidence.evidence_span_ids") > 0).alias("spans"), (F.size("trusted_memory.taste_card_ids") > 0).alias("tastes"))
    if violations is None:
        rows = rows.withColumn("errors", F.array().cast(errors))
    else:
        per_rule = violations.groupBy(c("record_id").alias("context_pack_id"), "rule").agg(F.count("*").alias("n"), F.min("ref_id").alias("first"))
        found = per_rule.groupBy("context_pack_id").agg(F.array_sort(F.collect_list(F.struct(c("rule").alias("code"), F.concat(c("n").cast("string"), F.lit(" times")).alias("message"), F.array_compact(F.array("first")).alias("related_ids")))).alias("errors"))
        rows = rows.join(found, "context_pack_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast(errors)))
    wrong = F.size("errors") > 0
    state = {k: F.when(wrong, "fail").otherwise("pass") if k == "receipt_consistent" else F.lit("pass") for k in CHECKS}
    state |= dict.fromkeys(("evidence_present", "primary_evidence_present"), F.when(c("spans"), "pass").otherwise("not_applicable"))
    state["taste_present_for_taste_sensitive_task"] = F.when(c("tastes"), "pass").otherwise("not_applicable")
    checks = F.create_map(*[x for k in sorted(CHECKS) for x in (F.lit(k), state[k])])
    rows = rows.select("context_pack_id", "validated_at", F.when(wrong, "fail").otherwise("pass").alias("status"), checks.alias("checks"), "errors")
    key = content_id("context_pack_validation_report", **{n: c(n) for n in ("context_pack_id", "validated_at", "status", "checks", "errors")})
    return rows.select(key.alias("id"), F.lit("1.0.0").alias("schema_version"), "context_pack_id", "validated_at", _object({"agent": agent, "tool": tool, "version": version}).alias("validator"), "status", "checks", "errors", F.array().cast("array<string>").alias("warnings"), F.lit("{}").alias("metadata"))


def receipt(packed: DataFrame) -> DataFrame:
    """The build receipt of a pack."""
    key = content_id("context_pack_build_receipt", context_pack_id=F.col("id"), build_inputs_hash=F.col("build_inputs_hash"))
    return packed.select(key.alias("id"), F.col("id").alias("context_pack_id"), "created_at", "build_inputs_hash", F.array_sort(F.flatten(F.map_values("sections"))).alias("included_ids"), F.col("created_at").alias("current_cutoff"))
