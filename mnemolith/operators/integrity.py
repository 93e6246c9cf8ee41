"""Referential integrity between planes: every violation is a row, nothing is collected.

Arrays of references are exploded into (id, ref) rows and anti-joined; what a record declares about its
references is checked by one join each.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant
from ..functions.validity import is_active
from ..session import cut
from .migrate import upgraded

_PERIOD = ("status", "superseded_by", "valid_from", "valid_until", "stale_after")


def _row(rule: str, key: Column, ref: Column | None = None) -> list[Column]:
    return [F.lit(rule).alias("rule"), key.alias("record_id"), (F.lit(None).cast("string") if ref is None else ref).alias("ref_id")]


def references(records: DataFrame, field: str, *, key: str = "id") -> DataFrame:
    """Distinct (id, ref) of an array of references, or of a single one."""
    many = dict(records.dtypes)[field].startswith("array")
    ref = F.explode(field) if many else F.col(field)
    return records.select(F.col(key).alias("id"), ref.alias("ref")).where("ref is not null").distinct()


def duplicates(records: DataFrame, rule: str, *, key: str = "id") -> DataFrame:
    """Ids that occur more than once."""
    return records.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where("n > 1").select(*_row(rule, F.col("k")))


def dangling(records: DataFrame, field: str, targets: DataFrame, *, key: str = "id", target_key: str = "id") -> DataFrame:
    """References of `field` that aren't among the targets."""
    ids = targets.select(F.col(target_key).alias("ref"))
    return references(records, field, key=key).join(ids, "ref", "left_anti").select(*_row(f"dangling {field}", F.col("id"), F.col("ref")))


def not_within(records: DataFrame, inner: str, outer: str, *, key: str = "id") -> DataFrame:
    """Elements of `inner` that the same row's `outer` lacks."""
    rest = F.array_except(F.coalesce(inner, F.array().cast("array<string>")), F.coalesce(outer, F.array().cast("array<string>")))
    return records.select(F.col(key).alias("id"), F.explode(rest).alias("ref")).distinct().select(*_row(f"{inner} not within {outer}", F.col("id"), F.col("ref")))


def undeclared_span_origins(records: DataFrame, spans: DataFrame, *, key: str = "id") -> DataFrame:
    """Spans whose source or episode the citing record doesn't declare, though it declares some."""
    declared = lambda f: F.col(f) if f in records.columns else F.lit(None).cast("array<string>")
    cited = records.select(F.col(key).alias("id"), declared("source_record_ids").alias("sources"), declared("episode_record_ids").alias("episodes"), F.explode(F.array_distinct("evidence_span_ids")).alias("ref"))
    origin = spans.groupBy(F.col("id").alias("ref")).agg(F.max("source_id").alias("source_id"), F.max("episode_id").alias("episode_id"))
    joined = cited.join(origin, "ref")
    missing = lambda declared, one: (F.coalesce(F.array_size(declared), F.lit(0)) > 0) & one.isNotNull() & ~F.coalesce(F.array_contains(declared, one), F.lit(False))
    source = joined.where(missing(F.col("sources"), F.col("source_id"))).select(*_row("span source not declared", F.col("id"), F.col("ref")))
    episode = joined.where(missing(F.col("episodes"), F.col("episode_id"))).select(*_row("span episode not declared", F.col("id"), F.col("ref")))
    return source.unionByName(episode).distinct()


def supersession(entries: DataFrame, *, key: str = "id") -> DataFrame:
    """Links to replacements that dangle, that one side doesn't state, or whose periods are out of order."""
    rows = entries.select(F.col(key).alias("id"), "supersedes", "superseded_by", "valid_from", "valid_until")
    older = rows.select(F.explode("supersedes").alias("old"), F.col("id").alias("new")).where("old is not null").distinct().withColumn("by_new", F.lit(1))
    newer = rows.select(F.col("id").alias("old"), F.explode("superseded_by").alias("new")).where("new is not null").distinct().withColumn("by_old", F.lit(1))
    links = older.unionByName(newer, allowMissingColumns=True).groupBy("old", "new").agg(F.max("by_new").alias("by_new"), F.max("by_old").alias("by_old"))
    per_id = rows.groupBy("id").agg(F.max("valid_from").alias("valid_from"), F.max("valid_until").alias("valid_until"))
    full = (
        links.join(per_id.select(F.col("id").alias("old"), F.col("valid_until"), F.lit(True).alias("has_old")), "old", "left")
        .join(per_id.select(F.col("id").alias("new"), F.col("valid_from"), F.lit(True).alias("has_new")), "new", "left")
    )
    here = F.col("has_old") & F.col("has_new")
    problems = F.array(
        F.when(F.col("has_old").isNull() | F.col("has_new").isNull(), "dangling supersession"),
        F.when(here & (F.col("by_old").isNull() | F.col("by_new").isNull()), "supersession not reciprocal"),
        F.when(here & F.col("by_old").isNotNull() & F.col("valid_from").isNull(), "successor without valid_from"),
        F.when(here & F.col("by_old").isNotNull() & F.col("valid_until").isNull(), "superseded without valid_until"),
        F.when(here & F.col("by_old").isNotNull() & (instant(F.col("valid_until")) > instant(F.col("valid_from"))), "superseded ends after successor begins"),
    )
    return full.select("old", "new", F.explode(F.array_compact(problems)).alias("rule")).select("rule", F.col("old").alias("record_id"), F.col("new").alias("ref_id"))


def _list(field: str) -> Column:
    return F.coalesce(F.col(field), F.array().cast("array<string>"))


def authorised(records: DataFrame, decisions: DataFrame, *, target: str, within: Mapping[str, str], said: Mapping[str, str] | None = None, candidates: str | None = None, noun: str = "record", key: str = "id") -> DataFrame:
    """Records that their reducer decision (`reducer_decision_id`) doesn't cover.

    The decision must exist, name the record in its `target` list, and hold every element of the record's
    lists (`within`: list of the record to list of the decision; a list may be in several, joined by +). A
    record without `candidates` must be asserted by a human in its metadata. Missing columns are empty lists.
    """
    have = lambda df, f: _list(f) if f in df.columns else F.array().cast("array<string>")
    fields = sorted({target, *(f for fs in within.values() for f in fs.split("+"))})
    by_id = decisions.where("id is not null").groupBy(F.col("id").alias("reducer_decision_id")).agg(F.max(F.struct(*[have(decisions, f).alias(f) for f in fields])).alias("d"))
    there, name = F.col("d").isNotNull(), said or {}
    mine = [*within, *([candidates] if candidates else [])]
    human = F.coalesce(F.get_json_object("metadata", "$.human_asserted") == "true", F.lit(False)) if "metadata" in records.columns else F.lit(False)
    joined = records.select(F.col(key).alias("id"), "reducer_decision_id", *[have(records, f).alias(f) for f in dict.fromkeys(mine)], human.alias("human")).join(by_id, "reducer_decision_id", "left")
    problems = [F.when(~there, "dangling reducer_decision_id"), F.when(there & ~F.array_contains(f"d.{target}", F.col("id")), f"{noun} is no target of its decision")]
    for field, outer in within.items():
        known = F.concat(*[F.col(f"d.{f}") for f in outer.split("+")])
        problems.append(F.when(there & (F.size(F.array_except(field, known)) > 0), f"{name.get(field, field)} beyond the decision"))
    if candidates:
        problems.append(F.when((F.size(candidates) == 0) & ~F.col("human"), "neither candidates nor a human stand behind it"))
    return joined.select("id", "reducer_decision_id", F.explode(F.array_compact(F.array(*problems))).alias("rule")).select("rule", F.col("id").alias("record_id"), F.col("reducer_decision_id").alias("ref_id")).distinct()


def authorisation(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Entries that their reducer decision doesn't cover: not a target, or with candidates or evidence beyond it,
    or with neither candidates nor a human behind them."""
    return authorised(
        entries, decisions, target="target_ledger_entry_ids", within={"candidate_ids": "target_candidate_ids", "evidence_span_ids": "evidence_span_ids"},
        said={"candidate_ids": "candidates", "evidence_span_ids": "evidence"}, candidates="candidate_ids", noun="entry",
    )


def wrong_type(records: DataFrame, field: str, targets: DataFrame, type_field: str, wanted: str) -> DataFrame:
    """References of `field` to targets of another type than the wanted one."""
    typed = targets.groupBy(F.col("id").alias("ref")).agg(F.max(type_field).alias("type"))
    return references(records, field).join(typed, "ref").where(~F.col("type").eqNullSafe(wanted)).select(*_row(f"{field} not of type {wanted}", F.col("id"), F.col("ref")))


def inactive(records: DataFrame, field: str, targets: DataFrame, at: str) -> DataFrame:
    """References of `field` to targets that weren't active at the record's own time `at`.

    Of several rows of a target the last updated counts.
    """
    ref = F.explode(field) if dict(records.dtypes)[field].startswith("array") else F.col(field)
    asked = records.select("id", F.col(at).alias("at"), ref.alias("ref")).where("ref is not null").distinct()
    updated = F.col("updated_at") if "updated_at" in targets.columns else F.lit(None).cast("string")
    latest = targets.where("id is not null").groupBy(F.col("id").alias("ref")).agg(F.max(F.struct(updated.alias("updated_at"), *_PERIOD)).alias("e"))
    active = is_active(instant(F.col("at")), **{f: F.col(f"e.{f}") for f in _PERIOD})
    return asked.join(latest, "ref").where(~F.coalesce(active, F.lit(False))).select(*_row(f"{field} not active at {at}", F.col("id"), F.col("ref")))


def not_answered(decisions: DataFrame, field: str, records: DataFrame) -> DataFrame:
    """Targets of a decision that name another decision as theirs."""
    theirs = records.groupBy(F.col("id").alias("ref")).agg(F.max("reducer_decision_id").alias("by"))
    return references(decisions, field).join(theirs, "ref").where(~F.col("by").eqNullSafe(F.col("id"))).select(*_row(f"{field} answer to another decision", F.col("id"), F.col("ref")))


def candidate_bundle(sources: DataFrame, episodes: DataFrame | None, spans: DataFrame, candidates: DataFrame) -> DataFrame:
    """All violations of a candidate bundle."""
    parts = [duplicates(candidates, "duplicate candidate"), dangling(candidates, "source_record_ids", sources), dangling(candidates, "evidence_span_ids", spans), undeclared_span_origins(candidates, spans)]
    if episodes is not None:
        parts.append(dangling(candidates, "episode_record_ids", episodes))
    parts += [not_within(candidates, aux, "evidence_span_ids") for aux in ("counterevidence_span_ids", "example_span_ids", "contrast_span_ids") if aux in candidates.columns]
    return _all(parts)


def ledger_bundle(sources: DataFrame, spans: DataFrame, candidates: DataFrame, decisions: DataFrame, entries: DataFrame) -> DataFrame:
    """All violations of a ledger bundle; entries of an older version are brought up to date first."""
    entries = upgraded(entries)
    return _all(
        [
            duplicates(decisions, "duplicate decision"), duplicates(entries, "duplicate entry"), dangling(decisions, "target_candidate_ids", candidates), dangling(decisions, "target_ledger_entry_ids", entries),
            dangling(entries, "source_record_ids", sources), dangling(entries, "evidence_span_ids", spans), dangling(entries, "candidate_ids", candidates), undeclared_span_origins(entries, spans),
            authorisation(entries, decisions), supersession(entries),
        ]
    )


def taste_bundle(sources: DataFrame, spans: DataFrame, signals: DataFrame, decisions: DataFrame, cards: DataFrame, *, episodes: DataFrame | None = None) -> DataFrame:
    """All violations of a bundle of taste cards and the decisions that made them.

    `signals` are candidates of any type. The examples of a card, and both ends of its contrast pairs, must
    be among its evidence. Cards of an older version are brought up to date first.
    """
    cards = upgraded(cards)
    parts = [duplicates(decisions, "duplicate decision"), duplicates(cards, "duplicate card"), dangling(decisions, "target_taste_card_ids", cards), dangling(decisions, "target_taste_signal_ids", signals)]
    parts += [wrong_type(decisions, "target_taste_signal_ids", signals, "candidate_type", "taste_signal"), undeclared_span_origins(decisions, spans), dangling(decisions, "evidence_span_ids", spans)]
    parts += [dangling(cards, "source_record_ids", sources), dangling(cards, "evidence_span_ids", spans), dangling(cards, "candidate_taste_signal_ids", signals), wrong_type(cards, "candidate_taste_signal_ids", signals, "candidate_type", "taste_signal")]
    if episodes is not None:
        parts.append(dangling(cards, "episode_record_ids", episodes))
    parts += [not_within(cards, f, "evidence_span_ids") for f in ("positive_example_span_ids", "negative_example_span_ids") if f in cards.columns]
    if "contrast_pairs" in cards.columns:
        ends = F.flatten(F.transform("contrast_pairs", lambda p: F.array(p["preferred_span_id"], p["rejected_span_id"])))
        parts.append(not_within(cards.withColumn("contrast_pairs", ends), "contrast_pairs", "evidence_span_ids"))
    covered = {"candidate_taste_signal_ids": "target_taste_signal_ids", "evidence_span_ids": "evidence_span_ids", "supersedes": "target_taste_card_ids", "superseded_by": "target_taste_card_ids"}
    parts.append(authorised(cards, decisions, target="target_taste_card_ids", within=covered, candidates="candidate_taste_signal_ids", noun="card"))
    return _all([*parts, undeclared_span_origins(cards, spans), supersession(cards)])


def row_violations(planes: dict[str, DataFrame]) -> DataFrame:
    """(record_type, rule, id) over tables by record type: what the catalogue demands of each row."""
    from .rules import catalogue_rules, violations

    parts = [violations(rows, catalogue_rules(kind, rows)).select(F.lit(kind).alias("record_type"), "rule", "id") for kind, rows in planes.items()]
    return _all(parts)


#: Which trusted records a list of a state snapshot or of a pack's trusted memory names.
_LEDGER_LISTS = {"fact_ids": "fact", "preference_ids": "preference", "decision_ids": "decision"}


def state_bundle(
    states: DataFrame, *, group: str, trusted: DataFrame, sources: DataFrame | None = None, episodes: DataFrame | None = None, spans: DataFrame | None = None,
    candidates: DataFrame | None = None, cards: DataFrame | None = None, decisions: DataFrame | None = None, projects: DataFrame | None = None,
) -> DataFrame:
    """All violations of state snapshots of one kind: project states by project, core states by subject.

    References must exist, be of their list's type and, where snapshots have `as_of`, be active then;
    `projects` are the project states that core states name. Decisions must cover their snapshots, which
    must answer to them. Supersession links must agree, and periods of current snapshots of one group must
    not overlap. What isn't given isn't checked; snapshots and entries of an older version are brought up
    to date first.
    """
    from .temporal import overlaps

    states, trusted = upgraded(states), upgraded(trusted)
    has = lambda *fields: all(f in states.columns for f in fields)
    everything = trusted.select("id") if cards is None else trusted.select("id").unionByName(cards.select("id"))
    parts = [duplicates(states, "duplicate state")]
    dated = has("as_of") and set(_PERIOD) <= set(trusted.columns)
    for name, kind in _LEDGER_LISTS.items():
        if has(field := f"active_{name}"):
            parts.append(dangling(states, field, trusted))
            if "ledger_type" in trusted.columns:
                parts.append(wrong_type(states, field, trusted, "ledger_type", kind))
            if dated:
                parts.append(inactive(states, field, trusted, "as_of"))
    if has("active_taste_card_ids"):
        parts.append(dangling(states, "active_taste_card_ids", everything))
        if cards is not None and has("as_of"):
            parts.append(inactive(states, "active_taste_card_ids", upgraded(cards), "as_of"))
    for field, plane in (("source_record_ids", sources), ("episode_record_ids", episodes), ("evidence_span_ids", spans), ("candidate_task_ids", candidates), ("active_project_state_ids", projects)):
        if plane is not None and has(field):
            parts.append(dangling(states, field, plane))
    if spans is not None and has("evidence_span_ids"):
        parts.append(undeclared_span_origins(states, spans))
    if candidates is not None and has("candidate_task_ids"):
        parts.append(wrong_type(states, "candidate_task_ids", candidates, "candidate_type", "task"))
    if projects is not None and has("active_project_state_ids", "as_of"):
        parts.append(inactive(states, "active_project_state_ids", upgraded(projects), "as_of"))
    if decisions is not None:
        parts += _state_decisions(states, decisions, sources, episodes, spans, trusted, cards)
    if has("supersedes", "superseded_by"):
        parts.append(supersession(states))
    current = states
    if has("status", "superseded_by"):
        current = states.where((F.col("status") == "active") & (F.coalesce(F.array_size("superseded_by"), F.lit(0)) == 0))
    parts.append(overlaps(current, group=group).select(*_row("periods overlap", F.col("id"), F.col("overlaps_id"))))
    return _all(parts)


def _state_decisions(states: DataFrame, decisions: DataFrame, sources: DataFrame | None, episodes: DataFrame | None, spans: DataFrame | None, trusted: DataFrame, cards: DataFrame | None) -> list[DataFrame]:
    core = "active_project_state_ids" in states.columns
    target = "target_core_state_ids" if core else "target_project_state_ids"
    parts = [duplicates(decisions, "duplicate decision"), dangling(decisions, target, states), not_answered(decisions, target, states)]
    for field, plane in (("source_record_ids", sources), ("episode_record_ids", episodes), ("evidence_span_ids", spans), ("ledger_entry_ids", trusted), ("taste_card_ids", cards)):
        if plane is not None and field in decisions.columns:
            parts.append(dangling(decisions, field, plane))
    if spans is not None:
        parts.append(undeclared_span_origins(decisions, spans))
    covered = {"evidence_span_ids": "evidence_span_ids", **{f"active_{f}": "ledger_entry_ids" for f in _LEDGER_LISTS}, "active_taste_card_ids": "taste_card_ids", "supersedes": target, "superseded_by": target}
    parts.append(authorised(states, decisions, target=target, within={f: d for f, d in covered.items() if f in states.columns}, noun="snapshot"))
    return parts


def pack_bundle(packs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Duplicate packs, and cited entries that are missing or were not active when the pack was made.

    `packs`: (id, created_at, entry_ids); `trusted` has the fields of a ledger entry. For packs as whole
    documents see `pack_documents`.
    """
    cited = packs.select("id", "created_at", F.explode(F.array_distinct("entry_ids")).alias("ref")).distinct()
    latest = trusted.where("id is not null").groupBy(F.col("id").alias("ref")).agg(F.max(F.struct("updated_at", *_PERIOD)).alias("e"))
    joined = cited.join(latest, "ref", "left")
    active = is_active(instant(F.col("created_at")), **{f: F.col(f"e.{f}") for f in _PERIOD})
    lost = joined.where("e is null").select(*_row("dangling pack entry", F.col("id"), F.col("ref")))
    stale = joined.where(F.col("e").isNotNull() & ~F.coalesce(active, F.lit(False))).select(*_row("entry not active at created_at", F.col("id"), F.col("ref")))
    return _all([duplicates(packs.select("id", "created_at", "entry_ids").distinct(), "duplicate pack"), lost, stale])


# The type that the candidates of each list of a pack have, and the tasks that need taste cards.
_CANDIDATE_LISTS = {"candidate_task_ids": "task", "candidate_claim_ids": "claim", "candidate_preference_ids": "preference", "candidate_decision_ids": "decision", "candidate_taste_signal_ids": "taste_signal"}
_TASTE_TASKS = ("writing", "architecture_review", "review")
_LATE_STATUSES = ("stale", "superseded", "contested")


def _wanted(label: str, ids: Column, *, kind: str | None = None, wants: str | None = None) -> Column:
    """A list of references by name, the type its targets have, and whether they are active or late."""
    text = lambda x: F.lit(x).cast("string")
    return F.struct(F.lit(label).alias("label"), text(kind).alias("kind"), text(wants).alias("wants"), ids.alias("ids"))


def _looked_up(packs: DataFrame, lists: list[Column], targets: DataFrame, type_field: str | None = None) -> DataFrame:
    """What is wrong with references to one plane: all lists that name it go through one join.

    `packs` has id and created_at. Targets that don't exist, have another type, weren't active at the pack's
    time, or aren't late though they are listed so.
    """
    asked = packs.select("id", "created_at", F.explode(F.array(*lists)).alias("w")).select("id", "created_at", "w.label", "w.kind", "w.wants", F.explode("w.ids").alias("ref")).where("ref is not null").distinct()
    period = [f for f in ("updated_at", *_PERIOD) if f in targets.columns]
    facts = [F.col(f) for f in period] + ([F.col(type_field).alias("type")] if type_field else [])
    latest = targets.where("id is not null").groupBy(F.col("id").alias("ref")).agg(F.max(F.struct(*facts, F.lit(True).alias("there"))).alias("e"))
    joined = asked.join(latest, "ref", "left")
    there, label = F.col("e").isNotNull(), F.col("label")
    problems = [F.when(~there, F.concat(F.lit("dangling "), label))]
    if type_field:
        problems.append(F.when(there & F.col("kind").isNotNull() & ~F.col("e.type").eqNullSafe(F.col("kind")), F.concat(label, F.lit(" not of type "), F.col("kind"))))
    if set(_PERIOD) <= set(period):
        active = F.coalesce(is_active(instant(F.col("created_at")), **{f: F.col(f"e.{f}") for f in _PERIOD}), F.lit(False))
        problems.append(F.when(there & (F.col("wants") == "active") & ~active, F.concat(label, F.lit(" not active at created_at"))))
        late = F.coalesce(F.col("e.status").isin(*_LATE_STATUSES), F.lit(False))
        problems.append(F.when(there & (F.col("wants") == "late") & ~late, F.concat(label, F.lit(" neither stale, superseded nor contested"))))
    return joined.select("id", "ref", F.explode(F.array_compact(F.array(*problems))).alias("rule")).select("rule", F.col("id").alias("record_id"), F.col("ref").alias("ref_id"))


def _within_row(rows: DataFrame, rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Per rule, the elements of the first list that the second one of the same row lacks."""
    lost = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.array_except(inner, outer).alias("refs")) for rule, (inner, outer) in rules.items()]))
    return rows.select("id", lost.alias("l")).select("id", "l.rule", F.explode("l.refs").alias("ref")).select("rule", F.col("id").alias("record_id"), F.col("ref").alias("ref_id"))


def pack_documents(planes: Mapping[str, DataFrame]) -> DataFrame:
    """All violations of context packs as whole documents, with their receipts and reports.

    `planes`: source_records, episode_records, evidence_spans, candidates, ledger_entries, taste_cards,
    project_states, core_states, packs, receipts, reports, each with the columns of its schema. Every plane
    is joined once, with all the lists that name it.
    """
    p = dict(planes)
    for name in ("packs", "receipts", "reports"):
        p[name] = cut(p[name])
    packs = p["packs"].withColumn("created_at", F.col("authority.created_at"))
    t, s, c, e = (lambda f, n=n: _list(f"{n}.{f}") for n in ("trusted_memory", "stale_or_superseded", "candidate_context", "evidence"))
    core, projects = F.array_compact(F.array("state.core_state_id")), _list("state.project_state_ids")
    ledger = [_wanted(f, t(f), kind=k, wants="active") for f, k in _LEDGER_LISTS.items()] + [_wanted(f"late {f}", s(f), wants="late") for f in _LEDGER_LISTS]
    late = lambda f: _wanted(f"late {f}", s(f), wants="late")
    entries, cards, projects_, cores = (upgraded(p[n]) for n in ("ledger_entries", "taste_cards", "project_states", "core_states"))
    parts = [duplicates(p[n], f"duplicate in {n}") for n in sorted(p)]
    parts += [
        _looked_up(packs, [_wanted("source_record_ids", e("source_record_ids"))], p["source_records"].select("id")),
        _looked_up(packs, [_wanted("episode_record_ids", e("episode_record_ids"))], p["episode_records"].select("id")),
        _looked_up(packs, [_wanted(f, e(f)) for f in ("evidence_span_ids", "primary_evidence_span_ids")], p["evidence_spans"].select("id")),
        _looked_up(packs, [_wanted(f, c(f), kind=k) for f, k in _CANDIDATE_LISTS.items()], p["candidates"], "candidate_type"),
        _looked_up(packs, ledger, entries, "ledger_type"),
        _looked_up(packs, [_wanted("taste_card_ids", t("taste_card_ids"), wants="active"), late("taste_card_ids")], cards),
        _looked_up(packs, [_wanted("project_state_ids", projects, wants="active"), late("project_state_ids")], projects_),
        _looked_up(packs, [_wanted("core_state_id", core, wants="active"), late("core_state_ids")], cores),
    ]
    # The sources and episodes of its evidence are declared by the pack.
    spans = p["evidence_spans"].groupBy(F.col("id").alias("ref")).agg(F.max("source_id").alias("source_id"), F.max("episode_id").alias("episode_id"))
    cited = packs.select("id", e("source_record_ids").alias("sources"), e("episode_record_ids").alias("episodes"), F.explode(F.array_union(e("evidence_span_ids"), e("primary_evidence_span_ids"))).alias("ref")).join(spans, "ref")
    undeclared = [F.when(F.col(one).isNotNull() & ~F.array_contains(many, F.col(one)), f"{one} of a span not declared") for one, many in (("source_id", "sources"), ("episode_id", "episodes"))]
    parts.append(cited.select("id", "ref", F.explode(F.array_compact(F.array(*undeclared))).alias("rule")).select("rule", F.col("id").alias("record_id"), F.col("ref").alias("ref_id")).distinct())
    # What a pack is made of must be in its trace.
    material = F.array_distinct(F.concat(*[x(f) for f in (*_LEDGER_LISTS, "taste_card_ids") for x in (t, s)], s("project_state_ids"), s("core_state_ids"), *[c(f) for f in _CANDIDATE_LISTS], e("evidence_span_ids"), e("primary_evidence_span_ids"), core, projects))
    parts.append(_within_row(packs, {"not in the trace": (material, _list("retrieval_trace.included_ids")), "primary_evidence_span_ids not within evidence_span_ids": (e("primary_evidence_span_ids"), e("evidence_span_ids"))}))
    wants_taste = packs.where(F.col("task.task_type").isin(*_TASTE_TASKS) & (F.size(t("taste_card_ids")) == 0))
    parts.append(wants_taste.select(*_row("task without taste cards", F.col("id"))))
    # The status of each late record, for what receipts say about them.
    status = _all([plane.select(F.col("id").alias("ref"), "status") for plane in (entries, cards, projects_, cores)]).groupBy("ref").agg(F.max("status").alias("status"))
    named = packs.select("id", F.explode(F.concat(*[s(f) for f in (*_LEDGER_LISTS, "taste_card_ids", "project_state_ids", "core_state_ids")])).alias("ref"))
    held = named.join(status, "ref").groupBy("id").agg(F.max((F.col("status") == "contested").cast("int")).alias("contested"))
    return _all([*parts, *_receipts(p["packs"], p["receipts"], held), *_reports(p["packs"], p["reports"])])


def _receipts(packs: DataFrame, receipts: DataFrame, late: DataFrame) -> list[DataFrame]:
    """Receipts belong to packs, cover them, and say whether stale and contested records are in."""
    t, s, c = (lambda f, n=n: _list(f"{n}.{f}") for n in ("trusted_memory", "stale_or_superseded", "candidate_context"))
    of = receipts.select(F.col("id").alias("receipt"), F.col("context_pack_id").alias("id"), "input_refs", "selection_policy")
    parts = [dangling(receipts, "context_pack_id", packs), packs.select("id").join(of.select("id"), "id", "left_anti").select(*_row("pack without receipt", F.col("id"))).distinct()]
    both = of.join(packs, "id").join(late, "id", "left")
    covered = {
        "core_state_ids": F.array_compact(F.array("state.core_state_id")), "project_state_ids": _list("state.project_state_ids"), "ledger_entry_ids": F.concat(*[x(f) for f in _LEDGER_LISTS for x in (t, s)]),
        "taste_card_ids": F.concat(t("taste_card_ids"), s("taste_card_ids")), "candidate_ids": F.concat(*[c(f) for f in _CANDIDATE_LISTS]), "evidence_span_ids": _list("evidence.evidence_span_ids"),
    }
    parts.append(_within_row(both.withColumn("id", F.col("receipt")), {f"receipt lacks {f}": (inner, _list(f"input_refs.{f}")) for f, inner in covered.items()}))
    denies = lambda f: ~F.coalesce(F.col(f"selection_policy.{f}").cast("boolean"), F.lit(False))
    said = [
        F.when(~F.col("selection_policy.current_cutoff").eqNullSafe(F.col("authority.created_at")), "cut-off differs from the pack's time"),
        F.when(F.col("contested").isNotNull() & denies("include_stale"), "receipt denies stale records"), F.when((F.col("contested") == 1) & denies("include_contested"), "receipt denies contested records"),
    ]
    parts.append(both.select("receipt", "id", F.explode(F.array_compact(F.array(*said))).alias("rule")).select("rule", F.col("receipt").alias("record_id"), F.col("id").alias("ref_id")))
    return parts


def _reports(packs: DataFrame, reports: DataFrame) -> list[DataFrame]:
    """Reports belong to packs, every pack has one that passes, and their results agree with their checks."""
    passing = reports.where("status = 'pass'")
    failing = F.exists(F.map_values("checks"), lambda v: ~F.coalesce(v.isin("pass", "not_applicable"), F.lit(False)))
    errors = F.coalesce(F.array_size("errors"), F.lit(0))
    return [
        dangling(reports, "context_pack_id", packs),
        packs.select("id").join(passing.select(F.col("context_pack_id").alias("id")), "id", "left_anti").select(*_row("pack without passing report", F.col("id"))).distinct(),
        passing.where(F.coalesce(failing, F.lit(False)) | (errors > 0)).select(*_row("passing report has failures", F.col("id"))),
        reports.where((~F.col("status").eqNullSafe("pass")) & (errors == 0)).select(*_row("failing report has no errors", F.col("id"))),
    ]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
