"""Validators of whole bundles: sound ones break no rule, and each planted fault breaks its own."""

from __future__ import annotations

import functools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolith import schemas
from mnemolith.functions import access
from mnemolith.operators import citations, conflicts, hygiene, integrity, records, reducer, taste
from mnemolith.plans import compiler
from mnemolith.streaming import sessions
from tests.helpers import rows

DAY = "2025-01-01T00:00:00Z"


def empty(kind):
    return [] if isinstance(kind, T.ArrayType) else {} if isinstance(kind, T.MapType) else {f.name: empty(f.dataType) for f in kind.fields} if isinstance(kind, T.StructType) else None


def table(spark, name, *records):
    schema = schemas.struct_type(name)
    return spark.createDataFrame([{f.name: empty(f.dataType) for f in schema.fields} | r for r in records], schema)


def entry(key, kind="fact", **more):
    return {"id": key, "schema_version": "1.0.0", "ledger_type": kind, "status": "active", "valid_from": "2024-01-01T00:00:00Z", "updated_at": DAY} | more


def card(key, **more):
    return {"id": key, "schema_version": "1.0.0", "status": "active", "valid_from": "2024-01-01T00:00:00Z", "source_record_ids": ["src_1"], "evidence_span_ids": ["span_1", "span_2"], "positive_example_span_ids": ["span_1"],
            "contrast_pairs": [{"preferred_span_id": "span_1", "rejected_span_id": "span_2", "reason": "r"}], "candidate_taste_signal_ids": ["cand_taste_1"], "reducer_decision_id": "redtaste_1"} | more


def broken(found):
    return sorted({r.rule for r in found.select("rule").collect()})


def evidence(spark):
    sources, episodes = table(spark, "source_record", {"id": "src_1"}), table(spark, "episode_record", {"id": "ep_1"})
    spans = table(spark, "evidence_span", {"id": "span_1", "source_id": "src_1", "episode_id": "ep_1"}, {"id": "span_2", "source_id": "src_1"})
    return sources, episodes, spans


TASTE_FAULTS = [
    ({}, []),
    ({"source_record_ids": ["src_9"]}, ["dangling source_record_ids", "span source not declared"]),
    ({"episode_record_ids": ["ep_9"]}, ["dangling episode_record_ids", "span episode not declared"]),
    ({"evidence_span_ids": ["span_1"]}, ["contrast_pairs not within evidence_span_ids"]),
    ({"negative_example_span_ids": ["span_7"]}, ["negative_example_span_ids not within evidence_span_ids"]),
    ({"evidence_span_ids": ["span_1", "span_2", "span_9"]}, ["dangling evidence_span_ids", "evidence_span_ids beyond the decision"]),
    ({"candidate_taste_signal_ids": ["cand_claim_1"]}, ["candidate_taste_signal_ids beyond the decision", "candidate_taste_signal_ids not of type taste_signal"]),
    ({"candidate_taste_signal_ids": []}, ["neither candidates nor a human stand behind it"]),
    ({"candidate_taste_signal_ids": [], "metadata": '{"human_asserted": true}'}, []),
    ({"reducer_decision_id": "redtaste_9"}, ["dangling reducer_decision_id"]),
    ({"id": "taste_90"}, ["card is no target of its decision"]),
    ({"superseded_by": ["taste_none"]}, ["dangling supersession", "superseded_by beyond the decision"]),
]


def outcome(found, prefix):
    """Rules by the number in the record's id."""
    out = {}
    for r in found.collect():
        out.setdefault(r.record_id, set()).add(r.rule)
    return {k: sorted(v) for k, v in out.items() if k.startswith(prefix)}


def test_taste_bundle(spark):
    sources, episodes, spans = evidence(spark)
    signals = spark.createDataFrame([("cand_taste_1", "taste_signal"), ("cand_claim_1", "claim")], "id string, candidate_type string")
    cards = [card(f"taste_{i}") | change for i, (change, _) in enumerate(TASTE_FAULTS)]
    targets = [f"taste_{i}" for i in range(len(cards)) if cards[i]["id"] == f"taste_{i}"]
    decisions = table(spark, "taste_reducer_decision", {"id": "redtaste_1", "target_taste_signal_ids": ["cand_taste_1"], "target_taste_card_ids": [*targets, "taste_x"], "evidence_span_ids": ["span_1", "span_2"]})
    found = integrity.taste_bundle(sources, spans, signals, decisions, table(spark, "taste_card", *cards), episodes=episodes)
    want = {cards[i]["id"]: sorted(rules) for i, (_, rules) in enumerate(TASTE_FAULTS) if rules}
    assert outcome(found, "taste_") == want
    assert outcome(found, "redtaste_") == {"redtaste_1": ["dangling target_taste_card_ids"]}


def project(key, **more):
    return {"id": key, "schema_version": "1.0.0", "state_type": "project_state", "status": "active", "as_of": DAY, "project_id": "p", "valid_from": "2024-06-01T00:00:00Z", "active_fact_ids": ["fact_1"], "active_taste_card_ids": ["taste_1"],
            "source_record_ids": ["src_1"], "evidence_span_ids": ["span_2"], "candidate_task_ids": ["cand_task_1"], "reducer_decision_id": "redstate_1"} | more


STATE_FAULTS = [
    ({}, []),
    ({"active_fact_ids": ["fact_9"]}, ["active_fact_ids beyond the decision", "dangling active_fact_ids"]),
    ({"active_preference_ids": ["fact_1"]}, ["active_preference_ids not of type preference"]),
    ({"as_of": "2023-01-01T00:00:00Z"}, ["active_fact_ids not active at as_of", "active_taste_card_ids not active at as_of"]),
    ({"active_fact_ids": ["fact_old"]}, ["active_fact_ids beyond the decision", "active_fact_ids not active at as_of"]),
    ({"active_taste_card_ids": ["taste_9"]}, ["active_taste_card_ids beyond the decision", "dangling active_taste_card_ids"]),
    ({"candidate_task_ids": ["cand_claim_1"]}, ["candidate_task_ids not of type task"]),
    ({"candidate_task_ids": ["cand_task_9"]}, ["dangling candidate_task_ids"]),
    ({"evidence_span_ids": ["span_1"]}, ["evidence_span_ids beyond the decision"]),
    ({"reducer_decision_id": "redstate_2"}, ["active_fact_ids beyond the decision", "active_taste_card_ids beyond the decision", "evidence_span_ids beyond the decision", "snapshot is no target of its decision"]),
    ({"superseded_by": ["projstate_none"]}, ["dangling supersession", "superseded_by beyond the decision"]),
]


def test_state_bundle_of_projects(spark):
    sources, episodes, spans = evidence(spark)
    trusted = table(spark, "fact_ledger_entry", entry("fact_1"), entry("fact_old", valid_until="2024-02-01T00:00:00Z"))
    tasks = spark.createDataFrame([("cand_task_1", "task"), ("cand_claim_1", "claim")], "id string, candidate_type string")
    states = [project(f"projstate_{i}", project_id=f"p{i}") | change for i, (change, _) in enumerate(STATE_FAULTS)]
    decisions = table(spark, "state_reducer_decision", {"id": "redstate_1", "target_project_state_ids": [s["id"] for s in states], "evidence_span_ids": ["span_2"], "ledger_entry_ids": ["fact_1"], "taste_card_ids": ["taste_1"]}, {"id": "redstate_2"})
    found = integrity.state_bundle(table(spark, "project_state_snapshot", *states), group="project_id", trusted=trusted, sources=sources, episodes=episodes, spans=spans, candidates=tasks, cards=table(spark, "taste_card", card("taste_1")), decisions=decisions)
    assert outcome(found, "projstate_") == {f"projstate_{i}": sorted(rules) for i, (_, rules) in enumerate(STATE_FAULTS) if rules}
    assert outcome(found, "redstate_") == {"redstate_1": ["target_project_state_ids answer to another decision"]}


def test_state_bundle_of_cores_and_overlaps(spark):
    core = {"id": "corestate_1", "schema_version": "1.0.0", "status": "active", "as_of": DAY, "subject": "me", "valid_from": "2024-06-01T00:00:00Z", "active_project_state_ids": ["projstate_1", "projstate_2", "projstate_9"]}
    cores = table(spark, "core_state_snapshot", core, core | {"id": "corestate_2", "active_project_state_ids": []}, core | {"id": "corestate_3", "status": "superseded", "active_project_state_ids": []})
    projects = table(spark, "project_state_snapshot", project("projstate_1"), project("projstate_2", stale_after="2024-12-01T00:00:00Z"))
    found = integrity.state_bundle(cores, group="subject", trusted=table(spark, "fact_ledger_entry"), projects=projects)
    assert rows(found) == [("active_project_state_ids not active at as_of", "corestate_1", "projstate_2"), ("dangling active_project_state_ids", "corestate_1", "projstate_9"), ("periods overlap", "corestate_2", "corestate_1")]


TASK = {"task_id": "t1", "task_title": "title", "task_type": "research", "task_summary": "summary", "project_id": None, "risk_class": "low", "sensitivity": "internal"}


@pytest.fixture(scope="module")
def compiled(spark):
    """A pack compiled from a small bundle, with all planes that its rules look at."""
    sources, episodes, spans = evidence(spark)
    entries = table(spark, "fact_ledger_entry", entry("fact_1", source_record_ids=["src_1"], evidence_span_ids=["span_1"], confidence="high"), entry("fact_2", status="stale", evidence_span_ids=["span_2"]), entry("fact_3", evidence_span_ids=["span_2"]))
    g = citations.graph(sources.select("id", F.lit("source_record").alias("record_type")), spans.select("id", F.lit("evidence_span").alias("record_type"), "source_id"), entries.select("id", F.lit("fact").alias("record_type"), F.col("evidence_span_ids").alias("evidence_ids")))
    records = entries.select(F.lit(0).alias("pos"), "*").withColumns({"record_type": F.lit("fact_ledger_entry"), "privacy_class": F.lit("internal")})
    selected = compiler.select_records(records, g, access.team_scope(), compiler.Policy())
    pack = compiler.document(selected, g, spans.withColumn("created_at", F.lit(DAY)), task=TASK, state={"core_state_id": None, "project_state_ids": ["projstate_1"]}, created_at=DAY)
    none = lambda n: table(spark, n)
    planes = {"source_records": sources, "episode_records": episodes, "evidence_spans": spans, "candidates": spark.createDataFrame([("cand_claim_1", "claim")], "id string, candidate_type string"), "ledger_entries": entries, "taste_cards": none("taste_card"),
              "project_states": table(spark, "project_state_snapshot", project("projstate_1")), "core_states": none("core_state_snapshot"), "packs": pack, "receipts": compiler.document_receipt(pack), "reports": compiler.document_report(pack)}
    # Written once, as packs are; every rule would compile them anew.
    return planes | {n: planes[n].checkpoint() for n in ("packs", "receipts", "reports")}, selected.checkpoint()


def test_a_compiled_pack_breaks_no_rule(spark, compiled):
    planes, selected = compiled
    pack = planes["packs"].first()
    assert broken(integrity.pack_documents(planes)) == []
    assert pack.id.startswith("ctx_") and len(pack.pack_hash_sha256) == 64 and pack.trusted_memory.fact_ids == ["fact_1", "fact_3"] and pack.evidence.primary_evidence_span_ids == ["span_1", "span_2"]
    assert pack.evidence.source_record_ids == ["src_1"] and pack.evidence.episode_record_ids == ["ep_1"] and set(pack.retrieval_trace.included_ids) >= {"fact_1", "span_1", "projstate_1"}
    assert rows(compiler.left_out(selected)) == [("fact_2", "status_stale")]
    receipt, report = planes["receipts"].first(), planes["reports"].first()
    assert receipt.id.startswith("ctxreceipt_") and receipt.input_refs.ledger_entry_ids == ["fact_1", "fact_3"] and receipt.selection_policy.current_cutoff == DAY
    assert report.id.startswith("ctxval_") and report.status == "pass" and report.checks["evidence_present"] == "pass"
    fields = lambda df, name: sorted(df.columns) == sorted(schemas.struct_type(name).names)
    assert fields(planes["packs"], "context_pack") and fields(planes["receipts"], "context_pack_build_receipt") and fields(planes["reports"], "context_pack_validation_report")
    failing = compiler.document_report(planes["packs"], spark.createDataFrame([("r", pack.id, "x"), ("r", pack.id, "y")], "rule string, record_id string, ref_id string")).first()
    assert failing.status == "fail" and [(e.code, e.message, e.related_ids) for e in failing.errors] == [("r", "2 times", ["x"])]


def set_in(section, field, value):
    """A change of one member; a tuple stands for a list of ids."""
    column = lambda: F.array(*map(F.lit, value)).cast("array<string>") if isinstance(value, tuple) else F.lit(value)
    return lambda df: df.withColumn(section, F.col(section).withField(field, column()))


PACK_FAULTS = [
    ("packs", set_in("evidence", "source_record_ids", ()), ["source_id of a span not declared"]),
    ("packs", set_in("evidence", "episode_record_ids", ("ep_9",)), ["dangling episode_record_ids", "episode_id of a span not declared"]),
    ("packs", set_in("evidence", "primary_evidence_span_ids", ("span_9",)), ["dangling primary_evidence_span_ids", "not in the trace", "primary_evidence_span_ids not within evidence_span_ids"]),
    ("packs", set_in("retrieval_trace", "included_ids", ("fact_1",)), ["not in the trace"]),
    ("packs", set_in("candidate_context", "candidate_task_ids", ("cand_claim_1",)), ["candidate_task_ids not of type task", "not in the trace", "receipt lacks candidate_ids"]),
    ("packs", set_in("trusted_memory", "preference_ids", ("fact_1",)), ["preference_ids not of type preference"]),
    ("packs", set_in("trusted_memory", "fact_ids", ("fact_2",)), ["fact_ids not active at created_at", "not in the trace", "receipt lacks ledger_entry_ids"]),
    ("packs", set_in("stale_or_superseded", "fact_ids", ("fact_1",)), ["late fact_ids neither stale, superseded nor contested", "receipt denies stale records"]),
    ("packs", set_in("state", "core_state_id", "corestate_9"), ["dangling core_state_id", "not in the trace", "receipt lacks core_state_ids"]),
    ("packs", set_in("task", "task_type", "writing"), ["task without taste cards"]),
    ("packs", lambda df: df.unionByName(df), ["duplicate in packs"]),
    ("receipts", lambda df: df.limit(0), ["pack without receipt"]),
    ("receipts", lambda df: df.withColumn("context_pack_id", F.concat(F.lit("none_"), "context_pack_id")), ["dangling context_pack_id", "pack without receipt"]),
    ("receipts", set_in("selection_policy", "current_cutoff", "1970-01-01T00:00:00Z"), ["cut-off differs from the pack's time"]),
    ("receipts", set_in("input_refs", "evidence_span_ids", ("span_1",)), ["receipt lacks evidence_span_ids"]),
    ("reports", lambda df: df.withColumn("status", F.lit("fail")), ["failing report has no errors", "pack without passing report"]),
    ("reports", lambda df: df.withColumn("checks", F.create_map(F.lit("a"), F.lit("fail"))), ["passing report has failures"]),
]


def test_faults_of_packs(spark, compiled):
    """Every fault in a copy of the pack of its own, with a receipt and a report of its own."""
    planes, _ = compiled
    copies = {n: [] for n in ("packs", "receipts", "reports")}
    for i, (plane, change, _) in enumerate(PACK_FAULTS):
        for name, own in (("packs", "id"), ("receipts", "context_pack_id"), ("reports", "context_pack_id")):
            df = planes[name].withColumn(own, F.lit(f"ctx_{i}"))
            df = df if name == "packs" else df.withColumn("id", F.lit(f"{name}_{i}"))
            copies[name].append(change(df) if name == plane else df)
    all_of = lambda dfs: functools.reduce(lambda a, b: a.unionByName(b), dfs)
    found = integrity.pack_documents(planes | {n: all_of(dfs) for n, dfs in copies.items()})
    got = {}
    for r in found.collect():
        number = next((x.rsplit("_", 1)[1] for x in (r.record_id, r.ref_id) if x and x.split("_")[0] in ("ctx", "receipts", "reports")), "")
        got.setdefault(int(number), set()).add(r.rule)
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted(rules) for i, (_, _, rules) in enumerate(PACK_FAULTS)}


def test_a_pack_needs_evidence(spark, compiled):
    planes, selected = compiled
    g = citations.Graph(*[df.limit(0) for df in (spark.createDataFrame([], "id string, kind string, record_type string"), *[spark.createDataFrame([], "from_id string, to_id string, relation string")] * 2)])
    spans = planes["evidence_spans"].withColumn("created_at", F.lit(DAY))
    with pytest.raises(Exception, match="a pack needs evidence"):
        compiler.document(selected, g, spans, task=TASK, state={}, created_at=DAY).collect()
    loose = compiler.document(selected, g, spans, task=TASK, state={}, created_at=DAY, policy=compiler.Policy(require_source_coverage=False)).first()
    assert loose.evidence.evidence_span_ids == []


def test_sessions_are_saved_and_remembered(spark):
    data = [("s", i, f'{{"question": "q{i}", "x": 1}}', f"a{i}") for i in range(5)] + [("t", 1, '["one", {"input": "two"}, 3]', '{"x": {"y": 1}}'), (None, 1, "x", "y"), ("t", 2, None, "only output")]
    turns = spark.createDataFrame(data, "session_id string, turn int, input string, output string")
    sources, episodes, spans = sessions.session_records(turns, captured_at=F.lit(DAY))
    assert sources.count() == 2 and episodes.count() == 7 and spans.count() == 14
    pack = sessions.remembered(sources, episodes, spans, keep=2)
    assert rows(pack.records, "session_id", "turn", "summary") == [("s", 3, "a3"), ("s", 4, "a4"), ("t", 1, '{"x": {"y": 1}}'), ("t", 2, "only output")]
    assert rows(pack.evidence.where("session_id = 's'"), "turn", "text_excerpt") == [(3, "a3"), (3, "q3"), (4, "a4"), (4, "q4")]
    assert rows(pack.evidence.where("session_id = 't'"), "text_excerpt") == [("one\ntwo\n3",), ("only output",), ('{"x": {"y": 1}}',), (None,)]
    assert pack.sources.count() == 2 and {r.id for r in sources.collect()} == {r.source_id for r in spans.collect()}


def test_resolutions_as_documents(spark):
    docs = ['{"id": "ignored", "conflict_id": "c", "chosen_version_index": 1, "chosen_record": {"b": 1, "a": [1.0, null]}, "rejected_record_ids": ["x"], "resolved_by": "me \\"q\\"", "resolved_at": "2025-01-01T00:00:00Z", "rationale": "because"}',
            '{"conflict_id": "d", "chosen_version_index": -2, "chosen_record": null, "resolved_by": "me", "resolved_at": "x", "rationale": "r", "superseded_at": null, "metadata": {"k": "v"}}']
    made = conflicts.from_documents(spark.createDataFrame([(d,) for d in docs], "doc string"))
    got = {r.conflict_id: r for r in made.collect()}
    assert got["c"].id.startswith("confres_") and got["c"].rejected_record_ids == ["x"] and got["d"].rejected_record_ids == [] and got["d"].chosen_record is None
    import hashlib
    import json

    payload = {k: v for k, v in json.loads(docs[0]).items() if k != "id"} | {"superseded_at": None, "metadata": {}}
    assert got["c"].id == "confres_" + hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]
    again = conflicts.from_documents(conflicts.to_documents(made))
    assert rows(again, "id", "metadata") == rows(made, "id", "metadata") and rows(again, "conflict_id", "chosen_version_index") == [("c", 1), ("d", -2)]


def test_hygiene_report_has_an_id(spark):
    df = table(spark, "fact_ledger_entry", entry("fact_1", evidence_span_ids=["gone"]), entry("fact_1", evidence_span_ids=["gone"]), entry("fact_2"))
    now = F.lit(DAY).cast("timestamp")
    report = hygiene.report(df, df.select("id"), now=now, conflicts=3, resolved=1, window_start="2024-01-01T00:00:00Z", window_end=DAY, fingerprint="f" * 64)
    assert report.id.startswith("hygiene_") and report.id == hygiene.report(df, df.select("id"), now=now, conflicts=3, resolved=1, window_start="2024-01-01T00:00:00Z", window_end=DAY, fingerprint="f" * 64).id
    assert (report.orphaned_evidence, report.missing_evidence, report.window_start, report.computed_at) == (2, 1, "2024-01-01T00:00:00Z", DAY) and "of which resolved: 1" in report.markdown()
    with pytest.raises(ValueError):
        hygiene.report(df, df.select("id"), now=now, window_start="2025-02-01T00:00:00Z", window_end=DAY)


def test_cards_from_signals_make_a_sound_bundle(spark):
    sources, episodes, spans = evidence(spark)
    schema = "id string, candidate_type string, domain string, signal_kind string, taste_text string, strength_hint string, confidence string, evidence_span_ids array<string>, example_span_ids array<string>, contrast_span_ids array<string>, source_record_ids array<string>"
    data = [("cand_taste_1", "taste_signal", "writing", "principle", "short", "strong", "high", ["span_1"], ["span_1"], ["span_2"], ["src_1"]), ("cand_taste_2", "taste_signal", "code", "principle", "plain", "weak", "low", ["span_2"], None, None, None), ("cand_taste_3", "taste_signal", "x", "y", "z", "weak", "low", [], None, None, None)]
    signals = spark.createDataFrame([*data, data[0]], schema)
    cards, decisions = taste.cards_from_signals(signals, now=F.lit(DAY).cast("timestamp"))
    found = integrity.taste_bundle(sources, spans, signals.distinct(), decisions, cards, episodes=episodes)
    assert rows(found) == []
    got = {r.principle: r for r in cards.collect()}
    assert sorted(got) == ["plain", "short"] and got["short"].id.startswith("taste_") and got["short"].evidence_span_ids == ["span_1", "span_2"]
    assert [(p.preferred_span_id, p.rejected_span_id) for p in got["short"].contrast_pairs] == [("span_1", "span_2")] and got["plain"].contrast_pairs == []
    assert set(cards.columns) >= {f for f, _, _ in schemas.fields_of("taste_card")} - {"freshness_score"}


def test_records_as_typed_tables(spark):
    docs = ['{"ledger_type": "fact", "id": "fact_1", "evidence_span_ids": ["s"], "metadata": {"k": [1, 2]}, "odd": 1}', '{"ledger_type": "decision", "id": "dec_1"}', '{"ledger_type": "other"}', "no json", None]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    tables = records.of_family(df, "ledger")
    fact = tables["fact_ledger_entry"].first()
    assert (fact.id, fact.evidence_span_ids, fact.metadata, fact.unknown_fields) == ("fact_1", ["s"], '{"k":[1,2]}', ["odd"]) and "status" in fact.missing_fields and "id" not in fact.missing_fields
    assert {k: t.count() for k, t in tables.items()} == {"fact_ledger_entry": 1, "preference_ledger_entry": 0, "decision_ledger_entry": 1}
    assert sorted(map(repr, (r.doc for r in records.strangers(df, "ledger").collect()))) == sorted(map(repr, docs[2:]))
    assert records.typed(df.limit(0), "context_pack").count() == 0


def test_candidates_are_dealt_out_over_spans(spark):
    candidates = spark.createDataFrame([(f"c{i}", None) for i in range(7)], "id string, evidence_span_ids array<string>")
    spans = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s2",)], "id string")
    assert rows(reducer.spread_over_spans(candidates, spans)) == [(f"c{i}", [f"s{i % 3 + 1}"]) for i in range(7)]
    assert rows(reducer.spread_over_spans(candidates.limit(1), spans.limit(0)), "evidence_span_ids") == [([],)]


def test_a_null_id_or_empty_plane_is_no_fault(spark):
    nothing = spark.createDataFrame([], "rule string, record_id string, ref_id string")
    sources, episodes, spans = (df.limit(0) for df in evidence(spark))
    assert rows(integrity.taste_bundle(sources, spans, spark.createDataFrame([], "id string, candidate_type string"), table(spark, "taste_reducer_decision"), table(spark, "taste_card"))) == rows(nothing)
