"""Functions on records: identifiers, access, decay, validity, classifiers, rules, schemas, texts."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from mnemolith import schemas
from mnemolith.functions import access, canonical, classify, decay, jsonschema, render, validity
from mnemolith.operators import bundles, rules, temporal
from mnemolith.plans import compiler
from tests.helpers import SF, rows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_known_identifiers(spark):
    loc = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"))
    src = canonical.source_id(F.lit("chatgpt_conversation"), F.lit("https://example.com/transcript/42"), loc("", ""), F.lit("a" * 64))
    span = canonical.span_id(F.lit("src_e59214fe833ab76405bce742"), loc("line_range", "10-15"))
    ep = canonical.episode_id(F.lit("src_e59214fe833ab76405bce742"), F.lit("conversation_segment"), loc("ordinal", "1"))
    spans = F.array(F.lit("span_b6013eb2af9174a65f293646"))
    fact = canonical.ledger_id(F.lit("fact"), spans, {"subject": F.lit("linear"), "predicate": F.lit("p"), "object": F.lit("o"), "scope": F.lit("global"), "valid_from": F.lit("2026-05-30T13:00:00Z")})
    none = F.array().cast("array<string>")
    dec = canonical.content_id("memory_reducer_decision", decision_type=F.lit("promote"), target_candidate_ids=none, target_ledger_entry_ids=F.array(F.lit("fact_600a5293619a492d193f51f5")), evidence_span_ids=spans, rationale=F.lit("ok"))
    got = one(spark, src, span, ep, fact, dec)
    assert tuple(got) == ("src_e59214fe833ab76405bce742", "span_b6013eb2af9174a65f293646", "ep_274a0d959e9b96ae3290f87d", "fact_600a5293619a492d193f51f5", "redmem_2be54b2c85b8dc3d12ba899e")


def test_identifiers_are_the_same_inside_generators(spark):
    made = canonical.episode_id(F.lit("src_x"), F.lit("other"), F.struct(F.lit("k").alias("kind"), F.lit("v").alias("value")))
    plain, inside = one(spark, made), spark.range(1).select(F.explode(F.array(made)).alias("id"), made.alias("beside")).first()
    assert plain[0] == inside.id == inside.beside


def test_canonical_json(spark):
    texts = ['{"b": 1.0, "a": "é"}', "[1,  2]", "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(canonical.canonical_json("t")).collect()] == ['{"a":"é","b":1.0}', "[1,2]", None, None]


@pytest.mark.parametrize(("scope", "allowed"), [(access.public_scope(), 1), (access.team_scope(), 2), (access.customer_scope(), 3), (access.private_scope(), 5)])
def test_scopes(spark, scope, allowed):
    df = spark.createDataFrame([(c,) for c in access.PRIVACY_CLASSES], "p string")
    assert access.scoped(df, scope, privacy_class=F.col("p"), record_type=F.lit("fact")).count() == allowed


def test_access_types_unknown_classes_and_nulls(spark):
    df = spark.createDataFrame([("public", "fact"), ("public", "claim"), ("public", None), ("odd", "fact"), (None, "fact")], "p string, t string")
    decided = access.decide(df, access.Scope("internal", ("fact",)), privacy_class=F.col("p"), record_type=F.col("t"))
    assert rows(decided, "p", "t", "action") == sorted([("public", "fact", "allow"), ("public", "claim", "drop"), ("public", None, "allow"), ("odd", "fact", "drop"), (None, "fact", "allow")], key=repr)
    assert ("drop", None, 2) in rows(access.summary(decided))
    with pytest.raises(ValueError):
        access.Scope("secret")


def test_decay(spark):
    at = F.lit("2025-02-15T00:00:00Z").cast("timestamp")
    ids = lambda n: F.array_repeat(F.lit("x"), n)
    score = lambda text, s, e, curve: decay.decay_score(F.lit(text).cast("string"), at, ids(s), ids(e), decay.DecayPolicy(curve=curve))
    got = one(spark, score("2025-01-01T00:00:00Z", 0, 0, "exponential"), score("2025-01-01T00:00:00Z", 0, 0, "linear"), score("2026-01-01T00:00:00Z", 2, 1, "linear"), score("bad", 0, 0, "linear"), score(None, 0, 0, "linear"))
    assert got[0].score == pytest.approx(math.sqrt(0.5)) and got[1].score == pytest.approx(0.75)
    # What has no time, or one in the future, is fully fresh, whatever has happened to it.
    assert [tuple(g) for g in got[2:]] == [(1.0, 1.0, 0.0)] * 3
    more = one(spark, score(None, 2, 3, "exponential"), score("no time", 2, 3, "linear"), score("", 1, 1, "linear"), score("2025-02-15T00:00:00.000001Z", 1, 1, "linear"), score("2025-02-15T00:00:00Z", 2, 1, "linear"))
    assert [tuple(g) for g in more[:4]] == [(1.0, 1.0, 0.0)] * 4
    assert (more[4].score, more[4].time, more[4].event) == (pytest.approx(0.225), 1.0, pytest.approx(0.225))
    for bad in ({"half_life_days": 0}, {"curve": "odd"}, {"evidence_weight": 2}):
        with pytest.raises(ValueError):
            decay.DecayPolicy(**bad)


ENTRY = "id string, status string, superseded_by array<string>, valid_from string, valid_until string, stale_after string, g string"


def test_validity_and_chains(spark):
    data = [
        ("v1", "superseded", ["v2"], "2025-01-01T00:00:00Z", "2025-02-01T00:00:00Z", None, "a"),
        ("v2", "active", [], "2025-02-01T00:00:00Z", None, None, "a"),
        ("late", "active", None, "2025-03-01T01:00:00+02:00", None, "2025-03-01T00:00:00Z", "b"),
        ("open", "active", None, None, None, None, "b"),
        ("l1", "active", ["l2"], None, None, None, None),
        ("l2", "active", ["l1"], None, None, None, None),
        ("dang", "active", ["gone"], None, None, None, None),
    ]
    df = spark.createDataFrame(data, ENTRY)
    at = lambda t: F.lit(t).cast("timestamp")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(temporal.current(df, at("2025-02-15T00:00:00Z"))) == ["open", "v2"]
    assert ids(temporal.current(df, at("2025-02-28T23:30:00Z"))) == ["late", "open", "v2"]
    assert "v1" in ids(temporal.as_of(df, at("2025-01-15T00:00:00Z")))
    chains = {r.id: (r.last_id, r.steps, r.ends) for r in temporal.supersession_chains(df).collect()}
    assert chains["v1"] == ("v2", 1, "current") and chains["dang"] == ("gone", 1, "dangling") and chains["l1"] == (None, None, "cycle")
    # An open period overlaps what begins within it; touching ones don't overlap.
    assert rows(temporal.overlaps(df, group="g"), "g", "id", "overlaps_id") == [("b", "late", "open")]
    assert rows(temporal.overlaps(df, group="g", blocks=1)) == rows(temporal.overlaps(df, group="g", blocks=9))
    assert temporal.only_current(df, at("2025-02-15T00:00:00Z"), F.col("g") == "a").id == "v2"
    assert temporal.only_current(df, at("2025-02-15T00:00:00Z"), F.col("g") == "none") is None
    with pytest.raises(ValueError):
        temporal.only_current(df, at("2025-02-28T23:30:00Z"), F.col("g") == "b")


def test_classifiers(spark):
    data = [(["source_type"], None, None), (["candidate_type", "evidence_span_ids"], "claim", None), (["ledger_type", "evidence_span_ids"], None, "fact"), (["decision_type"], None, None), (["context_pack_id", "validator"], None, None), ([], None, None), (None, None, None)]
    df = spark.createDataFrame(data, "k array<string>, c string, l string")
    kind = classify.record_type(F.col("k"), F.col("c"), F.col("l"))
    got = [tuple(r) for r in df.select(kind, classify.plane_of_type(kind), classify.citation_kind(F.col("k")), classify.access_type(F.col("k"), F.col("c"), F.col("l"))).collect()]
    assert got == [
        ("source_record", "evidence", "source", "source_record"), ("candidate_claim", "candidate", "claim", "claim"), ("fact_ledger_entry", "ledger", "claim", "fact"), ("memory_reducer_decision", "audit", None, ""),
        ("context_pack_validation_report", "audit", None, ""), ("unknown", "audit", None, ""), ("unknown", "audit", None, ""),
    ]
    ids = spark.createDataFrame([("taste_1",), ("ctxval_1",), ("redmem_1",), ("x",)], "i string")
    assert [r[0] for r in ids.select(classify.plane_of_id(F.col("i"))).collect()] == ["taste", "contextpack", "reducer_decision", "other"]


def test_types_of_claims_and_for_the_compiler(spark):
    data = [(["ledger_type"], None, ""), (["candidate_type"], "task", None), (["domain", "signal_kind"], None, None), (["primary_evidence_span_ids"], None, None), (["evidence_span_ids"], None, "fact"), (None, "", None)]
    df = spark.createDataFrame(data, "k array<string>, c string, l string")
    kinds = df.select(classify.claim_type(F.col("k"), F.col("c"), F.col("l")), classify.compiler_type({"candidate_type": F.col("c"), "ledger_type": F.col("l")})).collect()
    assert [tuple(r) for r in kinds] == [("", "unknown"), ("task", "candidate_task"), ("taste_signal_candidate", "unknown"), ("context_pack", "unknown"), ("claim", "fact_ledger_entry"), ("claim", "unknown")]


def test_rules_and_raising(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "id string, n int")
    found = rules.violations(df, {"n is small": F.col("n") < 3, "n is there": F.col("n").isNotNull()})
    assert rows(found) == [(1, "n is small", "b"), (1, "n is small", "c"), (2, "n is there", "b")]
    with pytest.raises(rules.ViolationError, match="n is small"):
        rules.raise_on(found, "rule_no", "id")
    rules.raise_on(found.limit(0))


def test_schemas():
    assert set(schemas.FIELDS) >= {"source_record", "context_pack", "conflict_resolution"}
    with pytest.raises(schemas.SchemaNotFoundError):
        schemas.json_schema("nothing")
    schema = schemas.json_schema("evidence_span")
    good = {"id": "span_1", "schema_version": "1.0.0", "source_id": "s", "episode_id": None, "locator": {"kind": "k", "value": "v"}, "text_excerpt": None, "excerpt_policy": "none", "span_hash_sha256": "h", "privacy_class": "public", "metadata": {}}
    assert list(jsonschema.errors(good, schema)) == []
    bad = {k: v for k, v in good.items() if k != "source_id"} | {"privacy_class": "odd", "more": 1, "locator": []}
    assert len(list(jsonschema.errors(bad, schema))) == 4
    assert schemas.struct_type("fact_ledger_entry")["evidence_span_ids"].dataType.simpleString() == "array<string>"
    assert schemas.struct_type("evidence_span")["locator"].dataType.simpleString() == "struct<kind:string,value:string>"
    assert schemas.struct_type("taste_card")["contrast_pairs"].dataType.simpleString() == "array<struct<preferred_span_id:string,rejected_span_id:string,reason:string>>"
    assert len(schemas.FIELDS) == 24 and all(schemas.json_schema(n)["required"] for n in schemas.FIELDS)


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": ["integer", "null"], "minimum": 2}, [None, 2, 3.0], [1, 2.5, True, "2"]),
        ({"const": 1}, [1, 1.0], [True, 2]),
        ({"items": {"type": "string", "minLength": 1}, "minItems": 1, "maxItems": 2}, [["a"]], [[], [""], ["a", "b", "c"]]),
        ({"contains": {"const": "x"}}, [["x"], "no array"], [["y"]]),
        ({"anyOf": [{"required": ["a"]}, {"required": ["b"]}], "not": {"required": ["c"]}}, [{"a": 1}], [{}, {"a": 1, "c": 1}]),
        ({"if": {"properties": {"p": {"const": "none"}}, "required": ["p"]}, "then": {"properties": {"t": {"type": "null"}}}, "else": {"required": ["t"]}}, [{"p": "none", "t": None}, {"t": 1}], [{"p": "none", "t": "x"}, {"p": "q"}]),
        ({"$defs": {"n": {"type": "number"}}, "additionalProperties": {"$ref": "#/$defs/n"}}, [{"a": 1}], [{"a": "1"}]),
        ({"oneOf": [{"type": "number"}, {"const": 1}]}, [2], [1]),
        ({"type": "string", "pattern": "^a", "maxLength": 2}, ["ab"], ["b", "abc"]),
    ],
)
def test_schema_keywords(schema, good, bad):
    assert all(jsonschema.valid(v, schema) for v in good)
    assert not any(jsonschema.valid(v, schema) for v in bad)


def test_compiled_schemas_agree_with_the_single_value_form(spark):
    schemas_ = [
        {"type": "object", "required": ["a", "b c"], "properties": {"a": {"type": "integer", "minimum": 1}, "b c": {"enum": ["x", 1, None, True]}, "t": {"type": "array", "items": {"type": "string", "pattern": "^x"}, "minItems": 1, "contains": {"const": "x1"}}, "o": {"type": ["object", "null"], "additionalProperties": {"type": "number", "maximum": 3}}}, "additionalProperties": False},
        {"$defs": {"n": {"type": "number"}}, "anyOf": [{"$ref": "#/$defs/n"}, {"type": "array", "items": {"$ref": "#/$defs/n"}}], "not": {"const": 7}},
        {"oneOf": [{"type": "integer"}, {"type": "number", "maximum": 2}], "if": {"type": "integer"}, "then": {"minimum": 0}, "else": {"allOf": [{"maximum": 9}, {"minimum": -9}]}},
        {"type": "object", "properties": {"child": {"$ref": "#"}}, "additionalProperties": False},
        schemas.json_schema("evidence_span"), schemas.json_schema("context_pack"), True, False,
    ]
    texts = [
        '{"a": 1, "b c": "x", "t": ["x1", "x2"], "o": {"p": 1, "q": 4, "r": "s"}}', '{"a": 1.0, "b c": true, "t": [], "o": null}', '{"a": 0, "b c": 1.0, "t": ["y", 1, null], "z": 1}', '{"a": 1.5, "b c": null, "o": [1]}', '{"a": true, "b c": "q"}', "[]", "[1, 2.5]", '[1, "a"]', "7", "7.0", "-1", "1.5", "12.5", '"text"', "null", "true", "", "no json", "{", '{"a": 1, "a": 2, "b c": "x"}', None,
        '{"child": {"child": {"x": 1}}}', '{"id": "", "schema_version": "1", "source_id": null, "locator": {"kind": "k"}, "metadata": {"any": [1]}, "privacy_class": "odd", "more": 1}', '{"task": {"task_id": 1}, "evidence": {"evidence_span_ids": ["a", 1]}, "conflicts_and_uncertainties": [{"kind": "x"}, 3]}', "123456789012345678901234567890", '{"\u00e9": "\ud83d\ude00"}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for schema in schemas_:
        for row in df.select("t", jsonschema.schema_errors(F.col("t"), schema).alias("e")).collect():
            try:
                want = sorted(jsonschema.errors(json.loads(row.t if row.t is not None else ""), schema))
            except ValueError:
                want = ["$: is no JSON"]
            assert sorted(row.e) == want, (schema, row.t)


def test_texts(spark):
    fact = spark.createDataFrame([("f1", "said", "s", "p", "o", "g", None, "t", ["span_1", "span_2"]), ("f2", None, "s", None, "o", "", "low", None, [])], "id string, fact_text string, subject string, predicate string, object string, scope string, confidence string, valid_from string, evidence_span_ids array<string>")
    got = {r.record_id: r for r in render.embedding_inputs(fact, "fact_ledger_entry").collect()}
    assert got["f1"].text == "said\nSubject: s p o\nScope: g\nConfidence: unknown\nValid from: t\nEvidence: span_1, span_2"
    assert got["f2"].text == "Confidence: low\n"
    assert got["f2"].metadata == {"record_id": "f2", "record_type": "fact_ledger_entry", "privacy_class": "internal", "plane": "ledger", "subject": "s", "object": "o", "confidence": "low"}
    for kind in (*render.TEMPLATES, "evidence_span", "episode_record", "context_pack", "other"):
        assert render.embedding_inputs(fact.select("id"), kind).collect() is not None
    episode = spark.createDataFrame([("e", "talk", None, ["a", "b"])], "id string, title string, event_time_end string, actors array<string>")
    assert render.embedding_inputs(episode, "episode_record").first().text == "Episode: talk\nType: unknown\nSource: unknown\nActors: a, b\nTime: unknown to ongoing\n"


def test_truncation(spark):
    texts = ["One two. Three four five", "no end at all here....x", "short", "a" * 30, "One two.\nThree four five", "日本語。" * 9, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r[0].text, r[0].truncated) for r in df.select(render.truncated(F.col("t"), 12)).collect()]
    assert got == [("One two....[truncated]", True), ("no end at al...[truncated]", True), ("short", False), ("a" * 12 + "...[truncated]", True), ("One two....[truncated]", True), ("日本語。" * 3 + "...[truncated]", True), ("", False)]
    with pytest.raises(ValueError):
        render.truncated(F.col("t"), 0)


def test_window_is_inclusive(spark):
    at = F.lit("2025-01-01T00:00:00Z").cast("timestamp")
    assert one(spark, validity.in_window(at, valid_from=F.lit(None).cast("string"), valid_until=F.lit("2025-01-01T00:00:00Z")))[0]


def test_expected_ids(spark):
    from mnemolith.functions.identity import HEAD, MEANING, expected_id, with_id_check

    row = [("fact_600a5293619a492d193f51f5", "fact", "linear", "p", "o", "global", "2026-05-30T13:00:00Z", ["span_b6013eb2af9174a65f293646"])]
    df = spark.createDataFrame(row, "id string, ledger_type string, subject string, predicate string, object string, scope string, valid_from string, evidence_span_ids array<string>")
    assert with_id_check(df, "fact_ledger_entry").first().id_matches
    for kind in (*MEANING, "memory_reducer_decision", "taste_reducer_decision", "state_reducer_decision"):
        assert df.select(expected_id(kind, df.columns)).first()[0].startswith(canonical.PREFIXES[kind] + "_")
    assert set(HEAD)
    with pytest.raises(ValueError):
        expected_id("nothing", [])


def test_tools(spark):
    from mnemolith.plans import tools

    assert "evidence_span" in tools.list_schemas() and tools.read_schema("evidence_span")["type"] == "object"
    spans = spark.createDataFrame([("span_1", "", None, "odd")], "id string, source_id string, text_excerpt string, privacy_class string")
    assert tools.validate_bundle({"evidence_span": spans, "taste_card": spans.limit(0)}) == {"evidence_span": ["[span_1] privacy_class is known", "[span_1] source_id is required"], "taste_card": []}
    records = spark.createDataFrame([("a", "public", "fact"), ("b", "private", "fact")], "id string, privacy_class string, record_type string")
    assert rows(tools.check_access(records, {"max_privacy_class": "odd"}), "id", "action") == [("a", "allow"), ("b", "drop")]
    states = spark.createDataFrame([("p2", "project_state"), ("p1", "project_state"), ("c", "core_state")], "id string, state_type string")
    named = lambda *ids: tools.state_reference(states, spark.createDataFrame([(i,) for i in ids], "id string"))
    assert named("p1", "p2") == {"core_state_id": None, "project_state_ids": ["p1", "p2"]} and named()["core_state_id"] == "c"
    with pytest.raises(ValueError):
        tools.state_reference(states.limit(0), states)


def test_blanks_of_any_kind(spark):
    from mnemolith.functions.instants import instant, trimmed
    from mnemolith.operators.survivorship import has_value

    df = spark.createDataFrame([("\t2025-01-01T00:00:00Z\u00a0\n",), ("\u00a0N/A\t",), ("\u00a0",), ("real",)], "t string")
    got = [tuple(r) for r in df.select(trimmed(F.col("t")), has_value(F.col("t")), instant(F.col("t")).isNotNull()).collect()]
    assert got == [("2025-01-01T00:00:00Z", True, True), ("N/A", False, False), ("", False, False), ("real", True, False)]


def test_overlaps_in_blocks(spark):
    import random

    rng = random.Random(6)
    day = lambda n: f"2025-01-{n:02d}T00:00:00Z"
    data = [(f"k{i:03d}", "hot" if rng.random() < 0.6 else "cold", day(b := rng.randrange(1, 25)), day(b + rng.randrange(0, 5)), None) for i in range(80)]
    df = spark.createDataFrame(data, "id string, g string, valid_from string, valid_until string, stale_after string")
    want, seen = [], {}
    for key, g, begins, ends, _ in sorted((d for d in data if d[2] < d[3]), key=lambda d: (d[1], d[2], d[3], d[0])):
        if g in seen and seen[g][0] > begins:
            want.append((g, key, seen[g][1]))
        seen[g] = max(seen.get(g, ("", "")), (ends, key))
    for blocks in (1, 3, 12):
        assert rows(temporal.overlaps(df, group="g", blocks=blocks)) == sorted(want, key=repr)


def test_unlimited_selection_is_numbered(spark):
    from mnemolith.plans.compiler import Policy, select_records

    data = [(f"r{i:02d}", 0, "1.0.0", "fact" if i % 3 else "preference", "active", "high", "public", f"2025-01-{1 + i % 28:02d}T00:00:00Z") for i in range(40)]
    df = spark.createDataFrame(data, "id string, pos int, schema_version string, record_type string, status string, confidence string, privacy_class string, asserted_at string")
    for strategy in ("recent", "diverse"):
        whole = rows(select_records(df, None, access.team_scope(), Policy(0, strategy)).where("rank is not null"), "rank", "id")
        some = rows(select_records(df, None, access.team_scope(), Policy(10, strategy)).where("rank is not null"), "rank", "id")
        assert sorted(r for r, _ in whole) == list(range(1, 41)) and set(some) <= set(whole) and len(some) == 10


def test_ledger_rule_violations_reports_every_rule(spark, tmp_path):
    from mnemolith.queries import reference

    entries = spark.read.parquet(f"{SF}/ledger_entry.parquet").where("status = 'active' and size(coalesce(superseded_by, array())) = 0").limit(1)
    broken = entries.withColumns({"schema_version": F.lit("9"), "reducer_decision_id": F.lit("dec_1"), "supersedes": F.array(F.lit("mem_1")), "valid_from": F.lit("soon")})
    broken.write.parquet(str(tmp_path / "ledger_entry.parquet"))
    got = {r.rule for r in reference.ledger_rule_violations(spark, str(tmp_path)).collect()}
    assert {"schema_version is known", "decision has its prefix", "links have their prefix", "valid_from is a time"} <= got


RENDERED = [
    ("source_record", {"title": "t", "author_or_sender": None, "source_type": "pdf", "origin_uri": None, "raw_ref": {"kind": "k", "value": "v"}, "captured_at": "c"}, "Title: t\nAuthor: unknown\nType: pdf\nURI: v\nCaptured: c"),
    ("episode_record", {"title": "e", "episode_type": "other", "source_id": "src_1", "actors": ["a", "b"], "event_time_start": "x", "evidence_span_ids": ["span_1"]}, "Episode: e\nType: other\nSource: src_1\nActors: a, b\nTime: x to ongoing\nEvidence: span_1"),
    ("candidate_claim", {"claim_text": "c", "subject": "s", "predicate": "p", "object": "o", "claim_scope": "", "evidence_span_ids": []}, "Claim: c\nSubject: s p o\nConfidence: unknown\n"),
    ("candidate_preference", {"preference_text": "p", "subject": "s", "domain": "d", "scope": "w", "strength_hint": "weak"}, "Preference: p\nSubject: s\nDomain: d\nScope: w\nStrength: weak\n"),
    ("candidate_decision", {"decision_text": "d", "owner_hint": "o", "alternatives_mentioned": ["x", "y"]}, "Decision: d\nOwner: o\nAlternatives: x, y\n"),
    ("candidate_task", {"task_text": "t", "task_kind": "k", "project_refs": ["p"], "urgency_hint": "u", "evidence_span_ids": ["a", "b"]}, "Task: t\nKind: k\nProjects: p\nUrgency: u\nEvidence: a, b"),
    ("candidate_taste_signal", {"taste_text": "t", "domain": "d", "signal_kind": "k", "example_span_ids": ["e"], "contrast_span_ids": ["c"]}, "Taste: t\nDomain: d\nKind: k\nExamples: e\nContrast: c\n"),
    ("taste_card", {"principle": "p", "rationale": "r", "subject": "s", "taste_kind": "k", "strength": "strong"}, "Principle: p\nRationale: r\nSubject: s\nKind: k\nStrength: strong\n"),
    ("context_pack", {"pack_type": "context_pack", "task": {"task_summary": "", "task_title": "title"}, "trusted_memory": {"fact_ids": ["f2", "f1"], "taste_card_ids": ["t"]}, "candidate_context": {"candidate_task_ids": []}}, "ContextPack: context_pack\nTask: title\nTrusted memory: f2, f1, t"),
    ("memory_reducer_decision", {"id": "r", "rationale": "why", "decided_by": {"agent": "a"}, "evidence_span_ids": ["s", None, "t"], "checks": {"b": "fail", "a": "pass"}}, 'checks: {"a": "pass", "b": "fail"}\ndecided_by: {"agent": "a", "model": null, "prompt_ref": null, "tool": null}\nevidence_span_ids: s, t\nid: r\nrationale: why'),
]


@pytest.mark.parametrize(("kind", "record", "text"), RENDERED)
def test_rendered_texts(spark, kind, record, text):
    schema = schemas.struct_type(kind)
    whole = {f.name: None for f in schema.fields} | record
    found = render.embedding_inputs(spark.createDataFrame([whole], schema), kind)
    assert found.first().text == text
    again = render.from_documents(render.to_documents(found))
    assert sorted(again.columns) == sorted(found.columns) and again.select(sorted(found.columns)).collect() == found.select(sorted(found.columns)).collect()
    assert render.from_documents(spark.createDataFrame([('{"text": "x", "more": 1}',)], "doc string")).first().asDict() == {"record_id": "", "record_type": "", "plane": "audit", "privacy_class": "internal", "text": "x", "truncated": False, "char_count": 0, "content_hash_sha256": "", "metadata": {}}


def test_selection_excludes_for_the_first_reason(spark):
    data = [(0, "a", "1.0.0", "fact", "active", "high", "public"), (1, "a", "1.0.0", "fact", "active", "high", "secret"), (2, "b", "1.0.0", "fact", "stale", "low", "private"), (3, "", "1.0.0", "fact", "active", "low", None), (4, "c", None, "fact", "stale", "low", None), (5, "d", "1.0.0", "fact", "contested", None, "internal"), (6, "e", "1.0.0", "fact", "superseded", "low", "internal"), (7, "f", "1.0.0", "fact", "active", None, "internal")]
    df = spark.createDataFrame(data, "pos int, id string, schema_version string, record_type string, status string, confidence string, privacy_class string")
    found = compiler.select_records(df, None, access.team_scope(), compiler.Policy(max_records=2))
    assert rows(found, "id", "excluded", "rank") == sorted([("a", None, 1), ("e", None, 2), ("a", "duplicate_id", None), ("b", "outside_scope", None), ("", "schema_invalid", None), ("c", "schema_invalid", None), ("d", "status_contested", None), ("f", "exceeded_max_records", None)], key=repr)


def test_planes_in_order_and_first_seen_places(spark):
    one_, two = (spark.createDataFrame(d, "pos long, id string, doc string") for d in ([(1, "b", "1"), (2, "a", "2"), (3, "b", "3"), (4, None, "4")], [(1, "a", "5")]))
    assert rows(bundles.flatten_planes({"x": one_, "y": two}), "plane_ord", "plane", "id") == [(0, "x", "a"), (0, "x", "b"), (0, "x", "b"), (0, "x", None), (1, "y", "a")]
    assert [tuple(r) for r in bundles.dedup_in_order(one_).orderBy("place").collect()] == [("b", "3", 1), ("a", "2", 2)]
    with pytest.raises(ValueError):
        bundles.flatten_planes({})
