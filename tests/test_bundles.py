from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import bundles, conflicts, migrate
from mnemolith.operators.reducer import judge, promote
from mnemolith.plans.compiler import Policy
from tests.helpers import rows

ENV = "bundle_ix int, pos long, id string, doc string"


def env(spark, *records, ix=0):
    return spark.createDataFrame([(ix, i, *r) for i, r in enumerate(records)], ENV)


def test_fingerprint(spark):
    assert bundles.fingerprint(env(spark)) == hashlib.sha256(b"").hexdigest()
    docs = {f"k{i}": json.dumps({"v": "é" * i}, ensure_ascii=False) for i in range(50)}
    want = hashlib.sha256("\n".join(docs[k] for k in sorted(docs)).encode()).hexdigest()
    assert bundles.fingerprint(env(spark, *reversed(docs.items()))) == want
    assert bundles.fingerprint(env(spark, ("k0", "old"), *docs.items())) == want
    trees = [bundles.tree_fingerprint(env(spark, *x)).first() for x in (docs.items(), reversed(docs.items()), list(docs.items())[1:])]
    assert trees[0] == trees[1] != trees[2] and bundles.tree_fingerprint(env(spark)).first().records == 0


def test_envelope_keys(spark):
    raw = spark.createDataFrame([('{"id": "b", "a": 1}', 1), ('{"slug": "s"}', 2), ('{"id": null}', 3), ("broken", 4), (None, 5)], "doc string, pos long")
    assert rows(bundles.envelope(raw, doc="doc", position="pos"), "id", "doc") == [("", '{"slug":"s"}'), ("None", '{"id":null}'), ("b", '{"a":1,"id":"b"}')]
    assert ("s", '{"slug":"s"}') in rows(bundles.envelope(raw, doc="doc", position="pos", id_field="slug"), "id", "doc")


def test_diff_and_sets(spark):
    a, b = env(spark, ("1", "x"), ("2", "old"), ("2", "y"), ("3", "z"), (None, "n")), env(spark, ("2", "y"), ("3", "Z"), ("4", "w"))
    assert rows(bundles.diff(a, b), "id", "status") == [("", "removed"), ("1", "removed"), ("2", "unchanged"), ("3", "changed"), ("4", "added")]
    assert rows(bundles.intersect(a, b)) == [("2", "y"), ("3", "z")] and rows(bundles.subtract(a, b), "id") == [("",), ("1",)]
    assert bundles.union(a, b).count() == 8 and bundles.diff(a.limit(0), b.limit(0)).count() == 0


def test_merge(spark):
    both = env(spark, ("a", "1"), ("b", "x"), ("a", "2"), ("a", "2")).unionByName(env(spark, ("a", "3"), ("b", "x"), ("c", "q"), ix=1))
    last = bundles.merge(both)
    assert rows(last.records) == [("a", "3"), ("b", "x"), ("c", "q")]
    assert rows(bundles.merge(both, prefer="first").records)[0] == ("a", "2")
    assert [(r.id, [v.doc for v in r.variants]) for r in last.conflicts.collect()] == [("a", ["2", "3"])]
    assert rows(bundles.in_order(last.duplicate_ids)) == [(1, "a")]
    with pytest.raises(ValueError, match="conflict"):
        bundles.merge(both, prefer="raise")
    with pytest.raises(ValueError, match="prefer"):
        bundles.merge(both, prefer="odd")
    assert bundles.merge(both.where("id = 'b'"), prefer="raise").records.count() == 1
    assert bundles.merge(env(spark)).records.count() == 0


def test_resolutions(spark):
    found = spark.createDataFrame([("c", [(0, '{"id": "r0", "a": 1, "b": null}'), (1, '{"id": "r1", "a": null, "c": 2}')])], "id string, variants array<struct<bundle_ix int, doc string>>")

    def resolve(choice, by="me", why="long enough reason"):
        return conflicts.resolve(found, choice=F.lit(choice), resolved_by=F.lit(by), rationale=F.lit(why), resolved_at=F.lit("2025-01-01T00:00:00Z")).first()

    assert (resolve("1").chosen_version_index, resolve("1").rejected_record_ids) == (1, ["r0"])
    assert json.loads(resolve("merge").chosen_record) == {"a": None, "b": None, "c": 2, "id": "c"} and resolve("merge").rejected_record_ids == ["r0", "r1"]
    assert resolve("split").chosen_record is None and resolve("split").error is None
    assert all(r.error for r in (resolve("7"), resolve("-1"), resolve("odd"), resolve("0", by=" "), resolve("0", why="short")))
    assert resolve("0").id.startswith("confres_") and resolve("0").id == resolve("0").id


def test_migration(spark):
    m = migrate.Migrator()
    rename = lambda d: d.withColumn("c", F.col("b")) if "b" in d.columns else d
    m.register(migrate.Step("1.0.0", "1.0.5", lambda d: d.withColumn("b", F.lit("new"))))
    m.register(migrate.Step("1.0.5", "1.1.0", rename))
    with pytest.raises(ValueError):
        m.register(migrate.Step("1.0.0", "1.0.5", rename))
    assert m.has_path("1.0.0", "1.1.0") and not m.has_path("1.1.0", "1.0.0") and m.find_path("1.1.0", "1.1.0") == []
    data = spark.createDataFrame([("a", None), ("b", "1.0.5"), ("c", "1.1.0")], "id string, schema_version string")
    assert rows(m.migrate(data, "1.1.0"), "id", "schema_version", "migrated_from", "b") == [("a", "1.1.0", "1.0.0", "new"), ("b", "1.1.0", "1.0.5", None), ("c", "1.1.0", "1.1.0", None)]
    for bad in ("2.0.0", ""):
        with pytest.raises(ValueError):
            m.migrate(data, bad)
    assert m.migrate(data.limit(0), "1.1.0").count() == 0


def test_reducer(spark):
    data = [("c1", ["s1"], "high", "2024-12-01T00:00:00Z", "claim"), ("c2", [], "high", "2024-12-01T00:00:00Z", "claim"), ("c3", ["gone"], "low", "x", "claim"), ("c4", ["s1"], "low", "2024-12-01T00:00:00Z", "task"), ("c5", ["s1"], "medium", "2020-12-01T00:00:00Z", "task"), ("c6", ["s1"], "odd", None, "task"), ("c1", ["s1"], "high", "2024-12-01T00:00:00Z", "claim")]
    df = spark.createDataFrame(data, "id string, evidence_span_ids array<string>, confidence string, extracted_at string, candidate_type string").withColumns({c: F.lit("x") for c in ("subject", "claim_text", "natural_language_summary", "claim_scope")})
    now = F.lit("2025-01-01T00:00:00Z").cast("timestamp")
    judged = judge(df, spark.createDataFrame([("s1",)], "id string"), now=now)
    assert rows(judged, "id", "reason") == [("c1", None), ("c2", "no_evidence"), ("c3", "no_evidence"), ("c4", "low_confidence"), ("c5", "stale"), ("c6", "low_confidence")]
    made = promote(judged, now=now).collect()
    assert len(made) == 1 and made[0].entry_id.startswith("fact_") and made[0].decision_id.startswith("redmem_")


def test_policies():
    for bad in ({"max_records": -1}, {"strategy": "odd"}):
        with pytest.raises(ValueError):
            Policy(**bad)


def test_migration_names_the_record_that_has_no_path(spark):
    m = migrate.default_migrator()
    data = spark.createDataFrame([("a", "1.0.0"), ("b", None), ("c", "1.1.0"), ("odd", "0.9.0")], "id string, schema_version string")
    with pytest.raises(Exception, match="record odd: no path from 0.9.0 to 1.1.0"):
        m.migrate(data, "1.1.0").collect()
    fine = m.migrate(data.where("id <> 'odd'"), "1.1.0")
    assert rows(m.steps_applied(fine)) == [("1.0.0", "1.1.0", 2)]
    assert rows(migrate.upgraded(data), "id", "schema_version", "freshness_score") == [("a", "1.1.0", None), ("b", "1.1.0", None), ("c", "1.1.0", None), ("odd", "0.9.0", None)]

    def broken(_):
        raise KeyError("x")

    bad = migrate.Migrator([migrate.Step("1.0.0", "2.0.0", broken)])
    with pytest.raises(ValueError, match="step from 1.0.0 to 2.0.0"):
        bad.migrate(data, "2.0.0")
