from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mnemolith.operators import citations, hygiene, integrity
from tests.helpers import rows


def graph(spark, sources, spans, claims):
    return citations.graph(
        spark.createDataFrame([(s, "source_record") for s in sources], "id string, record_type string"),
        spark.createDataFrame([(i, "evidence_span", s) for i, s in spans], "id string, record_type string, source_id string"),
        spark.createDataFrame([(i, "fact_ledger_entry", r) for i, r in claims], "id string, record_type string, evidence_ids array<string>"),
    )


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_linear_diamond_and_disconnected(spark):
    g = graph(spark, ["s", "lonely"], [("e1", "s"), ("e2", "s"), ("e3", "none")], [("f", ["e1", "e2", "e1", None]), ("bad", ["gone"]), ("direct", ["s"]), ("weak", ["e3"]), ("empty", None)])
    assert ids(citations.unsupported_claims(g)) == ["bad", "empty", "weak"]
    assert ids(citations.unused_sources(g)) == ["lonely"]
    assert rows(g.dangling) == [("bad", "gone", "cites"), ("e3", "none", "derives_from")]
    found = rows(citations.paths(g, g.nodes.where("id in ('f', 'direct', 'bad')")), "start_id", "path", "end_kind")
    assert found == sorted([("f", ["f", "e1", "s"], "source"), ("f", ["f", "e2", "s"], "source"), ("direct", ["direct", "s"], "source"), ("bad", ["bad"], "claim")], key=repr)
    assert rows(citations.node_counts(g)) == [("claim", 5), ("evidence", 3), ("source", 2)]
    assert dict(rows(citations.in_degree(g)))["s"] == 3
    back = rows(citations.paths(g, g.nodes.where("id = 's'"), direction="backward"), "path")
    assert (["s", "e1", "f"],) in back and (["s", "direct"],) in back
    assert rows(citations.paths(g, g.nodes.where("id = 'f'"), max_depth=0), "path") == [(["f"],)]
    both = rows(citations.paths(g, g.nodes.where("id = 'e1'"), direction="both", max_depth=1), "path")
    assert both == [(["e1", "f"],), (["e1", "s"],)]
    for bad in ({"max_depth": -1}, {"direction": "odd"}):
        with pytest.raises(ValueError):
            citations.paths(g, g.nodes, **bad)
    pairs = spark.createDataFrame([("f", "s"), ("f", "f"), ("f", "lonely"), ("nowhere", "s")], "source_id string, target_id string")
    assert rows(citations.shortest_paths(g, pairs), "source_id", "target_id", "path") == [("f", "f", ["f"]), ("f", "s", ["f", "e1", "s"])]
    assert ids(citations.cycles(g)) == []


def test_claims_that_cite_claims_reach_their_sources(spark):
    chain = [(f"c{i}", [f"c{i + 1}"]) for i in range(9)] + [("c9", ["e"])]
    g = graph(spark, ["s"], [("e", "s")], [*chain, ("x", ["y"]), ("y", ["x"])])
    assert ids(citations.unsupported_claims(g)) == ["x", "y"]
    assert ids(citations.supported(g, local_edges=0)) == ids(citations.supported(g)) == [f"c{i}" for i in range(10)]
    whole = [*[f"c{i}" for i in range(10)], "e", "s"]
    start = g.nodes.where("id = 'c0'")
    assert rows(citations.paths(g, start), "path") == [(whole,)] and rows(citations.reached(g, start)) == [("c0", "s")]
    pairs = spark.createDataFrame([("c0", "s")], "source_id string, target_id string")
    assert rows(citations.shortest_paths(g, pairs), "path") == [(whole,)]


def test_cycles_and_empty(spark):
    g = graph(spark, [], [], [("a", ["b"]), ("b", ["c"]), ("c", ["a"]), ("tail", ["a"]), ("self", ["self"])])
    assert ids(citations.cycles(g)) == ["a", "b", "c", "self"]
    none = graph(spark, [], [], [])
    assert ids(none.nodes) == ids(citations.unsupported_claims(none)) == ids(citations.cycles(none)) == []


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_cycles_across_kinds_and_dangling_refs(spark, local_edges):
    # A span whose source is a claim that cites the span, and a bridge between two cycles.
    g = graph(spark, ["s"], [("e", "c"), ("e2", "s")], [("c", ["e", "lost"]), ("out", ["c"]), ("p", ["q"]), ("q", ["p", "bridge"]), ("bridge", ["c"]), ("fine", ["e2", ""])])
    assert ids(citations.cycles(g, local_edges=local_edges)) == ["bridge", "c", "e", "p", "q"]
    assert rows(g.dangling) == [("c", "lost", "cites")]


def test_long_chains_are_walked_whole(spark):
    g = graph(spark, ["s"], [("e", "s")], [(f"c{i:02d}", [f"c{i + 1:02d}"]) for i in range(40)] + [("c40", ["e"])])
    whole = [f"c{i:02d}" for i in range(41)] + ["e", "s"]
    assert rows(citations.paths(g, g.nodes.where("id = 'c00'")), "path", "end_kind") == [(whole, "source")]
    pairs = spark.createDataFrame([("c00", "s"), ("c39", "s"), ("s", "c00")], "source_id string, target_id string")
    assert rows(citations.shortest_paths(g, pairs), "path") == [(whole,), (whole[39:],)]
    assert rows(citations.paths(g, g.nodes.where("id = 's'"), direction="backward", max_depth=3), "path") == [(["s", "e", "c40", "c39"],)]
    assert ids(citations.cycles(g)) == []


def test_walks_that_can_only_go_back_end(spark):
    g = graph(spark, [], [], [("a", ["b"]), ("b", ["a", "c"]), ("c", ["b"])])
    assert rows(citations.paths(g, g.nodes.where("id = 'a'")), "path") == [(["a", "b", "c"],)]
    assert rows(citations.paths(g, g.nodes.where("id = 'b'")), "path") == [(["b", "a"],), (["b", "c"],)]
    single = citations.graph(spark.createDataFrame([("s", "x")], "id string, record_type string"), spark.createDataFrame([], "id string, record_type string, source_id string"), spark.createDataFrame([("k", "x", None, "s")], "id string, record_type string, evidence_ids array<string>, evidence_id string"))
    assert rows(single.edges, "from_id", "to_id") == [("k", "s")]


def test_integrity(spark):
    spans = spark.createDataFrame([("p1", "s1", "e1"), ("p2", "s2", None)], "id string, source_id string, episode_id string")
    c = spark.createDataFrame([("c1", ["s1"], ["e9"], ["p1", "p2", "p9"], ["p2", "p7"]), ("c2", [], [], ["p2"], None), ("c2", None, None, ["p2"], None)], "id string, source_record_ids array<string>, episode_record_ids array<string>, evidence_span_ids array<string>, example_span_ids array<string>")
    sources = spark.createDataFrame([("s1",)], "id string")
    found = rows(integrity.candidate_bundle(sources, sources, spans, c))
    assert found == sorted(
        [("duplicate candidate", "c2", None), ("dangling evidence_span_ids", "c1", "p9"), ("dangling episode_record_ids", "c1", "e9"), ("span source not declared", "c1", "p2"), ("span episode not declared", "c1", "p1"), ("example_span_ids not within evidence_span_ids", "c1", "p7")], key=repr
    )
    states = spark.createDataFrame([("x", "g", "2025-01-01T00:00:00Z", None, None, ["f"]), ("y", "g", "2025-02-01T00:00:00Z", None, None, ["lost"])], "id string, project string, valid_from string, valid_until string, stale_after string, active_fact_ids array<string>")
    assert rows(integrity.state_bundle(states, group="project", trusted=spark.createDataFrame([("f",)], "id string"))) == [("dangling active_fact_ids", "y", "lost"), ("periods overlap", "y", "x")]


def test_hygiene(spark):
    data = [
        ("fact_a", "fact", "2026-01-01T00:00:00Z", None, None, [], ["span_1"]),
        ("pref_b", "preference", "2026-01-01T00:00:00Z", "2026-12-01T00:00:00Z", "2026-02-01T00:00:00Z", None, ["span_9"]),
        ("dec_c", "decision", "2026-01-01T00:00:00Z", "2026-03-01T00:00:00Z", None, ["x"], []),
        ("span_1", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "id string, ledger_type string, valid_from string, valid_until string, stale_after string, superseded_by array<string>, evidence_span_ids array<string>")
    report = hygiene.report(df, df, now=F.lit("2026-06-15T12:00:00Z").cast("timestamp"))
    assert report.counts == {"records": 4, "active": 3, "stale": 1, "expired": 1, "superseded": 1}
    assert (report.missing_evidence, report.orphaned_evidence) == (1, 1)
    assert report.by["plane"] == {"ledger": 3, "evidence": 1} and report.by["type"] == {"fact": 1, "preference": 1, "decision": 1}
    assert (report.window_start, report.window_end) == ("2026-01-01T00:00:00Z", "2026-12-01T00:00:00Z")
    assert "| ledger | 3 |" in report.markdown() and "By privacy" not in report.markdown()
    assert hygiene.report(df.limit(0), df, now=F.current_timestamp()).counts["records"] == 0
