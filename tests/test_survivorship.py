from __future__ import annotations

from pyspark.sql import functions as F

from mnemolith.operators.survivorship import survivors, truths
from tests.helpers import rows

DDL = "g string, r string, ts long, trust int, a string, b string, record string, value string"


def run(spark, data):
    found = survivors(spark.createDataFrame(data, DDL), group="g", record="r", fields=["a", "b"], latest=[F.col("ts"), F.col("trust")])
    return rows(found, "g", "field_name", "r", "value")


def test_order_of_preference(spark):
    data = [
        ("g", "r1", 5, 1, "old", "kept", "", ""),
        ("g", "r2", 9, 1, "new", " N/A ", "", ""),
        ("g", "r3", None, 9, "undated", "unknown", "", ""),
        ("t", "r9", 1, 2, "low", None, "", ""),
        ("t", "r8", 1, 3, "z", "?", "", ""),
        ("t", "r7", 1, 3, "high", "-", "", ""),
        ("t", "r7", 1, 3, "high", "-", "", ""),
        (None, "r1", 1, 1, "x", "x", "", ""),
    ]
    assert run(spark, data) == [("g", "a", "r2", "new"), ("g", "b", "r1", "kept"), ("t", "a", "r7", "high")]


def test_nulls_only_and_empty(spark):
    assert run(spark, [("g", None, None, None, "v", "", "", "")]) == [("g", "a", None, "v")]
    assert run(spark, []) == []


def test_truths_finds_the_source_that_errs(spark):
    data = [(f"g{i}", s, i if s != "bad" else -i) for i in range(40) for s in ("s1", "s2", "bad")]
    data = [(g, s, str(v), None) for g, s, v in data] + [("m", "s1", "one", None), ("m", "s2", "one", None), ("m", "s1", "two", None), ("m", "s2", "two", None)]
    facts, sources = truths(spark.createDataFrame(data, "g string, s string, a string, b string"), group="g", source="s", fields=["a", "b"])
    quality = {r.s: r for r in sources.collect()}
    assert quality["s1"].sensitivity > 0.9 > quality["bad"].sensitivity
    judged = {(r.g, r.value): r.is_true for r in facts.collect()}
    assert judged["g7", "7"] and not judged["g7", "-7"]
    assert judged["m", "one"] and judged["m", "two"]
    empty, none = truths(spark.createDataFrame([], "g string, s string, a string, b string"), group="g", source="s", fields=["a", "b"])
    assert not empty.collect() and not none.collect()
