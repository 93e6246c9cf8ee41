from __future__ import annotations

from mnemolith.functions import jsonvalue
from mnemolith.operators.differences import differences
from tests.helpers import rows

DDL = "id string, doc string, pos long, side string"


def run(spark, left, right):
    frames = [spark.createDataFrame(x, DDL) for x in (left, right)]
    return rows(differences(*frames, key="id", doc="doc", position="pos"), "id", "side", "field")


def test_fields_sides_and_spellings(spark):
    left = [("a", '{"x": 1, "y": [1, 2], "s": "\\u00e9", "o": {"p": 1, "q": null}}', 1, ""), ("only", "{}", 1, ""), ("b", '{"k": null}', 1, ""), ("c", '{"v": 1}', 1, ""), ("c", '{"v": 2}', 5, "")]
    right = [("a", '{"o":{"q":null,"p":1.0e0},"s":"é","y":[2,1],"x":1.0}', 9, ""), ("b", "{}", 1, ""), ("c", '{"v": 2}', 1, ""), ("new", None, 1, "")]
    assert run(spark, left, right) == [("a", "both", "y"), ("b", "both", "k"), ("new", "only_1", ""), ("only", "only_0", "")]


def test_types_texts_and_bad_documents(spark):
    left = [("t", '{"a": 1, "b": true, "c": "x ", "d": 0}', 1, ""), ("bad", "[1]", 1, ""), ("same", "no json", 1, ""), (None, "{}", 1, "")]
    right = [("t", '{"a": "1", "b": 1, "c": "x", "d": -0.0}', 1, ""), ("bad", "[2]", 1, ""), ("same", "no json", 2, ""), (None, '{"x":1}', 1, "")]
    assert run(spark, left, right) == [("bad", "both", "$"), ("t", "both", "a"), ("t", "both", "b"), ("t", "both", "c")]


def test_empty(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [("a", "{}", 1, "")]) == [("a", "only_1", "")]


def test_numbers():
    same = lambda *texts: len({jsonvalue.canonical(jsonvalue.parse(t)) for t in texts}) == 1
    assert same("100", "1e2", "100.0", "1.00E+2")
    assert same("0", "-0", "0.0", "-0e9")
    assert same("123456789012345678901234567890", "1.2345678901234567890123456789e29")
    assert not same("0.1", "0.10000000000000001")
    assert jsonvalue.parse_object('{"a": NaN}') is None and jsonvalue.parse_object(None) is None
    assert jsonvalue.parse_object('{"a": 1, "a": 2}') == {"a": "\0002"}
