from __future__ import annotations

import itertools
import json
import random
from datetime import datetime, timedelta

import pytest

from mnemolith.functions import trees
from mnemolith.operators.drift import canonical_names, drift, edit_script, matching, unify
from tests.helpers import rows

T0 = datetime(2025, 1, 1)
DDL = "feed string, file string, exported timestamp, line int, doc string, id string"


def run(spark, data):
    df = spark.createDataFrame(data, DDL)
    return rows(drift(df, feed="feed", file="file", exported="exported", line="line", doc="doc"), "file", "change_kind", "old_field", "new_field")


def lines(file, day, docs):
    return [("f", file, T0 + timedelta(days=day), i, d if isinstance(d, str) else json.dumps(d), "clash") for i, d in enumerate(docs)]


def test_kinds_of_change(spark):
    old = [{"id": "1", "a": 1, "gone": 7, "o": {"m": "x", "n": 2}, "metadata": {"k": 1}, "t": "1"}, {"id": "2", "a": 2, "o": {"m": "y"}, "t": None}]
    new = [{"id": "1", "b": 1.0, "o": {"w": "x", "n": "2"}, "metadata": {"z": 1}, "t": 1, "fresh": None}, {"id": "2", "b": 2, "o": {"w": "y"}, "t": 5}, {"id": "3", "b": 7}, "[1]", "no json", ""]
    data = lines("z", 0, old) + lines("a", 1, new) + lines("a", 1, new)
    assert run(spark, data) == sorted([("a", "added", "", "fresh"), ("a", "removed", "gone", ""), ("a", "renamed", "a", "b"), ("a", "renamed", "o.m", "o.w"), ("a", "retyped", "o.n", "o.n"), ("a", "retyped", "t", "t")], key=repr)


def test_members_of_a_reported_field_are_not_reported(spark):
    data = lines("1", 0, [{"id": "1", "o": {"m": 1}, "p": {"q": 1}, "r": {"s": 1}}]) + lines("2", 1, [{"id": "1", "o2": {"m": 1}, "r": "text"}])
    assert run(spark, data) == sorted([("2", "renamed", "o", "o2"), ("2", "removed", "p", ""), ("2", "retyped", "r", "r")], key=repr)


def test_values_decide_on_renames(spark):
    nulls = lines("1", 0, [{"id": "1", "a": None}]) + lines("2", 1, [{"id": "1", "b": None}])
    assert run(spark, nulls) == [("2", "added", "", "b"), ("2", "removed", "a", "")]
    differs = lines("1", 0, [{"id": "1", "a": 1}, {"id": "2", "a": 2}]) + lines("2", 1, [{"id": "1", "b": 1}, {"id": "2", "b": 3}])
    assert run(spark, differs) == [("2", "added", "", "b"), ("2", "removed", "a", "")]
    apart = lines("1", 0, [{"id": "1", "a": 1}]) + lines("2", 1, [{"id": "9", "b": 1}])
    assert run(spark, apart) == [("2", "added", "", "b"), ("2", "removed", "a", "")]


def test_every_rename_that_values_allow_is_listed(spark):
    data = lines("1", 0, [{"id": "1", "a": 1, "c": 2}]) + lines("2", 1, [{"id": "1", "x": 1, "y": 1, "z": 3}])
    assert run(spark, data) == sorted([("2", "renamed", "a", "x"), ("2", "renamed", "a", "y"), ("2", "removed", "c", ""), ("2", "added", "", "z")], key=repr)
    df, names = spark.createDataFrame(data, DDL), {"feed": "feed", "file": "file", "exported": "exported", "line": "line", "doc": "doc"}
    one = rows(drift(df, **names, cheapest=True), "change_kind", "old_field", "new_field")
    assert one == [("added", "", "y"), ("added", "", "z"), ("removed", "c", ""), ("renamed", "a", "x")]


def test_any_depth_and_moves(spark):
    data = lines("1", 0, [{"id": "1", "o": {"p": {"q": 1, "r": "x"}, "s": True}, "t": [1]}]) + lines("2", 1, [{"id": "1", "o": {"p": {"q2": 1, "r": 5}, "t": [1]}, "s": True}])
    df, names = spark.createDataFrame(data, DDL), {"feed": "feed", "file": "file", "exported": "exported", "line": "line", "doc": "doc"}
    found = rows(drift(df, **names, depth=None, cheapest=True), "change_kind", "old_field", "new_field")
    assert found == [("moved", "o.s", "s"), ("moved", "t", "o.t"), ("renamed", "o.p.q", "o.p.q2"), ("retyped", "o.p.r", "o.p.r")]


def all_trees(depth, rng):
    names = rng.sample(["a", "b", "c", "d"], rng.randrange(4))
    return {n: (rng.choice([2, 4]), all_trees(depth - 1, rng) if depth and rng.random() < 0.5 else {}) for n in names}


def test_distance_is_the_least_over_all_assignments():
    """Against every way to pair gone with new nodes, at every level."""

    def brute(before, after, old, new, allowed):
        cost = 0.0
        for n in before.keys() & after.keys():
            cost += (trees.RETYPE if before[n][0] != after[n][0] else 0) + brute(before[n][1], after[n][1], (*old, n), (*new, n), allowed)
        gone, fresh = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
        best = float("inf")
        for targets in itertools.product([None, *fresh], repeat=len(gone)):
            taken = [t for t in targets if t]
            if len(set(taken)) < len(taken) or any(t and (old, g, t) not in allowed for g, t in zip(gone, targets, strict=True)):
                continue
            c = sum(1 + trees.size(after[n][1]) for n in fresh if n not in taken)
            for g, t in zip(gone, targets, strict=True):
                if t is None:
                    c += 1 + trees.size(before[g][1])
                else:
                    c += trees.RENAME + (trees.RETYPE if before[g][0] != after[t][0] else 0) + brute(before[g][1], after[t][1], (*old, g), (*new, t), allowed)
            best = min(best, c)
        return cost + best

    rng = random.Random(2)
    for _ in range(200):
        before, after = all_trees(2, rng), all_trees(2, rng)
        paths = [(), *[p for p, _ in trees._nodes(before, ())]]
        allowed = {(p, o, n): 1 for p in paths for o in "abcd" for n in "abcd" if rng.random() < 0.5}
        assert trees.distance(before, after, allowed, moves=False)[0] == pytest.approx(brute(before, after, (), (), allowed), abs=1e-3)


def test_the_last_record_of_a_repeated_id_is_compared(spark):
    data = lines("1", 0, [{"id": "1", "a": 9}, {"id": "1", "a": 1}]) + lines("2", 1, [{"id": "1", "b": 1}])
    assert run(spark, data) == [("2", "renamed", "a", "b")]


def test_empty_null_and_bad_files(spark):
    assert run(spark, []) == []
    data = [("f", "1", T0, 1, None, ""), ("f", "2", T0 + timedelta(days=1), 1, '{"id": "1", "a": 1}', ""), (None, None, None, None, "{}", "")]
    assert run(spark, data) == [("2", "added", "", "a")]


def test_against_brute_force(spark):
    rng = random.Random(11)
    data, want = [], []
    for feed in range(6):
        names, before = ["a", "b", "c", "d"], None
        for file in range(5):
            docs = {str(i): {n: f"{i}{names.index(n)}" if rng.random() < 0.9 else None for n in names if rng.random() < 0.8} for i in range(8)}
            data += [(f"f{feed}", f"f{feed}/{file}", T0 + timedelta(days=file), i, json.dumps({"id": k, **d}), "") for i, (k, d) in enumerate(docs.items())]
            if before is not None:
                old, new = ({n for d in x.values() for n in d} for x in (before, docs))
                gone, fresh = old - new, new - old
                pairs = []
                for o in gone:
                    for n in fresh:
                        values = [(before[k][o], docs[k][n]) for k in docs if o in before[k] and n in docs[k]]
                        if values and all(x == y for x, y in values) and any(x is not None for x, _ in values):
                            pairs.append((o, n, sum(x is not None for x, _ in values)))
                named = matching(pairs)
                want += [(f"f{feed}/{file}", "renamed", o, n) for o, n in named]
                want += [(f"f{feed}/{file}", "removed", o, "") for o in gone - {o for o, _ in named}] + [(f"f{feed}/{file}", "added", "", n) for n in fresh - {n for _, n in named}]
            before = docs
            if rng.random() < 0.6:
                names[rng.randrange(4)] = f"n{feed}{file}"
    assert run(spark, data) == sorted(want, key=repr)


def test_script_is_cheapest():
    assert sorted(matching([("a", "x", 5), ("b", "x", 1), ("a", "y", 1)])) == [("a", "y"), ("b", "x")]
    fields = [("", "o", "gone", 16, 0), ("o", "m", "gone", 1, 0), ("", "o2", "new", 0, 16), ("o2", "m", "new", 0, 1)]
    assert edit_script(fields, [("", "o", "o2", 3)]) == [("renamed", "o", "o2")]


def test_projection_follows_chains_of_renames(spark):
    scripts = spark.createDataFrame([("f", "2", "renamed", "a", "b"), ("f", "3", "renamed", "b", "c"), ("f", "4", "removed", "c", ""), ("f", "5", "added", "", "c")], "feed string, file string, change_kind string, old_field string, new_field string")
    files = spark.createDataFrame([("f", str(i), i) for i in range(1, 6)], "feed string, file string, ix int")
    assert rows(canonical_names(scripts, files)) == [("f", 2, "b", "a"), ("f", 3, "c", "a"), ("f", 4, None, None)]


def unified(spark, data, *columns):
    df, names = spark.createDataFrame(data, DDL), {"feed": "feed", "file": "file", "exported": "exported", "line": "line", "doc": "doc"}
    return rows(unify(df, drift(df, **names, cheapest=True), **names), "source_file", *columns)


def test_a_new_field_never_takes_the_place_of_a_renamed_one(spark):
    # a becomes b, then a new a is added and goes and comes back; a_2 is a field of its own all along.
    data = lines("1", 0, [{"id": "1", "a": 1, "a_2": 7}]) + lines("2", 1, [{"id": "1", "b": 1, "a_2": 7}]) + lines("3", 2, [{"id": "1", "b": 1, "a": 2, "a_2": 7}])
    data += lines("4", 3, [{"id": "1", "b": 1, "a_2": 7}]) + lines("5", 4, [{"id": "1", "a": 3, "b": 1, "a_2": 7}])
    want = [("1", "1", "7", None), ("2", "1", "7", None), ("3", "1", "7", "2"), ("4", "1", "7", None), ("5", "1", "7", "3")]
    assert unified(spark, data, "a", "a_2", "a_3") == want


def test_a_new_member_never_takes_the_place_of_a_renamed_one(spark):
    stages = [{"o": {"m": 1}}, {"o": {"w": 1}}, {"o": {"w": 1, "m": 2}}, {"p": {"w": 1, "m": 2}}, {"p": {"w": 1, "m": 2}, "o": {"w": 5, "m": 6}}]
    data = [x for i, s in enumerate(stages) for x in lines(str(i), i, [{"id": "1", **s}])]
    got = [(f, json.loads(o), o2 and json.loads(o2)) for f, o, o2 in unified(spark, data, "o", "o_2")]
    assert got == [("0", {"m": 1}, None), ("1", {"m": 1}, None), *[(f, {"m": 1, "m_2": 2}, None) for f in "23"], ("4", {"m": 1, "m_2": 2}, {"w": 5, "m": 6})]


def test_members_of_a_retyped_field_keep_their_values(spark):
    stages = [{"o": {"m": 1}}, {"o": {"w": 1}}, {"o": "text"}, {"o": {"w": 3, "m": 4}}]
    data = [x for i, s in enumerate(stages) for x in lines(str(i), i, [{"id": "1", **s}])]
    assert json.loads(unified(spark, data, "o")[3][1]) == {"w": 3, "m": 4}


def test_a_rename_back_goes_on_with_its_column(spark):
    data = lines("1", 0, [{"id": "1", "a": 1}]) + lines("2", 1, [{"id": "1", "b": 1}]) + lines("3", 2, [{"id": "1", "a": 1}])
    assert unified(spark, data, "a") == [("1", "1"), ("2", "1"), ("3", "1")]


def test_fields_beyond_the_columns_come_out_in_a_map(spark):
    data = lines("1", 0, [{"id": "1", **{f"f{i}": i for i in range(7)}}, {"id": "2", "f0": 0, "f1": None}])
    df, names = spark.createDataFrame(data, DDL), {"feed": "feed", "file": "file", "exported": "exported", "line": "line", "doc": "doc"}
    found = unify(df, drift(df, **names, cheapest=True), **names, most_columns=3)
    got = {r.id: r for r in found.collect()}
    assert found.columns == ["source_feed", "source_file", "source_line", "id", "f0", "f1", "f2", "more_fields"]
    assert (got["1"].f0, got["1"].f2, got["1"].more_fields) == ("0", "2", {"f3": "3", "f4": "4", "f5": "5", "f6": "6"})
    assert (got["2"].f0, got["2"].f1, got["2"].more_fields) == ("0", None, {})


def test_a_move_ends_one_field_and_begins_another(spark):
    data = lines("1", 0, [{"id": "1", "a": 5, "o": {"s": 1, "k": 2}}]) + lines("2", 1, [{"id": "1", "b": 5, "s": 1, "o": {"k": 2}}])
    got = [(f, a, s, json.loads(o)) for f, a, s, o in unified(spark, data, "a", "s", "o")]
    assert got == [("1", "5", None, {"s": 1, "k": 2}), ("2", "5", "1", {"k": 2})]
