from __future__ import annotations

import random

import pytest

from mnemolith.operators.hierarchy import descendants, hierarchy, links
from tests.helpers import rows


def brute(edges):
    parent: dict = {}
    for p, c in edges:
        if None not in (p, c):
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in {x for p, c in edges if None not in (p, c) for x in (p, c)}:
        path, at = [n], n
        while at in parent and len(path) <= len(parent) + 1:
            at = parent[at]
            path.insert(0, at)
        out[n] = None if at in parent else path
    return out


def check(spark, edges, **options):
    want = brute(edges)
    tree = hierarchy(spark.createDataFrame(edges, "parent string, child string"), paths=True, **options).cache()
    got = {r.id: r for r in tree.collect()}
    assert got.keys() == want.keys()
    below = {n: sum(p is not None and n in p[:-1] for p in want.values()) for n in want}
    for n, path in want.items():
        if path is None:
            assert (got[n].root_id, got[n].depth, got[n].path, got[n].descendants) == ("", -1, None, None)
        else:
            assert (got[n].root_id, got[n].depth, got[n].path, got[n].descendants) == (path[0], len(path) - 1, path, below[n])
    pairs = sorted((a, p[-1], len(p) - 1 - i) for p in want.values() if p for i, a in enumerate(p[:-1]))
    assert rows(descendants(tree)) == sorted(pairs, key=repr)


def test_random_forest_with_loops(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 60) if rng.random() < 0.9]
    edges += [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("l3", "below"), ("below", "far below"), ("self", "self"), (None, "x"), ("x", None), ("n0", "n1"), ("n0", "n1")]
    check(spark, edges)


def test_long_chain_and_hot_root(spark):
    check(spark, [(f"c{i}", f"c{i + 1}") for i in range(37)] + [("c0", f"leaf{i}") for i in range(50)])


def test_empty(spark):
    check(spark, [])


def test_links_need_both_ends(spark):
    data = [("a", None, ["b", "gone", None]), ("b", ["a"], None), ("c", ["a"], []), ("c", ["a"], []), (None, ["a"], ["b"])]
    nodes = spark.createDataFrame(data, "id string, supersedes array<string>, superseded_by array<string>")
    assert rows(links(nodes, key="id", parents="supersedes", children="superseded_by")) == [("a", "b"), ("a", "c")]


@pytest.mark.parametrize("local_rows", [0, 25])
def test_rounds_over_the_cluster(spark, local_rows):
    rng = random.Random(8)
    edges = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(f"n{rng.randrange(i)}", f"n{i}") for i in range(1, 50) if rng.random() < 0.9]
    edges += [("c7", "n0"), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("l3", "d1"), ("d1", "d2"), ("d1", "d3"), ("self", "self"), ("self", "e1"), ("a", "b"), ("b", "a")]
    check(spark, edges, local_rows=local_rows)


def test_peeling_agrees_with_depths_and_paths_left_out(spark):
    edges = spark.createDataFrame([("r", "x"), ("x", "y"), ("x", "z"), ("o", "o")], "parent string, child string")
    assert rows(hierarchy(edges, local_rows=0)) == [("o", "", -1, None), ("r", "r", 0, 3), ("x", "r", 1, 2), ("y", "r", 2, 0), ("z", "r", 2, 0)]
