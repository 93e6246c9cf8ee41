"""Parent-child links to full hierarchies (problem 6).

Bottom-up leaf peeling. In every round each leaf is peeled off and sends the size of its subtree to its
parent. Peeling alone takes a round per level, which a long chain makes hundreds, so a round also contracts
chains: a node with one child merges into that child where its hash is the least among itself, child and
parent. Both together leave a fixed share of the nodes at most, so rounds grow with the logarithm of the
number of nodes, whatever the depth, and all rounds together handle a few times as many rows as there are
nodes. What no round can peel has shrunk to nodes that are their own parent: each stands for a cycle.

In reverse peel order every round's nodes then get root and depth from the one node they were peeled
from. Once no more nodes are left than one task can well hold, that task peels the rest level by level.
Paths are built last: peeled nodes and what was merged into them are chains, a chain's path is one list,
and each node's path is a part of its chain's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Nodes that one task peels on its own; more are peeled in rounds over the cluster.
LOCAL_ROWS = 20_000

_PLACED = "id string, root_id string, depth bigint, below bigint, chain string, level int, above string"


def links(nodes: DataFrame, *, key: str, parents: str, children: str) -> DataFrame:
    """Distinct (parent, child) links that either side states, between keys that exist."""
    ids = nodes.select(F.col(key).alias("id")).where("id is not null").distinct()
    stated = (
        nodes.select(F.explode(parents).alias("parent"), F.col(key).alias("child"))
        .unionByName(nodes.select(F.col(key).alias("parent"), F.explode(children).alias("child")))
        .where("parent is not null and child is not null")
        .distinct()
    )
    return stated.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").join(ids.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")


def _round(going: DataFrame, peeled: DataFrame | None, number: int) -> DataFrame:
    """One round over nodes (id, ref, top, len, inner, hang): all of them with what became of each in `s`.

    `ref` is the parent; a node stands for a piece of chain that ends in it, from `top`, with `len` nodes;
    `inner` counts the nodes above its end and what hangs from those, `hang` what hangs from the end.
    s is `go` (still there), `leaf` (peeled) or `in` (merged into `ref`, with the rows from it to ref's end
    in `len` and what ref's piece adds below it in `hang`).
    """
    one = going.where("ref is not null").select(F.col("ref").alias("of"), F.col("id").alias("child"), F.lit(0).cast("bigint").alias("more"))
    if peeled is not None:
        # Leaves of the last round have sent their sizes, which arrive here.
        one = one.unionByName(peeled.where("s = 'leaf' and ref is not null").select(F.col("ref").alias("of"), F.lit(None).cast("string").alias("child"), (F.col("inner") + F.col("hang") + 1).alias("more")))
    kids = one.groupBy("of").agg(F.count("child").alias("n"), F.min("child").alias("child"), F.sum("more").alias("more"))
    h = lambda c: F.xxhash64(c, F.lit(number))
    single = (F.col("n") == 1) & (F.col("child") != F.col("id")) & (h(F.col("id")) < h(F.col("child"))) & (F.col("ref").isNull() | (h(F.col("id")) < h(F.col("ref"))))
    seen = going.join(kids, going["id"] == kids["of"], "left").select(
        "id", "ref", "top", "len", "inner", (F.col("hang") + F.coalesce("more", F.lit(0))).alias("hang"), F.coalesce("n", F.lit(0)).alias("n"), "child", F.coalesce(single, F.lit(False)).alias("merges")
    )
    merging = seen.where("merges").select(F.col("child").alias("id"), F.struct("id", "ref", "top", "len", "inner", "hang").alias("m"))
    met = seen.where("not merges").join(merging, "id", "left")
    m = F.col("m")
    row = lambda s, key, ref, top, size, inner, hang: F.struct(F.lit(s).alias("s"), key.alias("id"), ref.alias("ref"), top.alias("top"), size.alias("len"), inner.alias("inner"), hang.alias("hang"))
    c = F.col
    grown = row("go", c("id"), m["ref"], m["top"], c("len") + m["len"], c("inner") + m["inner"] + m["hang"] + 1, c("hang"))
    gone = row("in", m["id"], c("id"), m["top"], c("len"), c("inner"), m["hang"] + c("inner") + 1)
    leaf = row("leaf", c("id"), c("ref"), c("top"), c("len"), c("inner"), c("hang"))
    stays = row("go", c("id"), c("ref"), c("top"), c("len"), c("inner"), c("hang"))
    became = F.when(m.isNotNull(), F.array(grown, gone)).when(c("n") == 0, F.array(leaf)).otherwise(F.array(stays))
    return met.select(F.explode(became).alias("r")).select("r.*")


def _peel_all(pdf: pd.DataFrame) -> pd.DataFrame:
    """All levels of the nodes that are left, in one task; rows with `s` leaf only bring the sizes of peeled leaves."""
    sent = pdf["s"].to_numpy() == "leaf"
    nodes = pdf[~sent].reset_index(drop=True)
    index = pd.Index(nodes["id"])
    parent = index.get_indexer(nodes["ref"].where(nodes["ref"].notna(), "\0"))
    parent[nodes["ref"].isna()] = -1
    size, inner, hang = (nodes[c].to_numpy(np.int64).copy() for c in ("len", "inner", "hang"))
    late = pdf[sent & pdf["ref"].notna().to_numpy()]
    np.add.at(hang, index.get_indexer(late["ref"]), (late["inner"] + late["hang"] + 1).to_numpy(np.int64))
    children = np.bincount(parent[parent >= 0], minlength=len(nodes))
    heavy, most = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
    order, leaves = [], np.flatnonzero(children == 0)
    while len(leaves):
        order.append(leaves)
        up = parent[leaves]
        inside = up >= 0
        at, below = up[inside], (inner + hang + 1)[leaves[inside]]
        np.add.at(hang, at, below)
        np.subtract.at(children, at, 1)
        # The child with most below it goes on with its parent's chain.
        rank = np.lexsort([below])
        wins = below[rank] >= most[at[rank]]
        heavy[at[rank][wins]], most[at[rank][wins]] = leaves[inside][rank][wins], below[rank][wins]
        leaves = np.unique(at[children[at] == 0])
    depth, level = np.full(len(nodes), -1, np.int64), np.full(len(nodes), -1, np.int64)
    root, chain, above = (np.full(len(nodes), None, object) for _ in range(3))
    root[:] = ""
    keys, tops = nodes["id"].to_numpy(object), nodes["top"].to_numpy(object)
    for peeled in reversed(order):
        up = parent[peeled]
        first = peeled[up < 0]
        depth[first], root[first], chain[first], level[first] = size[first] - 1, tops[first], keys[first], 0
        rest, up = peeled[up >= 0], up[up >= 0]
        fine = depth[up] >= 0
        rest, up = rest[fine], up[fine]
        depth[rest], root[rest] = depth[up] + size[rest], root[up]
        goes_on = heavy[up] == rest
        chain[rest] = np.where(goes_on, chain[up], keys[rest])
        above[rest] = np.where(goes_on, None, chain[up])
        level[rest] = level[up] + ~goes_on
    out = pd.DataFrame({"id": keys, "root_id": root, "depth": depth, "below": pd.array(hang, "Int64"), "chain": chain, "level": level.astype(np.int32), "above": above})
    out.loc[depth < 0, "below"] = pd.NA
    return out


def _placed(tree: DataFrame, local_rows: int) -> list[DataFrame]:
    """(id, root_id, depth, below, chain, level, above) of all nodes (id, ref), in parts."""
    going = tree.select("id", "ref", F.col("id").alias("top"), F.lit(1).cast("bigint").alias("len"), F.lit(0).cast("bigint").alias("inner"), F.lit(0).cast("bigint").alias("hang"))
    going, peeled = cut(going.withColumn("s", F.lit("go"))), None
    rounds: list[DataFrame] = []
    while (left := going.where("ref is null or ref <> id").count()) > local_rows:
        became = cut(_round(going.drop("s"), peeled, len(rounds)))
        going, peeled = became.where("s = 'go'"), became.where("s <> 'go'")
        rounds.append(peeled)
    loops = going if left == 0 else going.where("ref = id")
    none = F.lit(None).cast("string")
    looped = loops.select("id", F.lit("").alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("below"), none.alias("chain"), F.lit(-1).alias("level"), none.alias("above"))
    parts = [looped]
    if left:
        rest = going.where("ref is null or ref <> id")
        # What hangs from a loop, and so has a parent that isn't here, comes with it.
        rest = rest.unionByName(going.where("ref = id").join(rest.select(F.col("ref").alias("id")).distinct(), "id", "left_semi"))
        if peeled is not None:
            rest = rest.unionByName(peeled.where("s = 'leaf'").join(rest.select(F.col("id").alias("ref")), "ref", "left_semi").select(*rest.columns))
        found = rest.groupBy(F.lit(0).alias("all")).applyInPandas(_peel_all, _PLACED)
        parts = [cut(found), looped.join(rest.where("s = 'go'").select("id"), "id", "left_anti")]
    for peeled in reversed(rounds):
        known = parts[0]
        for part in parts[1:]:
            known = known.unionByName(part)
        p = F.col("p")
        joined = peeled.join(known.select(F.col("id").alias("ref"), F.struct("root_id", "depth", "below", "chain", "level").alias("p")), "ref", "left")
        fine, first, merged = F.coalesce(p["depth"] >= 0, F.lit(False)), F.col("ref").isNull(), F.col("s") == "in"
        parts.append(
            cut(
                joined.select(
                    "id",
                    F.when(first, F.col("top")).otherwise(p["root_id"]).alias("root_id"),
                    F.when(first, F.col("len") - 1).when(~fine, -1).when(merged, p["depth"] - F.col("len")).otherwise(p["depth"] + F.col("len")).alias("depth"),
                    F.when(~first & ~fine, None).when(merged, p["below"] + F.col("hang")).otherwise(F.col("hang")).alias("below"),
                    F.when(first, F.col("id")).when(~fine, None).when(merged, p["chain"]).otherwise(F.col("id")).alias("chain"),
                    F.when(first, 0).when(~fine, -1).when(merged, p["level"]).otherwise(p["level"] + 1).cast("int").alias("level"),
                    F.when(~first & fine & ~merged, p["chain"]).alias("above"),
                )
            )
        )
    return parts


def hierarchy(edges: DataFrame, *, paths: bool = False, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(id, root_id, depth, descendants[, path]) for each node of the (parent, child) links.

    Roots have depth 0; `descendants` counts all nodes below; `path` runs from the root to the node.
    Nodes on a cycle or below one have root_id '', depth -1, no descendants count and no path. Should a
    child have several parents, the smallest counts (the others are no tree links). Null ends are left out.
    All descendants of a node are the nodes whose path contains it: see `descendants`. `local_rows` nodes
    at most are peeled by one task.
    """
    real = edges.where("parent is not null and child is not null")
    stated = real.select(F.col("child").alias("id"), F.col("parent").alias("ref")).unionByName(real.select(F.col("parent").alias("id"), F.lit(None).cast("string").alias("ref")))
    parts = _placed(stated.groupBy("id").agg(F.min("ref").alias("ref")), local_rows)
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    if not paths:
        return nodes.select("id", "root_id", F.col("depth").cast("int").alias("depth"), F.col("below").alias("descendants"))
    # A chain is no longer than the longest of the paths that are asked for.
    chains = nodes.where("depth >= 0").groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("depth", "id", "below"))).alias("nodes"), F.max("above").alias("above"), F.max("level").alias("level"), F.max("root_id").alias("root_id"))
    chains, done, whole = cut(chains), None, None
    for level in range((chains.agg(F.max("level")).first()[0] or 0) + 1):
        mine = chains.where(F.col("level") == level)
        if whole is None:
            made = mine.select("chain", "root_id", "nodes", F.col("nodes.id").alias("path"))
        else:
            # The nodes before a chain are the first of the path of the chain above it.
            made = mine.join(whole.select(F.col("chain").alias("above"), F.col("path").alias("before")), "above").select(
                "chain", "root_id", "nodes", F.concat(F.slice("before", F.lit(1), F.get("nodes.depth", F.lit(0)).cast("int")), "nodes.id").alias("path")
            )
        made = cut(made)
        whole = made if whole is None else whole.unionByName(made)
    each = whole.select("root_id", "path", F.explode("nodes").alias("n"))
    done = each.select(F.col("n.id").alias("id"), "root_id", F.col("n.depth").cast("int").alias("depth"), F.col("n.below").alias("descendants"), F.slice("path", F.lit(1), F.col("n.depth").cast("int") + 1).alias("path"))
    lost = nodes.where("depth < 0").select("id", "root_id", F.col("depth").cast("int").alias("depth"), F.col("below").alias("descendants"), F.lit(None).cast("array<string>").alias("path"))
    return done.unionByName(lost)


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant_id, distance): every entry below each entry, from a hierarchy with paths.

    One row per link of the closure, made by exploding each node's own path: no join, and no row ever
    holds the descendants of a big root.
    """
    return (
        tree.where("depth > 0")
        .select(F.col("id").alias("descendant_id"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "id"))
        .select("id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
    )
