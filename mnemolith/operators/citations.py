"""Citation graphs: claims cite evidence, evidence derives from sources."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


#: Edges that one task follows or peels on its own; more are handled in rounds over the cluster.
LOCAL_EDGES = 200_000


@dataclass(frozen=True)
class Graph:
    """nodes (id, kind, record_type); edges and dangling (from_id, to_id, relation)."""

    nodes: DataFrame
    edges: DataFrame
    dangling: DataFrame


def graph(sources: DataFrame, evidence: DataFrame, claims: DataFrame) -> Graph:
    """Graph of sources (id, record_type), evidence (id, record_type, source_id) and claims (id, record_type,
    evidence_ids, and evidence_id if they have it).

    Of several rows of one id one counts, claims before evidence before sources; the references of all are
    kept. References to null or to an empty id are none. Acyclic unless claims cite claims: see `cycles`.
    """
    kinds = [(claims, "claim", 2), (evidence, "evidence", 1), (sources, "source", 0)]
    named = None
    for rows, kind, rank in kinds:
        part = rows.where("id is not null").select("id", F.lit(kind).alias("kind"), F.col("record_type"), F.lit(rank).alias("rank"))
        named = part if named is None else named.unionByName(part)
    nodes = named.groupBy("id").agg(F.max(F.struct("rank", "kind", "record_type")).alias("n")).select("id", "n.kind", "n.record_type")
    cited = F.coalesce("evidence_ids", F.array().cast("array<string>"))
    if "evidence_id" in claims.columns:
        cited = F.array_append(cited, F.col("evidence_id"))
    refs = (
        evidence.select(F.col("id").alias("from_id"), F.col("source_id").alias("to_id"), F.lit("derives_from").alias("relation"))
        .unionByName(claims.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(cited)).alias("to_id"), F.lit("cites").alias("relation")))
        .where("from_id is not null and to_id is not null and to_id <> ''")
        .distinct()
    )
    ids = nodes.select(F.col("id").alias("to_id"))
    return Graph(nodes, refs.join(ids, "to_id", "left_semi").select(refs.columns), refs.join(ids, "to_id", "left_anti").select(refs.columns))


def held(g: Graph) -> Graph:
    """The same graph with its nodes and edges written once, for walks that read them again and again."""
    return Graph(cut(g.nodes), cut(g.edges), g.dangling)


def node_counts(g: Graph) -> DataFrame:
    """(kind, nodes) for all three kinds."""
    kinds = F.explode(F.array(*map(F.lit, ("source", "evidence", "claim"))))
    zero = g.nodes.sparkSession.range(1).select(kinds.alias("kind"), F.lit(0).cast("bigint").alias("n"))
    return g.nodes.select("kind", F.lit(1).cast("bigint").alias("n")).unionByName(zero).groupBy("kind").agg(F.sum("n").alias("nodes"))


def in_degree(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("in_degree"))


def _reach_all(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes from which one of the rows without `to_id` can be reached, in one task."""
    code, names = pd.factorize(pd.concat([pdf["from_id"], pdf["to_id"]]), use_na_sentinel=True)
    a, b = code[: len(pdf)], code[len(pdf) :]
    seen = np.zeros(len(names), bool)
    seen[a[b < 0]] = True
    a, b = a[b >= 0], b[b >= 0]
    while len(more := np.unique(a[seen[b] & ~seen[a]])):
        seen[more] = True
    return pd.DataFrame({"id": names[seen]})


def supported(g: Graph, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Ids of claims from which a path leads to a source, over however many edges."""
    steps = cut(g.edges.select("from_id", "to_id").distinct())
    sources, claims = g.nodes.where("kind = 'source'").select("id"), g.nodes.where("kind = 'claim'").select("id")
    if steps.count() <= local_edges:
        # A source that nothing refers to has nothing to tell.
        ends = sources.join(steps.select(F.col("to_id").alias("id")), "id", "left_semi").select(F.col("id").alias("from_id"), F.lit(None).cast("string").alias("to_id"))
        found = steps.unionByName(ends).groupBy(F.lit(0).alias("all")).applyInPandas(_reach_all, "id string")
        return found.join(claims, "id", "left_semi")
    front = cut(sources)
    seen = front
    while not front.isEmpty():
        front = steps.join(front.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
        front = cut(front.join(seen, "id", "left_anti"))
        # Fronts are disjoint and written, so their union needs no writing of its own.
        seen = seen.unionByName(front)
    return seen.join(claims, "id", "left_semi")


def unsupported_claims(g: Graph, claim: Column | None = None) -> DataFrame:
    """Claims without a path to a source; `claim` chooses among nodes, by default those of kind claim."""
    return g.nodes.where(F.col("kind") == "claim" if claim is None else claim).join(supported(g), "id", "left_anti").select("id")


def unused_sources(g: Graph, source: Column | None = None) -> DataFrame:
    """Sources that nothing refers to."""
    return g.nodes.where(F.col("kind") == "source" if source is None else source).join(g.edges.select(F.col("to_id").alias("id")), "id", "left_anti").select("id")


def paths(g: Graph, starts: DataFrame, *, direction: str = "forward", max_depth: int | None = None) -> DataFrame:
    """(start_id, path, relations, end_kind) from each start (id): walks along edges that end at a node
    without further edges, or after `max_depth` edges (None: however many).

    `direction` is forward (to sources), backward or both. A walk doesn't visit a node twice. Start ids that
    are no nodes give nothing.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must not be negative")
    ahead = g.edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), "relation")
    back = g.edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("next"), "relation")
    steps = {"forward": ahead, "backward": back, "both": ahead.unionByName(back)}.get(direction)
    if steps is None:
        raise ValueError(f"unknown direction: {direction!r}")
    # A step knows how many there are from its node, so that a walk that can only go back is told from one that goes on.
    kinds = g.nodes.select(F.col("id").alias("next"), F.col("kind").alias("next_kind"))
    degree = steps.groupBy("at").agg(F.count("*").alias("steps"))
    steps = cut(steps.join(kinds, "next").join(degree, "at"))
    none = F.array().cast("array<string>")
    front = g.nodes.join(starts.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("start_id"), F.col("id").alias("at"), F.array("id").alias("path"), none.alias("relations"), F.col("kind").alias("end_kind"))
    done, kept = None, ["start_id", "path", "relations", "end_kind"]
    # A walk is no longer than the nodes are many, so it ends.
    for depth in itertools.count():
        if max_depth is not None and depth >= max_depth:
            ended = front.select(*kept)
            return ended if done is None else done.unionByName(ended)
        fresh = F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))
        met = cut(front.join(steps, "at", "left").withColumn("goes_on", F.coalesce(fresh, F.lit(False))))
        back = met.where("not goes_on and next is not null").groupBy(*kept, "steps").agg(F.count("*").alias("n")).where("n = steps")
        ended = met.where("next is null").select(*kept).unionByName(back.select(*kept))
        done = ended if done is None else done.unionByName(ended)
        front = met.where("goes_on").select("start_id", F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"), F.array_append("relations", F.col("relation")).alias("relations"), F.col("next_kind").alias("end_kind"))
        if front.isEmpty():
            return done


def reached(g: Graph, starts: DataFrame, *, direction: str = "forward", max_depth: int | None = None) -> DataFrame:
    """(start_id, id): where the walks from each start end; backward gives predecessors, forward descendants."""
    found = paths(g, starts, direction=direction, max_depth=max_depth)
    return found.select("start_id", F.element_at("path", -1).alias("id")).distinct()


def nodes_named(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, kind, record_type) of the nodes among the ids; ids without a row are no nodes."""
    return g.nodes.join(ids.select("id").distinct(), "id", "left_semi")


def shortest_paths(g: Graph, pairs: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(source_id, target_id, path) along edges, the least by ids among equally short ones; no row if none.

    `pairs` has source_id and target_id; a node is its own path. All targets of a source are looked for at
    once: the frontier keeps one path per (source, node), and a source whose targets are found goes no further.
    """
    steps = cut(g.edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next")).distinct())
    known = g.nodes.select(F.col("id"))
    pairs = cut(pairs.select("source_id", "target_id").distinct().join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi"))
    front = pairs.select("source_id").distinct().select("source_id", F.col("source_id").alias("at"), F.array("source_id").alias("path"))
    seen = found = None
    for depth in itertools.count():
        front = cut(front)
        hit = front.join(pairs.withColumnRenamed("target_id", "at"), ["source_id", "at"]).select("source_id", F.col("at").alias("target_id"), "path")
        found = hit if found is None else found.unionByName(hit)
        seen = front.select("source_id", "at") if seen is None else seen.unionByName(front.select("source_id", "at"))
        if front.isEmpty() or (max_depth is not None and depth >= max_depth):
            return found
        open_ = pairs.join(found.select("source_id", "target_id"), ["source_id", "target_id"], "left_anti").select("source_id").distinct()
        grown = front.join(open_, "source_id", "left_semi").join(steps, "at").groupBy("source_id", "next").agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        front = grown.select("source_id", F.col("next").alias("at"), "path").join(seen, ["source_id", "at"], "left_anti")


def _peel_all(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes left after peeling, in one task, all that have no edge in or none out."""
    code, names = pd.factorize(pd.concat([pdf["from_id"], pdf["to_id"]]), use_na_sentinel=False)
    a, b = code[: len(pdf)], code[len(pdf) :]
    left = len(a) + 1
    while len(a) < left:
        left = len(a)
        enters, leaves = np.bincount(b, minlength=len(names)) > 0, np.bincount(a, minlength=len(names)) > 0
        kept = enters[a] & leaves[b]
        a, b = a[kept], b[kept]
    return pd.DataFrame({"id": names[np.unique(a)]})


def cycles(g: Graph, *, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Ids of nodes on a cycle or between two: what is left after peeling nodes without edges in or out.

    Edges of all kinds count, so a cycle may lead through claims, evidence and sources.
    """
    left, before = cut(g.edges.select("from_id", "to_id").distinct()), -1
    while (n := left.count()) > local_edges and n != before:
        before = n
        left = left.join(left.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi")
        left = cut(left.join(left.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi"))
    if n > local_edges:
        return left.select(F.col("from_id").alias("id")).distinct()
    return left.groupBy(F.lit(0).alias("all")).applyInPandas(_peel_all, "id string")
