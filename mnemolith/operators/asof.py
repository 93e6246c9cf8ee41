"""Attributes as known at event time (problem 1).

Changes are bitemporal: `known_at` says when a version arrived, `rank_by` which of the versions known
is the current one. Each event gets the version with the greatest `rank_by` (then the latest `known_at`)
among those of its entity that were known by the event's time.

Plan: what an event gets depends on its entity and time alone, so both sides are first reduced, on the map
side too, to one row per (entity, instant): changes of one instant to the best of them, events to the
instants asked for. These rows are range-partitioned by entity and time into blocks of bounded size, so an
entity with a third of all rows lies in many blocks and no block is cut by a number set beforehand. One
aggregation finds the best version per (entity, block), and a running maximum over the blocks of an entity
gives what each begins with. Changes and instants are then co-grouped by block, and inside a block one
vectorised binary search serves all its entities at once. The answers are joined back to the events.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ROWS_PER_GROUP, cut, groups_for

_NEVER = -(1 << 63)
_START = _NEVER + 1


def _search(asked: pd.DataFrame, changes: pd.DataFrame, versions: list[str]) -> pd.DataFrame:
    code = pd.factorize(pd.concat([asked["_key"], changes["_key"]]))[0].astype(np.int64)
    ev, ch = code[: len(asked)], code[len(asked) :]
    known = changes["_known"].to_numpy(np.int64)
    ties = [pd.factorize(changes[c].astype(object), sort=True)[0] for c in reversed(versions)]
    rank = np.empty(len(changes), np.int64)
    rank[np.lexsort([*ties, changes["_at"].to_numpy(np.int64), changes["_rank"].to_numpy(np.int64)])] = np.arange(len(changes))
    order = np.lexsort([rank, known, ch])
    ch, known, rank = ch[order], known[order], rank[order]
    best = np.maximum.accumulate(ch * max(1, len(changes)) + rank) - ch * max(1, len(changes))
    row_of_rank = np.empty(len(changes), np.int64)
    row_of_rank[rank] = order
    # One search over (entity, time): times are replaced by their place among all times of the block.
    at = asked["_known"].to_numpy(np.int64)
    times = np.unique(known)
    width = len(times) + 1
    hit = np.searchsorted(ch * width + np.searchsorted(times, known), ev * width + np.searchsorted(times, at, "right"), "left") - 1
    valid = hit >= 0
    valid[valid] = ch[hit[valid]] == ev[valid]
    out = asked[["_key", "_known"]][valid].reset_index(drop=True)
    found = changes[versions].take(row_of_rank[best[hit[valid]]]) if valid.any() else changes[versions].iloc[:0]
    for c in versions:
        out[c] = found[c].to_numpy(object)
    return out


def as_known_at(
    events: DataFrame,
    changes: DataFrame,
    *,
    entity: str,
    event_time: Column,
    known_at: Column,
    rank_by: Column,
    versions: Sequence[str],
    rows_per_block: int = ROWS_PER_GROUP,
) -> DataFrame:
    """`events` with `known_<c>` for each string column c of `versions`, and `is_known`.

    Nulls: an event without entity or time knows nothing (`is_known` false); a change without entity or
    `known_at` is never known; a null `rank_by` is the oldest. Versions equal in both times are decided
    by the greatest values of `versions`, in order. Repeated changes make no difference, repeated events
    come out as often as they came in. Columns of `changes` other than `versions` are not read, and columns
    of `events` that have the names of the result are replaced. Empty tables give no rows, or events of
    which nothing is known.
    """
    versions = list(versions)
    place = {c: f"v{i}" for i, c in enumerate(versions)}
    names = list(place.values())
    # Inside, the columns of events go by number, so that their names can't clash with ours.
    kept = [f.name for f in events.schema.fields if f.name not in {"is_known", *(f"known_{c}" for c in versions)}]
    ev = events.select(
        *[F.col(f"`{name}`").alias(f"e{i}") for i, name in enumerate(kept)], F.col(entity).cast("string").alias("_key"), F.unix_micros(event_time).alias("_known")
    )
    ch = changes.select(
        F.col(entity).cast("string").alias("_key"), F.unix_micros(known_at).alias("_known"), F.coalesce(F.unix_micros(rank_by), F.lit(_NEVER)).alias("_rank"), *[F.col(c).cast("string").alias(place[c]) for c in versions]
    ).where("_key is not null and _known is not null")
    latest = F.max(F.struct("_rank", *names)).alias("_best")
    once = ch.groupBy("_key", "_known").agg(latest).select("_key", "_known", F.lit(False).alias("_asked"), "_best")
    asked = ev.where("_key is not null and _known is not null").select("_key", "_known").distinct().select("_key", "_known", F.lit(True).alias("_asked"), F.lit(None).cast(once.schema["_best"].dataType).alias("_best"))
    both = cut(once.unionByName(asked))
    # Written once more, so that a task that runs again finds the same blocks.
    blocks = groups_for(both.count(), rows_per_block, least=2)
    both = cut(both.repartitionByRange(blocks, "_key", "_known").withColumn("_block", F.spark_partition_id()))

    changed = both.where("not _asked").select("_key", "_block", "_known", "_best")
    per_block = both.groupBy("_key", "_block").agg(F.max(F.when(~F.col("_asked"), F.struct("_best._rank", "_known", *[F.col(f"_best.{n}").alias(n) for n in names]))).alias("_b"))
    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.withColumn("_b", F.max("_b").over(before)).where("_b is not null")
    carried = carried.select("_key", "_block", F.lit(_START).alias("_known"), F.col("_b._known").alias("_at"), F.col("_b._rank").alias("_rank"), *[F.col(f"_b.{n}").alias(n) for n in names])
    sources = changed.select("_key", "_block", "_known", F.col("_known").alias("_at"), "_best._rank", *[F.col(f"_best.{n}").alias(n) for n in names]).unionByName(carried)

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, names)

    schema = ", ".join(["_key string, _known bigint", *[f"{n} string" for n in names]])
    # Both sides stem from one table; new names for its columns keep Spark from mixing them up.
    questions = both.where("_asked").select(*[F.col(c).alias(c) for c in ("_block", "_key", "_known")])
    found = questions.groupBy("_block").cogroup(sources.groupBy("_block")).applyInPandas(search, schema)
    joined = ev.join(found.withColumn("_hit", F.lit(True)), ["_key", "_known"], "left")
    return joined.select(*[F.col(f"e{i}").alias(name) for i, name in enumerate(kept)], *[F.col(n).alias(f"known_{c}") for c, n in place.items()], F.coalesce("_hit", F.lit(False)).alias("is_known"))
