"""Filling fixed-capacity containers with items (problem 8).

Only the histogram of lengths, which is no longer than the capacity, decides how packs look: lengths are
placed longest first, each into the shortest packs that have room, and packs that look alike are one
pattern with a count. Patterns are then joined back to items by their rank among items of equal length.
A length is exhausted within a pattern at most once, so there are at most three patterns per length: what
is broadcast depends on the capacity and not on the corpus.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, groups_for


@dataclass
class Plan:
    """Where the items of each length go: rank r >= `rank` of a length is in pack base + (r - rank) // copies."""

    capacity: int
    packs: int
    length: np.ndarray
    rank: np.ndarray
    base: np.ndarray
    copies: np.ndarray


def patterns(histogram: Mapping[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Shortest-pack-first: (how many items of which length, number of such packs)."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left = histogram[length]
        # Rooms only shrink while a length is placed, so one pass down finds the roomiest each time.
        space = max(room, default=-1)
        while left and space >= length:
            if space not in room:
                space -= 1
                continue
            packed, packs = room[space].pop()
            if not room[space]:
                del room[space]
            used = min(left, packs)
            left -= used
            if packs > used:
                room.setdefault(space, []).append((packed, packs - used))
            room.setdefault(space - length, []).append((packed | {length: packed.get(length, 0) + 1}, used))
        each = capacity // length
        for copies, packs in ((each, left // each), (left % each, 1)):
            if copies and packs:
                room.setdefault(capacity - copies * length, []).append(({length: copies}, packs))
    return [p for space in sorted(room) for p in room[space]]


def plan(histogram: Mapping[int, int], capacity: int) -> Plan:
    """The patterns as ranges of ranks per length."""
    rows, given, base = [], dict.fromkeys(histogram, 0), 0
    for packed, packs in patterns(histogram, capacity):
        for length, copies in packed.items():
            rows.append((length, given[length], base, copies))
            given[length] += packs * copies
        base += packs
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(capacity, base, *columns.T)


def _place(plans: dict[str, Plan]):
    def place(batches):
        for batch in batches:
            names = np.array(batch["container"].to_pylist(), object)
            tokens, rank = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tokens", "rank"))
            pack = np.zeros(len(names), np.int64)
            for name, p in plans.items():
                mine = np.flatnonzero(names == name)
                empty = mine[tokens[mine] == 0]
                # Items without tokens fit anywhere; they are spread over all packs.
                pack[empty] = rank[empty] % max(1, p.packs)
                some = mine[tokens[mine] > 0]
                if len(some):
                    wide = int(max(p.rank.max(), rank[some].max())) + 1
                    at = np.searchsorted(p.length * wide + p.rank, tokens[some] * wide + rank[some], "right") - 1
                    pack[some] = p.base[at] + (rank[some] - p.rank[at]) // p.copies[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack)], names=[*batch.schema.names, "pack"])

    return place


def packs(items: DataFrame, containers: Mapping[str, int], *, buckets: int | None = None) -> DataFrame:
    """(container, pack, item, piece, first_token, tokens) for `items` (item, tokens).

    An item longer than a container's capacity is cut into full pieces and a rest; no other item is cut.
    Packs are numbered from 0 per container. Items without tokens (or with null) lie in some pack with 0
    tokens. Repeated items are packed once per row. Without items, or for a capacity below 1, there are no
    packs.
    """
    containers = {name: int(size) for name, size in containers.items() if name is not None and size is not None and size >= 1}
    spark = items.sparkSession
    if not containers:
        return spark.createDataFrame([], "container string, pack bigint, item bigint, piece int, first_token bigint, tokens bigint")
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(s).cast("bigint").alias("size")) for n, s in containers.items()])
    whole = items.select("item", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("all"), F.explode(kinds).alias("c")).select("item", "all", "c.*")
    pieces = whole.select("item", "all", "container", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("all") / F.col("size")), F.lit(1)).cast("int") - 1)).alias("piece"))
    pieces = pieces.select("container", "item", "piece", (F.col("piece") * F.col("size")).alias("first_token"), F.least(F.col("size"), F.col("all") - F.col("piece") * F.col("size")).alias("tokens"))

    # Ranks among equal lengths: numbered inside hash buckets, which are offset by what the buckets before hold.
    buckets = buckets or groups_for(items.count() * len(containers), least=8)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).cast("int"))
    counts = cut(pieces.groupBy("container", "tokens", "bucket").agg(F.count("*").alias("n")))
    before = Window.partitionBy("container", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("container", "tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("container", "tokens", "bucket").orderBy("item", "piece")
    ranked = pieces.withColumn("place", F.row_number().over(inside)).join(offsets, ["container", "tokens", "bucket"])
    ranked = ranked.select("container", "item", "piece", "first_token", "tokens", (F.col("offset") + F.col("place") - 1).alias("rank"))

    # At most one row per container and length up to its capacity reaches the driver.
    histograms: dict[str, dict[int, int]] = {name: {} for name in containers}
    for name, length, n in counts.groupBy("container", "tokens").agg(F.sum("n")).collect():
        histograms[name][int(length)] = int(n)
    plans = {name: plan(histograms[name], size) for name, size in containers.items()}
    schema = "container string, item bigint, piece int, first_token bigint, tokens bigint, rank bigint, pack bigint"
    return ranked.mapInArrow(_place(plans), schema).select("container", "pack", "item", "piece", "first_token", "tokens")
