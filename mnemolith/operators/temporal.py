"""Current records, supersession chains and overlapping periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validity import holds_as_of, is_active, period
from ..session import cut, groups_for

_FIELDS = ("status", "superseded_by", "valid_from", "valid_until", "stale_after")


def current(records: DataFrame, at: Column) -> DataFrame:
    """Records that are active at `at` (ledger entries, taste cards, state snapshots)."""
    return records.where(is_active(at, **{f: F.col(f) for f in _FIELDS}))


def as_of(records: DataFrame, at: Column) -> DataFrame:
    """Records that held at `at`, whatever has happened to them since."""
    return records.where(holds_as_of(at, status=F.col("status"), valid_from=F.col("valid_from"), valid_until=F.col("valid_until")))


def only_current(records: DataFrame, at: Column, key: Column):
    """The one active record with `key` true, or None; several are an error."""
    found = current(records.where(key), at).limit(2).collect()
    if len(found) > 1:
        raise ValueError("several records are active at once")
    return found[0] if found else None


def supersession_chains(records: DataFrame, *, key: str = "id", superseded_by: str = "superseded_by") -> DataFrame:
    """(id, last_id, steps, ends): where following the first replacement leads from each record.

    `ends` is current (the last record has no replacement), dangling (the replacement is not among the
    records; it counts as a step) or cycle. Of several rows of one id the greatest replacement counts.
    Pointer doubling: a chain of n records takes log2(n) joins.
    """
    step = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.get(F.col(superseded_by), F.lit(0))).alias("next"))
    known = step.select(F.col("id").alias("next"), F.lit(True).alias("known"))
    state = step.join(known, "next", "left").select(
        "id", F.when(F.col("known"), F.col("next")).alias("up"), F.coalesce("next", "id").alias("last_id"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("steps"),
        F.when(F.col("next").isNull(), "current").when(F.col("known").isNull(), "dangling").otherwise("cycle").alias("ends"),
    )
    state, before = cut(state), -1
    while True:
        open_ = state.where("up is not null").count()
        if open_ in (0, before):
            break
        before = open_
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("last_id").alias("last2"), F.col("steps").alias("steps2"), F.col("ends").alias("ends2"))
        moved = state.where("up is not null").join(ahead, "up").select("id", F.col("up2").alias("up"), F.col("last2").alias("last_id"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("ends2").alias("ends"))
        state = cut(state.where("up is null").unionByName(moved))
    looped = F.col("up").isNotNull()
    return state.select("id", F.when(~looped, F.col("last_id")).alias("last_id"), F.when(~looped, F.col("steps")).alias("steps"), F.when(looped, "cycle").otherwise(F.col("ends")).alias("ends"))


def overlaps(records: DataFrame, *, group: str, key: str = "id", blocks: int | None = None) -> DataFrame:
    """(group, id, overlaps_id): records that begin before an earlier one of their group has ended.

    Periods run from valid_from to the earlier of valid_until and stale_after; touching isn't overlapping.
    One running maximum per group instead of pairs: each record is reported against the earlier record
    that ends last, so every overlap is found, though not every pair is listed. The maximum runs inside
    range partitions by group and time and is carried from one to the next, so a big group is many tasks.
    """
    rows = records.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), period(F.col("valid_from"), F.col("valid_until"), F.col("stale_after")).alias("p"))
    rows = cut(rows.select("g", "k", "p.begins", "p.ends").where("begins < ends"))
    # Written once more, so that a task that runs again finds the same blocks.
    rows = cut(rows.repartitionByRange(blocks or groups_for(rows.count(), least=2), "g", "begins", "ends", "k").withColumn("block", F.spark_partition_id()))
    longest = F.max(F.struct(F.col("ends").alias("ends"), F.col("k").alias("id")))
    earlier = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("g", "block").agg(longest.alias("last")).select("g", "block", F.max("last").over(earlier).alias("carried"))
    before = Window.partitionBy("g", "block").orderBy("begins", "ends", "k").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("inside", longest.over(before)).join(carried, ["g", "block"]).withColumn("open", F.greatest("inside", "carried"))
    return seen.where("open.ends > begins").select(F.col("g").alias(group), F.col("k").alias(key), F.col("open.id").alias("overlaps_id"))
