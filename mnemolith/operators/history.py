"""History of changing entity attributes (problem 4).

Every export is a Merkle tree over hash buckets of the key. One aggregation puts the digests of a leaf at
two consecutive exports side by side, and upper levels combine those few rows. From the root down only the
branches below differing nodes are compared; rows are read and compared in changed leaves alone, and what
changed there opens, closes or replaces versions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import micros, trimmed
from ..session import cut

_FAN_BITS = 4


def _same(name: str, kind: str) -> Column:
    """A value in the form in which it is compared; null and empty are one."""
    if kind == "list":
        clean = F.array_sort(F.array_distinct(F.filter(F.transform(name, lambda x: F.lower(trimmed(x))), lambda x: x.isNotNull() & (x != ""))))
        return F.when(F.size(clean) > 0, F.to_json(clean))
    clean = F.lower(trimmed(F.col(name).cast("string")))
    clean = F.when(clean != "", clean)
    if kind == "instant":
        return F.coalesce(micros(F.col(name)).cast("string"), clean)
    return clean


def _pairs(rows: DataFrame) -> DataFrame:
    """(at, node, now, was): digests of each leaf at export `at` and at the one before, in one aggregation."""
    here = F.struct(F.lit(1).cast("bigint").alias("rows"), F.xxhash64("key", "sig").alias("x"), F.xxhash64("sig", "key", F.lit(1)).alias("y"))
    # Every row is part of two comparisons: of its own export and of the next one.
    both = rows.select("leaf", here.alias("h"), F.explode(F.array(F.struct(F.col("no").alias("at"), F.lit(True).alias("now")), F.struct((F.col("no") + 1).alias("at"), F.lit(False).alias("now")))).alias("p"))
    digest = lambda side: F.struct(*[f(F.when(F.col("p.now") == F.lit(side), F.col(f"h.{c}"))).alias(c) for c, f in (("rows", F.sum), ("x", F.bit_xor), ("y", F.bit_xor))])
    return both.groupBy(F.col("p.at").alias("at"), F.col("leaf").alias("node")).agg(digest(True).alias("now"), digest(False).alias("was"))


def _parents(pairs: DataFrame) -> DataFrame:
    """The level above: digests combine as those of rows did."""
    combined = lambda side: F.struct(F.sum(f"{side}.rows").alias("rows"), F.bit_xor(f"{side}.x").alias("x"), F.bit_xor(f"{side}.y").alias("y"))
    return pairs.groupBy("at", F.shiftright("node", _FAN_BITS).alias("node")).agg(combined("now").alias("now"), combined("was").alias("was"))


def _changed_leaves(rows: DataFrame, levels: int) -> DataFrame:
    """(at, leaf) whose digest at export `at` differs from that at `at - 1`: down the tree, below changed nodes only."""
    tree = [cut(_pairs(rows))]
    for _ in range(levels):
        tree.append(_parents(tree[-1]))
    changed = None
    for pairs in reversed(tree):
        differing = pairs.where(~F.col("now").eqNullSafe(F.col("was")))
        if changed is not None:
            differing = differing.join(changed.select("at", F.col("node").alias("parent")), (differing["at"] == changed["at"]) & (F.shiftright(differing["node"], _FAN_BITS) == F.col("parent")), "left_semi")
        changed = differing.select(F.col("at").alias("at"), F.col("node").alias("node"))
    return changed.withColumnRenamed("node", "leaf")


def version_history(
    exports: DataFrame, *, key: str, number: str, received: str, attributes: Mapping[str, str], rows_per_leaf: int = 64
) -> DataFrame:
    """(key, version_no, first, last, attributes): a row per longest run of consecutive exports in which
    the entity was present with the same attributes.

    `attributes` maps a column to how it is compared: `text` (letter case and outer blanks don't matter),
    `instant` (two spellings of one instant are equal) or `list` (order and repeats don't matter). Of
    several rows for one key and export the latest received counts, then the one with the greatest
    attributes; a null `received` is the oldest. Rows without key or export number are no evidence of
    anything and are left out. `attributes` of the result is the JSON of the compared forms.
    """
    signature = F.to_json(F.struct(*[_same(n, k).alias(n) for n, k in attributes.items()]), {"ignoreNullFields": "false"})
    rows = cut(
        exports.select(F.col(key).alias("key"), F.col(number).cast("long").alias("no"), F.col(received).alias("received"), signature.alias("sig"))
        .where("key is not null and no is not null")
        .groupBy("key", "no")
        .agg(F.max(F.struct("received", "sig")).alias("last"))
        .select("key", "no", F.col("last.sig").alias("sig"))
    )
    size = rows.agg(F.count("*"), F.approx_count_distinct("no")).first()
    levels = min(7, max(1, math.ceil(math.log(max(2, size[0] / max(1, size[1]) / rows_per_leaf), 1 << _FAN_BITS))))
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("key"), F.lit(1 << _FAN_BITS * levels)))
    changed = _changed_leaves(rows, levels)

    # A changed leaf is read at two exports; a leaf of an export may be wanted as what is and as what was.
    wanted = changed.select("leaf", F.explode(F.array(F.struct(F.col("at").alias("no"), F.lit(0).alias("ahead")), F.struct((F.col("at") - 1).alias("no"), F.lit(1).alias("ahead")))).alias("w")).select("leaf", "w.*")
    wanted = wanted.groupBy("leaf", "no").agg(F.collect_set("ahead").alias("ahead"))
    read = rows.join(wanted, ["leaf", "no"]).select("key", "sig", "no", F.explode("ahead").alias("ahead"))
    moved = (
        read.select("key", (F.col("no") + F.col("ahead")).alias("at"), F.when(F.col("ahead") == 0, F.col("sig")).alias("now"), F.when(F.col("ahead") == 1, F.col("sig")).alias("was"))
        # By key alone, so that both aggregations below do with this one exchange.
        .repartition("key")
        .groupBy("key", "at")
        .agg(F.max("now").alias("now"), F.max("was").alias("was"))
        .where(~F.col("now").eqNullSafe(F.col("was")))
    )
    # A key has at most as many versions as there are exports, so its lists are short.
    spans = moved.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("now").isNotNull(), F.struct("at", "now")))).alias("opened"),
        F.array_sort(F.collect_list(F.when(F.col("was").isNotNull(), F.col("at") - 1))).alias("closed"),
    )
    return spans.select("key", F.posexplode(F.arrays_zip("opened", "closed")).alias("i", "v")).select(
        F.col("key").alias(key),
        (F.col("i") + 1).cast("int").alias("version_no"),
        F.col("v.opened.at").cast("int").alias("first"),
        F.col("v.closed").cast("int").alias("last"),
        F.col("v.opened.now").alias("attributes"),
    )
