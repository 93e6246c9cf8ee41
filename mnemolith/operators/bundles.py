"""Bundles as sets of records by id: deduplication, fingerprint, difference and merge.

A bundle is a DataFrame of envelopes with `bundle_ix`, `pos`, `id` and `doc` (canonical JSON); within a
bundle the record with the greatest `pos` counts. A null id is the empty id, as in the record model.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..session import groups_for
from .blocks import numbered


def envelope(records: DataFrame, *, doc: str, position: str, bundle_ix: int = 0, id_field: str = "id") -> DataFrame:
    """(bundle_ix, pos, id, doc) of JSON records; rows that are no JSON are left out.

    A missing id is the empty one; an id that is null is the text None, which is how the records are keyed.
    """
    canon = records.select(F.col(position).cast("bigint").alias("pos"), canonical_json(F.col(doc)).alias("doc")).where("doc is not null")
    # JSON paths can't tell a null member from an absent one, the list of keys can.
    path = f"$['{id_field}']"
    key = F.coalesce(F.get_json_object("doc", path), F.when(F.array_contains(F.json_object_keys("doc"), id_field), "None").otherwise(""))
    return canon.select(F.lit(bundle_ix).alias("bundle_ix"), "pos", key.alias("id"), "doc")


def dedup_last(bundle: DataFrame) -> DataFrame:
    """The last record per id."""
    return bundle.groupBy(F.coalesce("id", F.lit("")).alias("id")).agg(F.max_by("doc", "pos").alias("doc"))


def dedup_first(bundle: DataFrame) -> DataFrame:
    """(id, doc, pos) of the first record per id, ids that are null left out."""
    return bundle.where("id is not null").groupBy("id").agg(F.min_by("doc", "pos").alias("doc"), F.min("pos").alias("pos"))


def dedup_in_order(bundle: DataFrame) -> DataFrame:
    """(id, doc, place) of the last record per id, placed where the id was first seen; null ids are left out."""
    return bundle.where("id is not null").groupBy("id").agg(F.max_by("doc", "pos").alias("doc"), F.min("pos").alias("place"))


def flatten_planes(planes: dict[str, DataFrame]) -> DataFrame:
    """(plane_ord, plane, pos, id, doc) of all planes (pos, id, doc), in the order given."""
    out = None
    for order, (plane, rows) in enumerate(planes.items()):
        part = rows.select(F.lit(order).alias("plane_ord"), F.lit(plane).alias("plane"), "pos", "id", "doc")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no planes")
    return out


def _joined(batches):
    first = True
    for batch in batches:
        if batch.num_rows:
            text = "\n".join(batch["doc"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([text if first else "\n" + text])], names=["text"])
            first = False


def fingerprint(bundle: DataFrame) -> str:
    """SHA-256 of the records, last per id, ordered by id and joined by newlines.

    The digest is sequential by definition. Records are range-sorted on the cluster and joined into large
    texts there; the driver only streams those through the hash, in constant memory. `tree_fingerprint`
    has no sequential part.
    """
    # Reading partitions one after the other is a job for each, so there are no more than rows ask for.
    parts = groups_for(bundle.count())
    ordered = dedup_last(bundle).repartitionByRange(parts, "id").sortWithinPartitions("id").select("doc").mapInArrow(_joined, "text string")
    digest, first = hashlib.sha256(), True
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        text = row[0]
        if not first and not text.startswith("\n"):
            digest.update(b"\n")
        digest.update(text.encode("utf-8", "surrogatepass"))
        first = False
    return digest.hexdigest()


def tree_fingerprint(bundle: DataFrame) -> DataFrame:
    """(records, fingerprint) in one aggregation: an order-free digest of the same set of records."""
    rows = dedup_last(bundle).select(F.sha2(F.concat_ws("\0", "id", "doc"), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    text = F.concat_ws(".", F.count("*").cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts])
    return rows.agg(F.count("*").alias("records"), F.sha2(text, 256).alias("fingerprint"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, status, old_doc, new_doc): added, removed, changed and unchanged records.

    Deduplication and comparison are one aggregation, so there is one shuffle, combined on the map side.
    """
    none = F.lit(None)
    key = F.coalesce("id", F.lit("")).alias("id")
    old = left.select(key, F.col("pos").cast("bigint").alias("old_pos"), F.col("doc").alias("old"), none.cast("bigint").alias("new_pos"), none.cast("string").alias("new"))
    new = right.select(key, none.cast("bigint").alias("old_pos"), none.cast("string").alias("old"), F.col("pos").cast("bigint").alias("new_pos"), F.col("doc").alias("new"))
    merged = old.unionByName(new).groupBy("id").agg(F.max_by("old", "old_pos").alias("old_doc"), F.max_by("new", "new_pos").alias("new_doc"))
    status = F.when(F.col("old_doc").isNull(), "added").when(F.col("new_doc").isNull(), "removed").when(F.col("old_doc") == F.col("new_doc"), "unchanged").otherwise("changed")
    return merged.select("id", status.alias("status"), "old_doc", "new_doc")


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("records"))


@dataclass(frozen=True)
class Merge:
    """records (id, doc); conflicts (id, variants); duplicate_ids (id, bundle_ix, pos) with the first repetition's place."""

    records: DataFrame
    conflicts: DataFrame
    duplicate_ids: DataFrame


def merge(bundles: DataFrame, *, prefer: str = "last") -> Merge:
    """Merge of all bundles in one DataFrame of envelopes; `bundle_ix` gives their order.

    `prefer` is last, first or raise; raise fails if any id has two contents. Contents are compared as
    canonical text. Conflicts list the record of every bundle that has the id, agreeing ones too.
    """
    if prefer not in ("last", "first", "raise"):
        raise ValueError(f"prefer must be last, first or raise, not {prefer!r}")
    rows = bundles.withColumn("id", F.coalesce("id", F.lit("")))
    per_bundle = rows.groupBy("bundle_ix", "id").agg(F.max_by("doc", "pos").alias("doc"), F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    # An id has at most one record per bundle here, so lists are as short as the list of bundles.
    merged = per_bundle.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("bundle_ix", "doc"))).alias("variants"), F.min("doc").alias("lo"), F.max("doc").alias("hi")
    )
    conflicts = merged.where("lo <> hi").select("id", "variants")
    if prefer == "raise":
        found = conflicts.orderBy("id").limit(1).collect()
        if found:
            raise ValueError(f"conflict on id {found[0]['id']!r}")
    repeated = per_bundle.where("n > 1").select("bundle_ix", "id", "first_pos")
    second = rows.join(repeated, ["bundle_ix", "id"]).where("pos > first_pos").groupBy("id", "bundle_ix").agg(F.min("pos").alias("pos"))
    seen = second.groupBy("id").agg(F.min(F.struct("bundle_ix", "pos")).alias("seen"))
    # The records alone take one aggregation: the preferred bundle's last record.
    order = F.struct(-F.col("bundle_ix") if prefer == "first" else F.col("bundle_ix"), "pos")
    records = rows.groupBy("id").agg(F.max_by("doc", order).alias("doc"))
    return Merge(records, conflicts, seen.select("id", F.col("seen.bundle_ix").alias("bundle_ix"), F.col("seen.pos").alias("pos")))


def in_order(duplicates: DataFrame) -> DataFrame:
    """(place, id): duplicate ids numbered in the order in which their repetition was first seen."""
    return numbered(duplicates, [F.col("bundle_ix"), F.col("pos")], "place").select("place", "id")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All records of two bundles."""
    return left.unionByName(right)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of `left`, last per id, whose id `right` has too."""
    return dedup_last(left).join(right.select(F.coalesce("id", F.lit("")).alias("id")), "id", "left_semi")


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records of `left`, last per id, whose id `right` lacks."""
    return dedup_last(left).join(right.select(F.coalesce("id", F.lit("")).alias("id")), "id", "left_anti")
