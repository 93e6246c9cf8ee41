"""Resolution of merge conflicts and its application to a bundle."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ..functions.canonical import PREFIXES, canonical_json, content_id, prefixed_id
from ..functions.instants import instant

#: chosen_version_index of a record built from all variants, and of a resolution that keeps them apart.
MERGED, SPLIT = -1, -2


@arrow_udf(StringType())
def _merged_fields(conflict: pa.Array, variants: pa.Array) -> pa.Array:
    out = []
    for key, docs in zip(conflict.to_pylist(), variants.to_pylist(), strict=True):
        record: dict = {}
        for variant in sorted(docs or [], key=lambda v: v["bundle_ix"]):
            record |= json.loads(variant["doc"])
        out.append(json.dumps(record | {"id": key}, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    return pa.array(out, pa.string())


def resolve(conflicts: DataFrame, *, choice: Column, resolved_by: Column, rationale: Column, resolved_at: Column) -> DataFrame:
    """Resolutions of conflicts (id, variants of bundle_ix and doc), with an `error` where the input is bad.

    `choice` is a variant's index as text, `merge` (for each key the value of the last bundle that has it;
    a key that is present with null has that value) or `split` (no record is chosen). `rationale` needs ten
    characters, `resolved_by` one that isn't blank, and `resolved_at` is an ISO time.
    """
    index = choice.try_cast("int")
    count = F.size("variants")
    picked = F.when(choice == "merge", MERGED).when(choice == "split", SPLIT).otherwise(index)
    error = (
        F.when(picked.isNull(), "choice is no index, merge or split")
        .when((picked >= count) | (picked < SPLIT) | ((picked < 0) & index.isNotNull()), "choice is out of range")
        .when(F.coalesce(F.trim(resolved_by), F.lit("")) == "", "resolved_by is blank")
        .when(F.coalesce(F.length(F.trim(rationale)), F.lit(0)) < 10, "rationale has under 10 characters")
        .when(instant(resolved_at).isNull(), "resolved_at is no time")
    )
    chosen = F.when(choice == "merge", _merged_fields(F.col("id"), F.col("variants"))).otherwise(F.get(F.col("variants.doc"), F.greatest(picked, F.lit(0))))
    others = F.filter(F.transform("variants", lambda v, i: F.struct(i.alias("i"), F.get_json_object(v["doc"], "$.id").alias("id"))), lambda v: (v["i"] != picked) & v["id"].isNotNull() & (v["id"] != ""))
    out = conflicts.select(
        F.col("id").alias("conflict_id"), picked.alias("chosen_version_index"), F.when(picked != SPLIT, chosen).alias("chosen_record"), F.when(picked == SPLIT, F.array().cast("array<string>")).otherwise(F.transform(others, lambda v: v["id"])).alias("rejected_record_ids"),
        resolved_by.alias("resolved_by"), resolved_at.alias("resolved_at"), rationale.alias("rationale"), error.alias("error"),
    )
    key = content_id("conflict_resolution", **{c: F.col(c) for c in ("conflict_id", "chosen_version_index", "chosen_record", "rejected_record_ids", "resolved_by", "resolved_at", "rationale")})
    return out.select(key.alias("id"), *out.columns)


def apply(bundle: DataFrame, resolutions: DataFrame, *, now: Column) -> DataFrame:
    """The bundle with rejected records flagged and chosen records added.

    `bundle`: (id, doc, superseded_by array, resolved_conflict_ids array, superseded_by_conflict_resolution,
    superseded_at). `resolutions`: (id, conflict_id, chosen_record, rejected_record_ids). Every row whose id
    is rejected is flagged by the first resolution, by id, that rejects it; a flag that is set stays.
    Rejected rows stay, chosen ones are appended.
    """
    rejected = resolutions.select(F.col("id").alias("by"), F.explode("rejected_record_ids").alias("id")).groupBy("id").agg(F.min("by").alias("by"), F.sort_array(F.collect_set("by")).alias("all_by"))
    flagged = bundle.join(rejected, "id", "left").select(
        "id", "doc",
        F.when(F.col("by").isNull(), F.col("superseded_by")).otherwise(F.array_union(F.coalesce("superseded_by", F.array().cast("array<string>")), F.col("all_by"))).alias("superseded_by"),
        "resolved_conflict_ids", F.coalesce("superseded_by_conflict_resolution", "by").alias("superseded_by_conflict_resolution"), F.when(F.col("by").isNotNull(), F.coalesce("superseded_at", now)).otherwise(F.col("superseded_at")).alias("superseded_at"),
    )
    nothing = F.lit(None).cast("string")
    chosen = resolutions.where("chosen_record is not null").select(
        F.coalesce(F.get_json_object("chosen_record", "$.id"), F.col("conflict_id")).alias("id"), F.col("chosen_record").alias("doc"), F.lit(None).cast("array<string>").alias("superseded_by"),
        F.array("id").alias("resolved_conflict_ids"), nothing.alias("superseded_by_conflict_resolution"), nothing.alias("superseded_at"),
    )
    return flagged.unionByName(chosen)


def violations(bundle: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(resolution_id, conflict_id, problem): resolutions of one conflict that repeat, and such as match no record."""
    ids = bundle.select("id").distinct()
    repeated = resolutions.groupBy("conflict_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")
    twice = resolutions.join(repeated, "conflict_id").where("id <> first_id").select(F.col("id").alias("resolution_id"), "conflict_id", F.lit("duplicate_conflict_id").alias("problem"))
    named = resolutions.select(F.col("id").alias("resolution_id"), "conflict_id", F.explode(F.array_append(F.coalesce("rejected_record_ids", F.array().cast("array<string>")), F.col("conflict_id"))).alias("id"))
    matched = named.join(ids, "id", "left_semi").select("resolution_id").distinct()
    lost = resolutions.select(F.col("id").alias("resolution_id"), "conflict_id", F.lit("no_matching_record").alias("problem")).join(matched, "resolution_id", "left_anti")
    return twice.unionByName(lost.select("resolution_id", "conflict_id", "problem"))


_DOCUMENT = "conflict_id string, chosen_version_index int, rejected_record_ids array<string>, resolved_by string, resolved_at string, rationale string, superseded_at string"


def from_documents(docs: DataFrame) -> DataFrame:
    """Resolutions of JSON objects (doc), with an id that is always derived anew from what they say.

    (id, schema_version, conflict_id, chosen_version_index, chosen_record as JSON or null, rejected_record_ids,
    resolved_by, resolved_at, rationale, superseded_at, metadata as JSON). An id that comes with a document is
    ignored; rejected ids and metadata that are missing are empty.
    """
    whole = docs.select(F.col("doc"), F.from_json("doc", _DOCUMENT).alias("r"))
    member = lambda name: F.get_json_object("doc", f"$.{name}")
    rejected = F.coalesce("r.rejected_record_ids", F.array().cast("array<string>"))
    # Objects are passed on as JSON, so the payload is put together from its members' texts.
    texts = {
        "chosen_record": F.coalesce(member("chosen_record"), F.lit("null")), "chosen_version_index": F.coalesce(F.col("r.chosen_version_index").cast("string"), F.lit("null")),
        "metadata": F.coalesce(member("metadata"), F.lit("{}")), "rejected_record_ids": F.to_json(rejected),
        **{n: F.coalesce(F.to_json(F.array(f"r.{n}"), {"ignoreNullFields": "false"}), F.lit("[null]")) for n in ("conflict_id", "rationale", "resolved_at", "resolved_by", "superseded_at")},
    }
    single = lambda n, t: t if n in ("chosen_record", "chosen_version_index", "metadata", "rejected_record_ids") else F.substr(t, F.lit(2), F.length(t) - 2)
    payload = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), single(n, texts[n])) for n in sorted(texts)]), F.lit("}"))
    rows = whole.select("r.*", canonical_json(payload).alias("payload"), member("chosen_record").alias("chosen"), F.coalesce(member("metadata"), F.lit("{}")).alias("metadata"), rejected.alias("rejected"))
    return rows.select(
        prefixed_id(PREFIXES["conflict_resolution"], F.col("payload")).alias("id"), F.lit("1.0.0").alias("schema_version"), "conflict_id", "chosen_version_index", F.col("chosen").alias("chosen_record"), F.col("rejected").alias("rejected_record_ids"),
        "resolved_by", "resolved_at", "rationale", "superseded_at", "metadata",
    )


def to_documents(resolutions: DataFrame) -> DataFrame:
    """(doc): each resolution as a JSON object, its chosen record and metadata as objects."""
    # Their texts are passed on as they are: a parsed number would come out in another spelling.
    raw = ("chosen_record", "metadata")
    rest = F.to_json(F.struct(*[c for c in resolutions.columns if c not in raw]), {"ignoreNullFields": "false"})
    members = [F.concat(F.lit(f',"{c}":'), F.coalesce(c, F.lit("null"))) for c in raw]
    return resolutions.select(F.concat(F.substr(rest, F.lit(1), F.length(rest) - 1), *members, F.lit("}")).alias("doc"))
