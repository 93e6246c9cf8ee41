"""JSON records as typed tables: one type at a time, or told apart by what they say they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import fields_of, struct_type

# Which member tells the types of a family apart, and the type that each of its values means.
FAMILIES: dict[str, tuple[str, dict[str, str]]] = {
    "candidate": ("candidate_type", {k: f"candidate_{k}" for k in ("claim", "preference", "decision", "task", "taste_signal")}),
    "ledger": ("ledger_type", {k: f"{k}_ledger_entry" for k in ("fact", "preference", "decision")}),
    "state": ("state_type", {"project_state": "project_state_snapshot", "core_state": "core_state_snapshot"}),
    "taste": ("card_type", {"taste_card": "taste_card"}),
    "pack": ("pack_type", {"context_pack": "context_pack"}),
}
_FREE_FORM = ("metadata", "chosen_record")


def typed(docs: DataFrame, record_type: str) -> DataFrame:
    """The fields of a record type, read from JSON objects (doc), with `unknown_fields` and `missing_fields`.

    A text that is no JSON object has null fields, and all of them are missing. Free-form objects stay JSON
    texts. `unknown_fields` are members that the type lacks; they are told, not read.
    """
    names = [f for f, _, _ in fields_of(record_type)]
    schema = T.StructType([f for f in struct_type(record_type).fields])
    keys = F.coalesce(F.json_object_keys("doc"), F.array().cast("array<string>"))
    known = F.array(*map(F.lit, names))
    read = docs.select(F.from_json("doc", schema).alias("r"), "doc", keys.alias("keys"))
    value = lambda f: F.get_json_object("doc", f"$.{f}") if f in _FREE_FORM else F.col("r").getField(f)
    return read.select(*[value(f).alias(f) for f in names], F.array_except("keys", known).alias("unknown_fields"), F.array_except(known, "keys").alias("missing_fields"))


def of_family(docs: DataFrame, family: str) -> dict[str, DataFrame]:
    """The records of a family (FAMILIES) as typed tables by record type; see `strangers` for the rest."""
    member, types = FAMILIES[family]
    return {kind: typed(docs.where(_says(member, value)), kind) for value, kind in types.items()}


def strangers(docs: DataFrame, family: str) -> DataFrame:
    """Documents (doc) of none of the family's types."""
    member, types = FAMILIES[family]
    known = F.lit(False)
    for value in types:
        known = known | _says(member, value)
    return docs.where(~known).select("doc")


def _says(member: str, value: str) -> Column:
    return F.coalesce(F.get_json_object("doc", f"$.{member}") == value, F.lit(False))
