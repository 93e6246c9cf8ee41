"""What a tool server offers, as plain calls over plane tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.access import access_decision, scope_from_dict
from ..operators.citations import Graph
from ..operators.integrity import row_violations
from ..schemas import FIELDS, json_schema
from .compiler import Policy, select_records


def list_schemas() -> list[str]:
    return sorted(FIELDS)


def read_schema(name: str) -> dict:
    return json_schema(name)


def validate_bundle(planes: dict[str, DataFrame], *, most: int | None = None) -> dict[str, list[str]]:
    """All errors per plane, or the first `most` and how many more there are; every plane has a key.

    Errors come to the driver here; `integrity.row_violations` is the same as a DataFrame.
    """
    out: dict[str, list[str]] = {}
    for name, rows in planes.items():
        found = row_violations({name: rows}).orderBy("id", "rule")
        listed = (found if most is None else found.limit(most)).toLocalIterator()
        out[name] = [f"[{r.id}] {r.rule}" for r in listed]
        if most is not None and (more := found.count() - most) > 0:
            out[name].append(f"and {more} more")
    return out


def check_access(records: DataFrame, scope: dict) -> DataFrame:
    """(id, action, reason) under a scope given as loose options."""
    decision = access_decision(F.col("privacy_class"), F.col("record_type"), scope_from_dict(scope))
    return records.select("id", decision.alias("d")).select("id", "d.action", "d.reason")


def compile_context(records: DataFrame, g: Graph | None, scope: dict, policy: dict) -> DataFrame:
    """The selection of a context pack, with scope and policy given as loose options."""
    return select_records(records, g, scope_from_dict(scope), Policy(**policy))


def state_reference(states: DataFrame, selected: DataFrame) -> dict:
    """The state snapshots that a pack names: a selected core state, else selected project states, else any of either.

    `states` (id, state_type) is to be scoped by the caller, so that nothing outside the scope is named. At
    most one core state, or all project states, which a pack lists, are collected; none at all is an error.
    """
    marked = states.select("id", "state_type").distinct().join(selected.select("id", F.lit(0).alias("chosen")).distinct(), "id", "left")
    order = F.coalesce("chosen", F.lit(1)) * 2 + F.when(F.col("state_type") == "core_state", 0).otherwise(1)
    ranked = marked.where("state_type in ('core_state', 'project_state')").withColumn("place", order)
    best = ranked.agg(F.min("place")).first()[0]
    if best is None:
        raise ValueError("the bundle has no state snapshot")
    named = ranked.where(F.col("place") == best)
    # Of several core states one is named, so only one is fetched.
    ids = sorted(r.id for r in (named if best % 2 else named.orderBy("id").limit(1)).select("id").collect())
    return {"core_state_id": None, "project_state_ids": ids} if best % 2 else {"core_state_id": ids[0], "project_state_ids": []}
