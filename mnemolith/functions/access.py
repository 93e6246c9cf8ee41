"""Privacy-scoped access as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Privacy classes from the most open to the most closed.
PRIVACY_CLASSES = ("public", "internal", "private", "sensitive", "highly_sensitive")


@dataclass(frozen=True)
class Scope:
    """The most closed class that may pass, and the record types that may (empty: all)."""

    max_privacy_class: str = "internal"
    record_types: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.max_privacy_class not in PRIVACY_CLASSES:
            raise ValueError(f"unknown privacy class: {self.max_privacy_class!r}")


def scope_from_dict(options: dict) -> Scope:
    """A scope from loose options; a class that is unknown or missing counts as internal."""
    wanted = options.get("max_privacy_class")
    return Scope(wanted if wanted in PRIVACY_CLASSES else "internal", tuple(options.get("record_types") or ()))


def public_scope() -> Scope:
    return Scope("public")


def team_scope() -> Scope:
    return Scope("internal")


def customer_scope() -> Scope:
    return Scope("private")


def private_scope() -> Scope:
    return Scope("highly_sensitive")


def privacy_rank(privacy_class: Column) -> Column:
    """1 for the most open class; 0 for one that is unknown."""
    return F.array_position(F.array(*map(F.lit, PRIVACY_CLASSES)), privacy_class)


def effective_class(privacy_class: Column) -> Column:
    """A record without a class counts as internal."""
    return F.when(F.coalesce(privacy_class, F.lit("")) == "", "internal").otherwise(privacy_class)


def access_decision(privacy_class: Column, record_type: Column, scope: Scope) -> Column:
    """struct(action, reason): allow or drop. An unknown class is dropped; records without a type pass type lists."""
    cls = effective_class(privacy_class)
    level, most = privacy_rank(cls), PRIVACY_CLASSES.index(scope.max_privacy_class) + 1
    listed = F.coalesce(record_type, F.lit("")).isin("", *scope.record_types) if scope.record_types else F.lit(True)
    too_closed = F.concat(F.lit("privacy_class="), cls, F.lit(f" > max={scope.max_privacy_class}"))
    fine = F.concat(F.lit("privacy_class="), cls, F.lit(f" <= max={scope.max_privacy_class}"))
    action = F.when((level == 0) | (level > most) | ~listed, "drop").otherwise("allow")
    reason = F.when(level == 0, F.concat(F.lit("unknown privacy_class="), cls)).when(level > most, too_closed).when(~listed, F.concat(F.lit("record_type="), record_type, F.lit(" not in scope"))).otherwise(fine)
    return F.struct(action.alias("action"), reason.alias("reason"))


def decide(records: DataFrame, scope: Scope, *, privacy_class: Column, record_type: Column) -> DataFrame:
    """`records` with `action` and `reason`."""
    return records.withColumn("_access", access_decision(privacy_class, record_type, scope)).select("*", "_access.action", "_access.reason").drop("_access")


def scoped(records: DataFrame, scope: Scope, *, privacy_class: Column, record_type: Column) -> DataFrame:
    """The records that the scope lets pass."""
    return records.where(access_decision(privacy_class, record_type, scope)["action"] == "allow")


def summary(decisions: DataFrame) -> DataFrame:
    """(action, privacy_class, records); rows dropped for their type have a null class."""
    cls = F.when(F.col("reason").startswith("privacy_class="), F.regexp_extract("reason", r"^privacy_class=(\S+)", 1))
    return decisions.groupBy("action", cls.alias("privacy_class")).agg(F.count("*").alias("records"))
