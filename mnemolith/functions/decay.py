"""Freshness of records as a column: time decay and event decay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import instant


@dataclass(frozen=True)
class DecayPolicy:
    """Half-life in days, weight of each supersession and of each piece of evidence, exponential or linear."""

    half_life_days: float = 90.0
    supersedes_weight: float = 0.5
    evidence_weight: float = 0.1
    curve: str = "exponential"

    def __post_init__(self) -> None:
        if self.half_life_days <= 0:
            raise ValueError("half_life_days must be above 0")
        if not (0 <= self.supersedes_weight <= 1 and 0 <= self.evidence_weight <= 1):
            raise ValueError("weights must lie between 0 and 1")
        if self.curve not in ("exponential", "linear"):
            raise ValueError(f"unknown curve: {self.curve!r}")


def _size(array: Column) -> Column:
    return F.coalesce(F.array_size(array), F.lit(0))


def decay_score(asserted_at: Column, as_of: Column, supersedes: Column, evidence: Column, policy: DecayPolicy | None = None) -> Column:
    """struct(score, time, event). A missing, malformed or future time leaves a record fully fresh, whatever
    its events: score and time are 1 and event is 0.

    `asserted_at` is an ISO string, `as_of` a timestamp. Else the score is the smaller part, within 0 and 1.
    """
    policy = policy or DecayPolicy()
    age = (F.unix_micros(as_of) - F.unix_micros(instant(asserted_at))) / 1e6
    half = policy.half_life_days * 86400
    curve = F.pow(F.lit(0.5), age / half) if policy.curve == "exponential" else F.greatest(F.lit(0.0), 1 - age / (2 * half))
    event = F.pow(F.lit(1 - policy.supersedes_weight), _size(supersedes)) * F.pow(F.lit(1 - policy.evidence_weight), _size(evidence))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), curve, event))
    known = F.coalesce(age >= 0, F.lit(False))
    return F.struct(F.when(known, score).otherwise(1.0).alias("score"), F.when(known, curve).otherwise(1.0).alias("time"), F.when(known, event).otherwise(0.0).alias("event"))
