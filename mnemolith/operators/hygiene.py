"""Hygiene reports: what state a bundle is in, in single-pass aggregations."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import PREFIXES
from ..functions.classify import plane_of_id
from ..functions.instants import instant
from ..functions.validity import in_window

_TIMES = ("observed_at", "asserted_at", "valid_from", "valid_until", "created_at", "updated_at")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _col(records: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in records.columns else F.lit(None).cast(kind)


def temporal_counts(records: DataFrame, now: Column) -> DataFrame:
    """(records, active, stale, expired, superseded); the counters overlap, rows aren't deduplicated."""
    start, end, stale = (_col(records, c) for c in ("valid_from", "valid_until", "stale_after"))
    replaced = F.coalesce(F.array_size(_col(records, "superseded_by", "array<string>")), F.lit(0)) > 0
    return records.agg(
        F.count("*").alias("records"), _count(in_window(now, valid_from=start, valid_until=end)).alias("active"), _count(now > instant(stale)).alias("stale"),
        _count(now > instant(end)).alias("expired"), _count(replaced).alias("superseded"),
    )


def counts_by(records: DataFrame, *, key: str = "id") -> DataFrame:
    """(dimension, value, records) by plane, type and privacy class, from one pass over grouping sets."""
    kind = F.coalesce(_col(records, "ledger_type"), _col(records, "candidate_type"))
    rows = records.select(plane_of_id(F.coalesce(F.col(key), F.lit(""))).alias("plane"), F.coalesce(kind, F.lit("")).alias("type"), F.coalesce(_col(records, "privacy_class"), F.lit("unspecified")).alias("privacy"))
    sets = rows.groupingSets([["plane"], ["type"], ["privacy"]], "plane", "type", "privacy").agg(F.count("*").alias("records"), F.grouping("plane").alias("a"), F.grouping("type").alias("b"))
    dimension = F.when(F.col("a") == 0, "plane").when(F.col("b") == 0, "type").otherwise("privacy")
    return sets.select(dimension.alias("dimension"), F.coalesce("plane", "type", "privacy").alias("value"), "records").where("not (dimension = 'type' and value = '')")


def evidence_gaps(records: DataFrame, known: DataFrame, *, key: str = "id") -> DataFrame:
    """(missing, orphaned): trusted records without evidence, and such as cite evidence that isn't there.

    Rows are counted, as everywhere in the report: a record that repeats counts each time.
    """
    trusted = records.where(plane_of_id(F.coalesce(F.col(key), F.lit(""))).isin("ledger", "taste", "state"))
    missing = trusted.agg(_count(F.coalesce(F.array_size("evidence_span_ids"), F.lit(0)) == 0).alias("missing"))
    # Rows with one id and one list are told apart by their number alone, so they are counted before references are looked up.
    rows = trusted.groupBy(F.col(key).alias("id"), F.col("evidence_span_ids").alias("refs")).agg(F.count("*").alias("rows"))
    cited = rows.select("id", "refs", "rows", F.explode("refs").alias("ref")).join(known.select(F.col("id").alias("ref")), "ref", "left_anti")
    none = F.lit(None).cast("bigint")
    lost = cited.groupBy("id", "refs").agg(F.first("rows").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("orphaned"))
    both = missing.select("missing", none.alias("orphaned")).unionByName(lost.select(none.alias("missing"), "orphaned"))
    return both.agg(F.max("missing").alias("missing"), F.max("orphaned").alias("orphaned"))


def window(records: DataFrame) -> DataFrame:
    """(window_start, window_end): the earliest and latest time that any record names."""
    times = [instant(F.col(c)) for c in _TIMES if c in records.columns]
    low, high = (F.least(*times), F.greatest(*times)) if len(times) > 1 else (times[0], times[0])
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return records.agg(F.min(low).alias("a"), F.max(high).alias("z")).select(text("a").alias("window_start"), text("z").alias("window_end"))


@dataclass(frozen=True)
class Report:
    """A report as plain values."""

    window_start: str | None
    window_end: str | None
    counts: dict[str, int]
    by: dict[str, dict[str, int]]
    missing_evidence: int
    orphaned_evidence: int
    conflicts: int = 0
    resolved: int = 0
    fingerprint: str = ""
    computed_at: str = ""

    @property
    def id(self) -> str:
        """Derived from all that the report says."""
        by = self.by
        payload = {
            "bundle_fingerprint": self.fingerprint, "window_start": self.window_start, "window_end": self.window_end, "computed_at": self.computed_at, "total_records": self.counts["records"], "records_by_plane": by["plane"],
            "records_by_type": by["type"], "records_by_privacy": by["privacy"], **{f"{k}_count": self.counts[k] for k in ("active", "stale", "expired", "superseded")}, "conflicts_surfaced_count": self.conflicts,
            "conflicts_resolved_count": self.resolved, "records_with_missing_evidence": self.missing_evidence, "records_with_orphan_evidence": self.orphaned_evidence,
        }
        text = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return f"{PREFIXES['memory_hygiene_report']}_{hashlib.sha256(text.encode()).hexdigest()[:24]}"

    def markdown(self) -> str:
        """The report as text; tables by falling count."""
        lines = ["# Memory hygiene", "", f"Window: {self.window_start} to {self.window_end}", ""]
        lines += [f"- {k}: {v}" for k, v in self.counts.items()] + [f"- missing evidence: {self.missing_evidence}", f"- orphaned evidence: {self.orphaned_evidence}"]
        if self.conflicts:
            lines.append(f"- conflicts: {self.conflicts}, of which resolved: {self.resolved}")
        for dimension, values in self.by.items():
            if set(values) - {"unspecified"}:
                lines += ["", f"## By {dimension}", "", "| value | records |", "| --- | --- |"]
                lines += [f"| {v} | {n} |" for v, n in sorted(values.items(), key=lambda x: (-x[1], x[0]))]
        return "\n".join(lines) + "\n"


def report(
    records: DataFrame, known_evidence: DataFrame, *, now: Column, conflicts: int = 0, resolved: int = 0, window_start: str | None = None, window_end: str | None = None, fingerprint: str = "",
) -> Report:
    """Few numbers, collected; planes, types and privacy classes are bounded by the record model.

    A window that is given is stated instead of the one found; it filters nothing. `fingerprint` is that of
    the bundle (`bundles.fingerprint` or `tree_fingerprint`).
    """
    if window_start and window_end:
        a, z = records.sparkSession.range(1).select(instant(F.lit(window_start)), instant(F.lit(window_end))).first()
        if a is None or z is None or a > z:
            raise ValueError("the window's ends must be times, the first not after the last")
    counts = temporal_counts(records, now).first().asDict()
    by: dict[str, dict[str, int]] = {"plane": {}, "type": {}, "privacy": {}}
    for dimension, value, n in counts_by(records).collect():
        by[dimension][value] = n
    gaps, span = evidence_gaps(records, known_evidence).first(), window(records).first()
    computed = records.sparkSession.range(1).select(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")).first()[0]
    return Report(window_start or span[0], window_end or span[1], counts, by, gaps["missing"], gaps["orphaned"], conflicts, resolved, fingerprint, computed)
