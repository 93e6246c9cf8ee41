"""Points in time against periods of validity, as columns. Periods are ISO strings; null is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .instants import instant


def _none(array: Column) -> Column:
    return F.coalesce(F.array_size(array), F.lit(0)) == 0


def is_active(at: Column, *, status: Column, superseded_by: Column, valid_from: Column, valid_until: Column, stale_after: Column) -> Column:
    """Status active, superseded by nothing, begun, neither ended nor stale at `at`."""
    begun = F.coalesce(instant(valid_from) <= at, F.lit(True))
    lasting = F.coalesce(at < instant(valid_until), F.lit(True)) & F.coalesce(at < instant(stale_after), F.lit(True))
    return (F.coalesce(status, F.lit("")) == "active") & _none(superseded_by) & begun & lasting


def holds_as_of(at: Column, *, status: Column, valid_from: Column, valid_until: Column) -> Column:
    """Neither retracted nor archived, and valid_from <= at < valid_until; what came later is ignored."""
    inside = F.coalesce(instant(valid_from) <= at, F.lit(True)) & F.coalesce(at < instant(valid_until), F.lit(True))
    return ~F.coalesce(status, F.lit("")).isin("retracted", "archived") & inside


def in_window(at: Column, *, valid_from: Column, valid_until: Column) -> Column:
    """valid_from <= at <= valid_until, whatever the status."""
    return F.coalesce(instant(valid_from) <= at, F.lit(True)) & F.coalesce(at <= instant(valid_until), F.lit(True))


def period(valid_from: Column, valid_until: Column, stale_after: Column) -> Column:
    """struct(begins, ends) in microseconds; open ends are the extremes of BIGINT."""
    ends = F.least(F.unix_micros(instant(valid_until)), F.unix_micros(instant(stale_after)))
    return F.struct(F.coalesce(F.unix_micros(instant(valid_from)), F.lit(-(1 << 63))).alias("begins"), F.coalesce(ends, F.lit((1 << 63) - 1)).alias("ends"))
