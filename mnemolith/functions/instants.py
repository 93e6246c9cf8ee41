"""ISO-8601 strings as instants, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks around a value: Spark's trim knows only the space.
BLANKS = " \t\n\r\x0b\f\u00a0\u2007\u202f\ufeff"


def trimmed(text: Column) -> Column:
    """Text without outer blanks of any kind."""
    return F.btrim(text, F.lit(BLANKS))


#: What counts as an ISO date or date-time; Spark's own cast would also take `2026` or `T12:00`.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


_USUAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def instant(text: Column) -> Column:
    """TIMESTAMP of an ISO string, null if it is none. A zone-less value is UTC (see `session.prepare`)."""
    clean = F.upper(trimmed(text))
    # Spark's cast knows no zone after minutes, no blank before a zone and no offset without its colon.
    whole = F.regexp_replace(clean, r"^(.{10}[T ]\d{2}:\d{2})(?!:)(?=.)", "$1:00")
    whole = F.regexp_replace(F.regexp_replace(whole, r"(?<=:\d{2}(\.\d{1,9})?)\s", ""), r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(clean.rlike(_USUAL), clean.try_cast("timestamp")).when(clean.rlike(ISO), whole.try_cast("timestamp"))


def micros(text: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO string, or null."""
    return F.unix_micros(instant(text))
