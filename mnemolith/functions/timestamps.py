"""Every instant that a time string can denote.

`readings` lists all valid interpretations of a value as (format, microseconds since 1970 UTC). Which one
holds is decided elsewhere, from all values of a source (operators/timezones.py).
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

# Zone abbreviations and their offsets from UTC in minutes. Several offsets are several readings.
ABBREVIATIONS = {
    "z": (0,), "ut": (0,), "utc": (0,), "gmt": (0,), "wet": (0,), "west": (60,), "bst": (60,), "cet": (60,), "cest": (120,), "met": (60,), "mest": (120,),
    "eet": (120,), "eest": (180,), "msk": (180,), "ist": (330, 60, 120), "npt": (345,), "pkt": (300,), "jst": (540,), "kst": (540,), "hkt": (480,), "sgt": (480,),
    "awst": (480,), "acst": (570,), "acdt": (630,), "aest": (600,), "aedt": (660,), "nzst": (720,), "nzdt": (780,), "brt": (-180,), "brst": (-120,), "art": (-180,),
    "est": (-300,), "edt": (-240,), "cst": (-360, 480), "cdt": (-300,), "mst": (-420,), "mdt": (-360,), "pst": (-480,), "pdt": (-420,), "akst": (-540,), "akdt": (-480,), "hst": (-600,), "sast": (120,),
}
# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Bare numbers count from 1970; the unit is the one that gives a date in these years.
YEARS = (2024, 2025)

_EPOCH = datetime(1970, 1, 1)
#: No zone name comes near this length.
_LONGEST_NAME = 100
#: Units of a bare number, by the power of ten that takes them to microseconds.
_UNITS = (("s", 6), ("ms", 3), ("us", 0), ("ns", -3))
_FROM = int((datetime(YEARS[0], 1, 1) - _EPOCH).total_seconds()) * 10**6
_UNTIL = int((datetime(YEARS[1] + 1, 1, 1) - _EPOCH).total_seconds()) * 10**6

_MONTH = "(?P<mon>" + "|".join(m[:3] + f"(?:{m[3:]})?" if m != "may" else m for m in MONTHS) + "|sept)\\.?"
_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[ap]\.?m\.?)?"
_ZONE = r"\s*(?P<zone>.*)"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_FORMATS = tuple(
    (name, re.compile(pattern + r"\Z"))
    for name, pattern in (
        ("ymd", r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})(?:t|[\s,]+)" + _TIME + _ZONE),
        ("basic", r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[t\s](?P<h>\d{2}):?(?P<mi>\d{2})(?::?(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?P<ap>)" + _ZONE),
        ("dotted", r"(?P<a>\d{1,2})\.(?P<b>\d{1,2})\.(?P<y>\d{4}),?\s+" + _TIME + _ZONE),
        ("slashed", r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}),?\s+" + _TIME + _ZONE),
        ("dashed", r"(?P<a>\d{1,2})-(?P<b>\d{1,2})-(?P<y>\d{4}),?\s+" + _TIME + _ZONE),
        ("day month", _WEEKDAY + r"(?P<d>\d{1,2})(?:st|nd|rd|th)?[\s.-]+" + _MONTH + r"[\s,-]+(?P<y>\d{4}),?(?:\s+at)?\s+" + _TIME + _ZONE),
        ("month day", _WEEKDAY + _MONTH + r"\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4}),?(?:\s+at)?\s+" + _TIME + _ZONE),
        ("ctime", _WEEKDAY + _MONTH + r"\s+(?P<d>\d{1,2})\s+" + _TIME + r"(?P<zone>(?:\s+[a-z]+)?)\s+(?P<y>\d{4})"),
    )
)
_NUMBER = re.compile(r"([+-]?)0*(\d+)(?:\.(\d*))?\Z")
_OFFSET = re.compile(r"(?:utc|gmt)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?::?00)?\s*(?:\[(.+)\]|\((.+)\))?\Z")


@lru_cache(maxsize=1)
def _names() -> dict[str, str]:
    """All IANA names by their lower-case form."""
    return {name.lower(): name for name in sorted(available_timezones())}


@lru_cache(maxsize=1024)
def _known_zone(lowered: str):
    name = _names().get(lowered)
    return ZoneInfo(name) if name else None


def _zone(name: str):
    """The zone of an IANA name in any letter case, or None."""
    name = name.strip()
    return _known_zone(name.lower()) if len(name) <= _LONGEST_NAME else None


def _zones(text: str) -> tuple | None:
    """The zones that a suffix can mean: () for none given, None if it is no zone."""
    text = text.strip()
    # Whatever its length a suffix is judged; only the short ones, which repeat, are worth remembering.
    return _zones_of(text) if len(text) <= _LONGEST_NAME else _zones_of.__wrapped__(text)


@lru_cache(maxsize=4096)
def _zones_of(text: str) -> tuple | None:
    if not text:
        return ()
    if found := _OFFSET.match(text):
        minutes = int(found[2]) * 60 + int(found[3] or 0)
        if minutes > 18 * 60 or int(found[3] or 0) > 59:
            return None
        return (("", timezone(timedelta(minutes=-minutes if found[1] == "-" else minutes))),)
    if text[0] in "[(" and text[-1] in "])":
        text = text[1:-1].strip()
    if text in ABBREVIATIONS:
        several = len(ABBREVIATIONS[text]) > 1
        return tuple((f" {text}{m:+d}" if several else "", timezone(timedelta(minutes=m))) for m in ABBREVIATIONS[text])
    zone = _zone(text) if "/" in text else None
    return (("", zone),) if zone else None


def _micros(local: datetime, zone, fraction: str | None) -> int:
    # fold=0: the first occurrence of a repeated time, the offset before the change for a skipped one.
    span = local - _EPOCH - zone.utcoffset(local.replace(tzinfo=zone))
    return (span.days * 86400 + span.seconds) * 10**6 + int((fraction or "0")[:6].ljust(6, "0"))


def _counted(sign: str, whole: str, fraction: str) -> list[tuple[str, int]]:
    """The units in which a number of any length lies in the years looked for; what is below a microsecond is cut off."""
    # More digits before the point than nanoseconds need are beyond those years in every unit.
    if sign == "-" or len(whole) > 20:
        return []
    out = []
    for unit, power in _UNITS:
        digits = whole + fraction[: max(power, 0)].ljust(max(power, 0), "0")
        us = int(digits) if power >= 0 else int(digits) // 10**-power
        if _FROM <= us < _UNTIL:
            out.append((f"number {unit}", us))
    return out


def readings(text: str | None, home: str | None) -> list[tuple[str, int]]:
    """All (format, microseconds) that `text` can denote; `home` is the zone of zone-less values.

    Nothing if the date or the time of day is missing or impossible, or if neither the value nor `home`
    gives a zone.
    """
    if text is None:
        return []
    text = text.strip().lower()
    if number := _NUMBER.match(text):
        return _counted(number[1], number[2], number[3] or "")
    for name, pattern in _FORMATS:
        found = pattern.match(text)
        if found:
            break
    else:
        return []
    part = found.groupdict()
    hour, meridiem = int(part["h"]), (part["ap"] or "")[:1]
    if meridiem:
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + 12 * (meridiem == "p")
    zones = _zones(part["zone"] or "")
    if zones is None:
        return []
    if not zones:
        zone = _zone(home) if home else None
        if zone is None:
            return []
        zones = (("", zone),)
    year = int(part["y"])
    if "a" in part:
        a, b = int(part["a"]), int(part["b"])
        dates = [(" day first", b, a), (" month first", a, b)]
    else:
        month = int(part["m"]) if "m" in part else 1 + next(i for i, m in enumerate(MONTHS) if m[:3] == part["mon"][:3])
        dates = [("", month, int(part["d"]))]
    out = []
    for order, month, day in dates:
        try:
            local = datetime(year, month, day, hour, int(part["mi"]), int(part["s"] or 0))
        except ValueError:
            continue
        for suffix, zone in zones:
            try:
                out.append((name + order + suffix, _micros(local, zone, part.get("f"))))
            except OverflowError:
                continue
    return out
