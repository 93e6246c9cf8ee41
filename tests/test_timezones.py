from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo, available_timezones

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemolith.functions.timestamps import readings
from mnemolith.operators.timezones import mixture, normalised
from tests.helpers import rows


def us(*parts, micro=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 10**6 + micro


CASES = [
    (" 2024-02-19T20:05:34Z  ", None, us(2024, 2, 19, 20, 5, 34)),
    ("2024-02-19t08:08:55z", None, us(2024, 2, 19, 8, 8, 55)),
    ("26 February 2024 21:24:37 UTC", None, us(2024, 2, 26, 21, 24, 37)),
    ("2024-02-15T02:34:36", "Asia/Kathmandu", us(2024, 2, 14, 20, 49, 36)),
    ("1709043847028977", None, 1709043847028977),
    ("1707896036916", None, 1707896036916000),
    ("1707811299.575", None, 1707811299575000),
    ("1708782391", None, 1708782391000000),
    ("1709043847028977123", None, 1709043847028977),
    ("20240215T215320Z", None, us(2024, 2, 15, 21, 53, 20)),
    ("2024/02/24 05:40", "UTC", us(2024, 2, 24, 5, 40)),
    ("12.02.2024 03:36:53", "Europe/Berlin", us(2024, 2, 12, 2, 36, 53)),
    ("02/21/2024 06:30:44 AM", "America/New_York", us(2024, 2, 21, 11, 30, 44)),
    ("02/11/2024 12:51:29 PM", "UTC", us(2024, 2, 11, 12, 51, 29)),
    ("02/11/2024 12:51:29 AM", "UTC", us(2024, 2, 11, 0, 51, 29)),
    ("2024-02-21 19:17:54,161+00:00", None, us(2024, 2, 21, 19, 17, 54, micro=161000)),
    ("2024-02-23T08:37:28.764276999+09:00", None, us(2024, 2, 22, 23, 37, 28, micro=764276)),
    ("2024-02-23 09:36:52+0545", None, us(2024, 2, 23, 3, 51, 52)),
    ("Fri, 16 Feb 2024 07:25:47 +0900", None, us(2024, 2, 15, 22, 25, 47)),
    ("2024-03-04T14:06+11:00", None, us(2024, 3, 4, 3, 6)),
    ("2024-02-27T18:58:07[Asia/Kolkata]", "UTC", us(2024, 2, 27, 13, 28, 7)),
    ("2024-02-26T15:52:09-08", None, us(2024, 2, 26, 23, 52, 9)),
    ("Feb 26, 2024 05:50 PM", "Asia/Tokyo", us(2024, 2, 26, 8, 50)),
    ("2024-04-08 18:49:36 CEST", "Asia/Tokyo", us(2024, 4, 8, 16, 49, 36)),
    ("2024-03-22 02:09:37 PDT", None, us(2024, 3, 22, 9, 9, 37)),
    # A time that occurs twice means its first occurrence; one that is skipped has the offset before the change.
    ("2024-11-03 01:30:00", "America/New_York", us(2024, 11, 3, 5, 30)),
    ("2024-03-10 02:30:00", "America/New_York", us(2024, 3, 10, 7, 30)),
    ("2024-10-27T02:30:00[Europe/Berlin]", None, us(2024, 10, 27, 0, 30)),
]
NONE = [None, "", "unknown", "n/a", "12:45", "2025-03-04", "0000-00-00 00:00:00", "2024-02-30 10:00:00Z", "2024-02-03 25:00:00Z", "2024-02-03 10:61:00Z", "02/11/2024 13:51:29 PM", "99", "2024-02-15T02:34:36", "2024-02-15T02:34:36 Nowhere/City", "x" * 100_000, "1" * 100_000]


@pytest.mark.parametrize(("text", "home", "expected"), CASES)
def test_reading(text, home, expected):
    found = readings(text, home)
    assert expected in {u for _, u in found}
    if "." not in text[:3] and "/" not in text[:3]:
        assert len(found) == 1


@pytest.mark.parametrize("text", NONE)
def test_no_instant(text):
    assert readings(text, None) == []


def test_mixture_learns_the_order_of_a_source():
    both, first = ("slashed day first", "slashed month first"), ("slashed day first",)
    out = mixture(pd.DataFrame({"formats": [both, first], "n": [50, 50]}), {})
    assert list(out["format"]) == ["slashed day first"] * 2 and out["posterior"].iloc[0] > 0.9
    even = mixture(pd.DataFrame({"formats": [both], "n": [50]}), {})
    assert even["posterior"].iloc[0] == pytest.approx(0.5)


def test_operator(spark):
    data = [("s", t, h) for t, h, _ in CASES] + [("s", t, None) for t in NONE] + [("s", "2024-02-19T20:05:34.123456Z", None), ("s", "13.25.2024 10:00:00", "UTC"), ("amb", "2024-02-26 10:00:00 IST", None)]
    df = spark.createDataFrame(data, "src string, value string, home string").withColumns({"epoch_us": F.lit("clash"), "format": F.lit("clash"), "readings": F.lit("clash")})
    found = normalised(df, value="value", home="home", source=["src"])
    got = {(r.value, r.home): r for r in found.collect()}
    for text, home, expected in CASES:
        assert got[text, home].epoch_us == expected
    assert all(got[t, None].epoch_us is None for t in NONE)
    assert got["2024-02-19T20:05:34.123456Z", None].format == "canonical"
    assert got["13.25.2024 10:00:00", "UTC"].epoch_us is None
    assert got["2024-02-26 10:00:00 IST", None].ambiguous
    assert sum(r.ambiguous for r in got.values()) == 1
    assert rows(normalised(df.limit(0), value="value", home="home", source=["src"])) == []
    with pytest.raises(ValueError):
        normalised(df, value="value", home="format", source=["src"])


def test_no_length_is_too_long():
    assert readings("1704067200." + "0" * 40, None) == [("number s", us(2024, 1, 1))]
    assert readings("0" * 5000 + "1704067200", None) == [("number s", us(2024, 1, 1))]
    assert readings("1704067200." + "9" * 9000, None) == [("number s", us(2024, 1, 1, micro=999999))]
    assert readings("2024-01-01T00:00:00." + "1" * 9000 + "Z", None) == [("ymd", us(2024, 1, 1, micro=111111))]
    assert readings("2024-01-01 00:00:00" + " " * 9000 + "CET", None) == [("ymd", us(2023, 12, 31, 23))]


@pytest.mark.parametrize("change", [str.lower, str.upper, str.swapcase])
def test_every_zone_name_is_found_in_any_case(change):
    names = [n for n in available_timezones() if "/" in n]
    assert {"Africa/Dar_es_Salaam", "America/Port-au-Prince", "Antarctica/McMurdo", "Etc/GMT+5"} <= set(names)
    for name in names:
        local = datetime(2024, 6, 1, 12, tzinfo=ZoneInfo(name))
        want = int(local.timestamp()) * 10**6
        assert {u for _, u in readings(f"2024-06-01T12:00:00[{change(name)}]", None)} == {want}, name
        assert {u for _, u in readings("2024-06-01 12:00:00", change(name))} == {want}


def test_sources_without_conventions_are_told_apart_by_their_values(spark):
    # Two sources write one spelling in two orders; most of their values fit both.
    data = [(s, f"{a:02d}/{b:02d}/2024 10:00:00", "UTC") for s in ("days first", "months first") for d in range(1, 29) for m in (2, 5, 9) for a, b in ([(d, m)] if s == "days first" else [(m, d)])]
    found = normalised(spark.createDataFrame(data, "src string, value string, home string"), value="value", home="home", source=["src"], conventions={})
    for r in found.collect():
        a, b = int(r.value[:2]), int(r.value[3:5])
        assert r.epoch_us == us(2024, *((b, a) if r.src == "days first" else (a, b)), 10) and not r.ambiguous
