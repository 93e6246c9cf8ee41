from __future__ import annotations

import random
from datetime import datetime, timedelta

from mnemolith.operators.history import version_history
from tests.helpers import rows

T0 = datetime(2025, 1, 1)
DDL = "id string, no int, received timestamp, status string, since string, by array<string>, version_no string"


def run(spark, data):
    found = version_history(spark.createDataFrame(data, DDL), key="id", number="no", received="received", attributes={"status": "text", "since": "instant", "by": "list"}, rows_per_leaf=2)
    return rows(found, "id", "version_no", "first", "last")


def brute(data):
    last: dict = {}
    for key, no, received, status, since, by, _ in data:
        if key is not None and no is not None:
            sig = ((status or "").strip().lower(), since or "", tuple(sorted({b.strip().lower() for b in by or [] if b and b.strip()})))
            last[key, no] = max(last.get((key, no), (datetime.min, ("",))), (received, sig), key=lambda x: (x[0], x[1]))
    out = []
    for key in {k for k, _ in last}:
        version, before = 0, None
        for no in sorted(n for k, n in last if k == key):
            sig = last[key, no][1]
            if before != (no - 1, sig):
                version += 1
                out.append([key, version, no, no])
            out[-1][3] = no
            before = (no, sig)
    return sorted((tuple(r) for r in out), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    data = []
    for i in range(40):
        for no in range(1, 9):
            if rng.random() < 0.8:
                for _ in range(rng.choice([1, 1, 2])):
                    data.append((f"k{i}", no, T0 + timedelta(seconds=rng.randrange(9999)), rng.choice(["a", " A", "b"]), rng.choice([None, ""]), rng.choice([None, [], ["x", "y"], ["y", "x", "x"]]), "clash"))
    assert run(spark, data) == brute(data)


def test_spellings_of_one_instant_and_gaps(spark):
    row = lambda no, since: ("a", no, T0, "s", since, None, "")
    data = [row(1, "2025-01-01T00:00:00Z"), row(2, "2025-01-01T01:00:00+01:00"), row(4, "2025-01-01T00:00:00Z"), row(5, "2025-01-02T00:00:00Z"), row(6, "odd"), row(7, " ODD "), (None, 1, T0, "", "", None, ""), ("a", None, T0, "", "", None, "")]
    assert run(spark, data) == [("a", 1, 1, 2), ("a", 2, 4, 4), ("a", 3, 5, 5), ("a", 4, 6, 7)]


def test_empty(spark):
    assert run(spark, []) == []
