from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemolith.operators.asof import as_known_at
from tests.helpers import rows

T0 = datetime(2025, 1, 1)
EVENTS = "event long, entity string, at timestamp, status string"
CHANGES = "entity string, taken timestamp, received timestamp, status string, event long"


def run(spark, events, changes, **options):
    found = as_known_at(
        spark.createDataFrame(events, EVENTS), spark.createDataFrame(changes, CHANGES), entity="entity", event_time=F.col("at"), known_at=F.col("received"), rank_by=F.col("taken"), versions=["status"], **options
    )
    return rows(found, "event", "known_status", "is_known")


def brute(events, changes):
    out = []
    for event, entity, at, _ in events:
        known = [c for c in changes if None not in (entity, at, c[2]) and c[0] == entity and c[2] <= at]
        best = max(known, key=lambda c: (c[1] or datetime.min, c[2], c[3] is not None, c[3] or ""), default=None)
        out.append((event, best[3] if best else None, best is not None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_per_block", [5, 60, 10_000])
def test_against_brute_force_with_a_hot_entity(spark, rows_per_block):
    rng = random.Random(rows_per_block)
    when = lambda: T0 + timedelta(hours=rng.randrange(60))
    entity = lambda: "hot" if rng.random() < 0.4 else f"e{rng.randrange(6)}"
    events = [(i, entity(), when(), "other") for i in range(120)]
    changes = [(entity(), when(), when(), rng.choice(["a", "b", None]), 1) for _ in range(150)]
    changes += changes[:20]
    assert run(spark, events, changes, rows_per_block=rows_per_block) == brute(events, changes)


def test_crowded_instants_are_one_row_each(spark):
    events = [(i, "hot", T0, "") for i in range(50)] + [(99, "cold", T0, "")]
    changes = [("hot", T0, T0, "v", 0), ("cold", T0, T0 - timedelta(hours=1), "w", 0)]
    changes += [("hot", T0 - timedelta(days=i), T0, f"v{i}", 0) for i in range(60)]
    assert run(spark, events, changes, rows_per_block=3) == brute(events, changes)


def test_clashing_names(spark):
    events = spark.createDataFrame([("a", T0, 1, "x", True, "y")], "entity string, at timestamp, _key int, known_status string, is_known boolean, `e.0` string")
    changes = spark.createDataFrame([("a", T0, T0, "s", 0)], CHANGES)
    found = as_known_at(events, changes, entity="entity", event_time=F.col("at"), known_at=F.col("received"), rank_by=F.col("taken"), versions=["status"])
    assert found.columns == ["entity", "at", "_key", "e.0", "known_status", "is_known"] and tuple(found.first())[2:] == (1, "y", "s", True)


def test_nulls_and_ties(spark):
    events = [(1, None, T0, ""), (2, "a", None, ""), (3, "a", T0, ""), (4, "b", T0, ""), (4, "b", T0, "")]
    changes = [("a", None, T0, "old", 0), ("a", T0, None, "never", 0), (None, T0, T0, "x", 0), ("b", T0, T0, "k", 0), ("b", T0, T0, "z", 0)]
    assert run(spark, events, changes) == [(1, None, False), (2, None, False), (3, "old", True), (4, "z", True), (4, "z", True)]


def test_empty(spark):
    assert run(spark, [], [("a", T0, T0, "x", 0)]) == []
    assert run(spark, [(1, "a", T0, "")], []) == [(1, None, False)]
