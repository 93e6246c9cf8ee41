"""Every query that has SQL gives the SQL's rows; every other one runs."""

from __future__ import annotations

from collections import Counter

import pytest

from mnemolith.queries import problems, reference
from tests.helpers import SF, oracle

QUERIES = problems.QUERIES | reference.QUERIES
ORACLES = problems.SQL | reference.SQL


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    assert Counter(repr(tuple(r)) for r in df.collect()) == oracle(ORACLES[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
