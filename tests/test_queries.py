"""Every query of the core against its SQL, and queries without SQL for their shape."""

from __future__ import annotations

import pytest

from corpusmill.plans import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, compare):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0
