from __future__ import annotations

import pytest

from corpusmill.llm.queries import QUERIES, SQL
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, compare):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name,columns", [("p3_found", ["doc_id"]), ("p5_ids", ["doc_id", "ids"]), ("p6_containers", ["pack_id", "doc_id", "piece", "start", "tokens", "container"]), ("p7_found", ["doc_id"])])
def test_shape(name, columns, spark):
    df = QUERIES[name](spark, DATA)
    assert df.columns == columns and df.count() > 0
