"""The queries of the subpackage against their SQL."""

import pytest

from compare import duck_rows, spark_rows
from tarnwell.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns, want = duck_rows(duck, ORACLES[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() >= 0
