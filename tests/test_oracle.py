"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, SF, name, E.queries()[name], E.oracle_sql().get(name), con)
    assert res["status"] in ("ok", "rows-only"), res


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "total_con_ss" in df.columns
