"""Generated methods over the JIT's limit of 8000 bytes run interpreted."""

import contextlib
import datetime as dt
import io
import re

import pytest

from covercost.functions import normalize as N
from covercost.plans import queries


@contextlib.contextmanager
def conf(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_row_cost_stays_below_the_limit_of_the_jit(spark, tmp_path):
    day = dt.datetime(2025, 1, 2)
    tables = {
        "nation": ([(1, "NATION_9")], "n_nationkey int, n_name string"),
        "supplier": ([(1, "S", 1, 5.0), (2, "T", 1, 5.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "customer": ([(1, "C", 1, 100.0, "BUILDING"), (2, "D", 1, 200.0, "FURNITURE")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": ([(1, "P", "Brand#2", "ECONOMY", 1, 900.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(1, 1, "1-URGENT"), (2, 2, "2-HIGH")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(1, 1, 1, 1, 2.0, 0.05, 0.01, "A", "O", day), (2, 1, 2, 2, 3.0, 0.0, 0.02, "N", "O", day)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    df = queries.row_cost(spark, str(tmp_path))
    assert df.count() == 2
    out = io.StringIO()
    with conf(spark, **{"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.hugeMethodLimit": "65535"}), contextlib.redirect_stdout(out):
        df.select("*").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) <= 8000


@pytest.mark.parametrize("text, want", [("h ASL", "ASL"), ("H  ASL", " ASL"), ("asl", "ASL"), (" g Cocina ", "COCINA"), ("é x", "X"), ("𝔸 x", "X"), ("a", "A"), ("", ""), (None, ""), ("a\nb c", "A\nB C"), ("a  ", "A")])
def test_incident_category(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(N.incident_category("c")).first()[0] == want
