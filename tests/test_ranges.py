"""Large inputs are taken range by range of incident ids: the same results, and nothing but the result is left on disk."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from covercost.operators import joins as J
from covercost.operators import report as R
from covercost.plans import queries as Q
from covercost.plans.context import context
from covercost.session import ensure_checkpoint_dir
from tests.conftest import FACT_SCHEMA, fact
from tests.oracle_check import compare, duck

TABLES = {
    "nation": "select i as n_nationkey, 'NATION_' || i as n_name, 0 as n_regionkey from range(5) t(i)",
    "supplier": "select i as s_suppkey, 'Supplier ' || i as s_name, i % 5 as s_nationkey, 10.0 * i - 20 as s_acctbal from range(1, 21) t(i)",
    "customer": "select i as c_custkey, 'Customer ' || i as c_name, i % 5 as c_nationkey, 100.5 * i as c_acctbal, case i % 3 when 0 then 'BUILDING' when 1 then 'HOUSEHOLD' else 'MACHINERY' end as c_mktsegment from range(1, 31) t(i)",
    "part": "select i as p_partkey, 'Part ' || i as p_name, 'Brand#' || i % 5 as p_brand, case i % 2 when 0 then 'ECONOMY' else 'STANDARD' end as p_type, i % 9 as p_size, 90.0 + i as p_retailprice from range(1, 31) t(i)",
    "orders": "select i as o_orderkey, 1 + i % 30 as o_custkey, 'O' as o_orderstatus, 1.0 as o_totalprice, timestamp '1995-01-01' as o_orderdate, ['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'][1 + i % 4] as o_orderpriority from range(1, 301) t(i)",
    "lineitem": """select 1 + i // 4 as l_orderkey, 1 + i * 7 % 30 as l_partkey, 1 + i * 3 % 20 as l_suppkey, (1 + i % 4)::int as l_linenumber, (1 + i * 11 % 50)::double as l_quantity,
        1.0 as l_extendedprice, (i % 11) / 100 as l_discount, (i % 9) / 100 as l_tax, ['A', 'N', 'R'][1 + i % 3] as l_returnflag, ['F', 'O'][1 + i % 2] as l_linestatus,
        timestamp '1995-01-10' + interval (i % 3) month as l_shipdate from range(1200) t(i)""",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    for name, sql in TABLES.items():
        duckdb.sql(f"copy ({sql}) to '{d}/{name}.parquet' (format parquet)")
    return d


@pytest.fixture
def ranges(spark, tables):
    """The tables in two ranges of ids, the kept sessions in batches of 500 rows."""
    size = J.input_bytes(context(spark, tables).incidencias)
    spark.conf.set("covercost.pass.bytes", str(size // 2 + 1))
    spark.conf.set("covercost.edited.rows", "500")
    os.utime(f"{tables}/nation.parquet")  # another version: the context is built anew
    yield tables
    spark.conf.unset("covercost.pass.bytes")
    spark.conf.unset("covercost.edited.rows")
    os.utime(f"{tables}/nation.parquet")


@pytest.mark.parametrize("name, left", [("paged_incidents", {"paged"}), ("stored_page", {"kept"}), ("stored_clear", {"kept"}), ("stored_edits", {"kept"}),
                                        ("totals_after_edits", {"totals", "deltas"}), ("manifest_states", {"last", "now", "same"}),
                                        ("page_changes", {"changed"}), ("repriced_pages", {"repriced"})])
def test_ranges_give_the_whole_result_and_leave_nothing_else(spark, ranges, name, left):
    assert len(context(spark, ranges).cuts) == 1
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = compare(spark, ranges, name, entry.queries()[name], entry.oracle_sql()[name], duck(ranges))
    assert got["status"] == "ok" and got["rows_spark"] > 1
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before} == left


def test_all_changed_pages_are_repriced(spark, tables):
    """Every kind of edit counts: the pages with deleted incidents, or others' hours, too."""
    pages = {r.pagina for r in Q.page_changes(spark, tables).where("estado <> 'removed' and session_jefe = 'SUP1'").select("pagina").collect()}
    assert pages == {r.pagina for r in Q.repriced_pages(spark, tables).where("session_jefe = 'SUP1'").select("pagina").collect()} and len(pages) > 1


def test_numbers_go_on_and_cut_pages_are_joined(spark):
    rows = [fact(f"{i:03d}", jefe=j, horas=float(i)) for i in range(70) for j in ("S1", "S2", None) if j != "S2" or i >= 30]
    df = spark.createDataFrame(rows, FACT_SCHEMA)
    low, high = (df.where(J.in_range("incidencia_id", *x)) for x in ((None, "033"), ("033", None)))
    want, last = R.paged_incidents(df), R.last_positions(low)
    parts = [R.paged_incidents(low, slice_rows=3), R.paged_incidents(high, slice_rows=3, given=last)]
    assert sorted(map(repr, parts[0].unionByName(parts[1]).collect())) == sorted(map(repr, want.collect()))
    pages = R.joined_pages(R.page_parts(parts[0]).unionByName(R.page_parts(parts[1])))
    assert sorted(map(repr, pages.collect())) == sorted(map(repr, R.page_fingerprint(want).collect()))
    assert {(r.session_jefe, r.ultima) for r in R.last_positions(high, last).collect()} == {("S1", 70), ("S2", 40), (None, 70)}


def test_a_null_lies_in_the_first_range(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",), ("c",)], "x string")
    got = [[r.x for r in df.where(J.in_range("x", *b)).collect()] for b in ((None, "b"), ("b", "c"), ("c", None))]
    assert got == [[None, "a"], ["b"], ["c"]] and df.where(J.in_range("x", None, None)).count() == 4


def test_manifests_leave_out_incidents_without_a_month(spark, tmp_path):
    for name, sql in TABLES.items():
        sql = sql.replace("timestamp '1995-01-10'", "case when i % 7 <> 0 then timestamp '1995-01-10' end")
        duckdb.sql(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    got = compare(spark, str(tmp_path), "manifest_states", Q.manifest_states, entry.oracle_sql()["manifest_states"], duck(str(tmp_path)))
    assert got["status"] == "ok"
