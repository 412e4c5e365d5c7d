"""Distributed numbering, paging and fingerprints."""

import hashlib

from pyspark.sql import functions as F

from conftest import FACT_SCHEMA, fact
from covercost.operators import report as R
from covercost.operators import joins
from covercost.operators.joins import in_slices, number_within, splitters


def test_number_within_hot_group(spark):
    # one scope holds most rows and spans many partitions
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 10 == 0, F.lit("B")).otherwise(F.lit("A")).alias("scope"),
        F.format_string("k%06d", (F.col("id") * 7919) % 5000).alias("key")).repartition(13)
    out = number_within(df, ["scope"], ["key"]).collect()
    got = {(r["scope"], r["key"]): r["seq"] for r in out}
    for scope in ("A", "B"):
        keys = sorted(k for s, k in got if s == scope)
        assert [got[(scope, k)] for k in keys] == list(range(1, len(keys) + 1))


def test_number_within_null_scope(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b"), ("x", "c")], "scope string, key string")
    out = sorted((r["scope"] or "", r["key"], r["seq"]) for r in number_within(df, ["scope"], ["key"]).collect())
    assert out == [("", "a", 1), ("", "b", 2), ("x", "c", 1)]


def test_paging(spark):
    raw = spark.createDataFrame([fact(f"{i:04d}") for i in range(120)], FACT_SCHEMA)
    paged = R.paged_incidents(raw)
    assert sorted(r["pagina"] for r in paged.collect()) == [1] * 50 + [2] * 50 + [3] * 20
    c = R.page_counts(raw, current_page=5).first()
    assert (c["n_filas"], c["n_paginas"], c["pagina_actual"]) == (120, 3, 3)
    s = R.page_slice(raw, R.page_index(raw), "S1", "01-Enero", 3).collect()
    assert sorted(r["seq"] for r in s) == list(range(101, 121))
    assert R.page_slice(raw, R.page_index(raw), "S1", "01-Enero", 4).collect() == []
    deep = R.page_slice(raw, R.page_index(raw, 1), "S1", "01-Enero", 2, page_size=1).collect()
    assert [r["incidencia_id"] for r in deep] == ["0001"]


def test_fingerprint_matches_python(spark):
    raw = spark.createDataFrame([fact(f"{i:04d}", horas=1.5 * i) for i in range(3)], FACT_SCHEMA)
    fp = R.page_fingerprint(R.paged_incidents(raw)).first()["huella"]
    txt = "||".join(f"PEPE|Absentismo|2025-01-02|{1.5 * i}|10.0" for i in range(3))
    assert fp == hashlib.md5(txt.encode()).hexdigest()


def test_large_group_is_cut_into_slices(spark):
    """A group with 95 % of the rows, repeated and null order values: many slices, same numbers."""
    df = spark.range(0, 20_000).select(
        F.when(F.col("id") % 20 == 0, F.lit(None).cast("string")).otherwise("A").alias("scope"),
        F.when(F.col("id") % 501 != 0, F.format_string("k%06d", (F.col("id") * 7919) % 15_000)).alias("key")).repartition(11)
    rows = df.select(F.struct("scope").alias("_g"), F.col("key").alias("_at"))
    sizes = in_slices(rows, splitters(rows, 20)).groupBy("_g", "_slice").count().where("_g.scope = 'A'").collect()
    assert len(sizes) > 300 and max(r["count"] for r in sizes) < 19_000 / 50
    for seen in (df, df.repartition(3, "key")):
        out = number_within(seen, ["scope"], ["key"], slice_rows=20).collect()
        for scope in ("A", None):
            own = sorted(((r["seq"], r["key"]) for r in out if r["scope"] == scope))
            assert [n for n, _ in own] == list(range(1, len(own) + 1))
            keys = [k or "" for _, k in own]
            assert keys == sorted(keys)


def test_splitters_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_SPLITTERS", 7)
    df = spark.range(0, 500).select((F.col("id") % 2).alias("scope"), "id")
    parts = splitters(df.select(F.struct("scope").alias("_g"), F.col("id").alias("_at")), 1)
    assert sum(len(r["_splits"]) for part in parts for r in part.collect()) == 7
    out = number_within(df, ["scope"], ["id"], slice_rows=1)
    assert all(r["seq"] == r["id"] // 2 + 1 for r in out.collect())


def test_numbering_is_lazy(spark):
    """Building the plan runs no job and writes nothing; the rows are shuffled once, with their columns."""
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "lazy")
    out = R.paged_incidents(spark.createDataFrame([fact(i) for i in range(9)], FACT_SCHEMA).repartition(3))
    assert list(sc.statusTracker().getJobIdsForGroup("lazy")) == []
    wide = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_slice" in line]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert wide and plan.count("Exchange hashpartitioning(_g") <= 8 and "CartesianProduct" not in plan
    sc.setJobGroup("", "")


def test_page_range_reaches_the_scan(spark, tmp_path):
    raw = spark.createDataFrame([fact(f"{i:04d}") for i in range(120)], FACT_SCHEMA)
    raw.write.parquet(str(tmp_path / "facts"))
    R.page_index(raw).write.parquet(str(tmp_path / "index"))
    page = R.page_slice(spark.read.parquet(str(tmp_path / "facts")), spark.read.parquet(str(tmp_path / "index")), "S1", "01-Enero", 2)
    assert sorted(r["incidencia_id"] for r in page.collect()) == [f"{i:04d}" for i in range(50, 100)]
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    filters = [line for line in page._jdf.queryExecution().explainString(mode).splitlines() if line.startswith("PushedFilters") or line.startswith("DataFilters")]
    assert any("incidencia_id" in line and "subquery" in line.lower() for line in filters), filters
