"""Physical-plan properties that matter at scale."""


from conftest import FACT_SCHEMA, fact
from covercost.operators import pricing as P
from covercost.operators.enrich import enrich
from covercost.operators.joins import Dim, last_by
from covercost.operators.masters import Masters
from covercost.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dimension_joins_are_broadcast_and_no_python(spark, tiny):
    raw = spark.createDataFrame([fact(1)], FACT_SCHEMA)
    p = plan(P.export_costed(enrich(raw, tiny), tiny))
    assert p.count("BroadcastHashJoin") >= 4
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_large_dimension_is_not_broadcast(spark, tiny):
    # above the row bound the dimension is joined by shuffle, never hinted
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        m = Masters(spark, tiny.centros, tiny.trabajadores, tiny.tarifas, tiny.motivos,
                    excluded_supervisors=("EXCLUDED",), max_broadcast_rows=0)
        assert not m.worker_dim.broadcastable
        raw = spark.createDataFrame([fact(1)], FACT_SCHEMA)
        p = plan(enrich(raw, m))
        assert "SortMergeJoin" in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_last_wins_limits_before_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as k", "id as row_idx")
    p = plan(last_by(df, ["k"], ["row_idx"]))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_scan_prunes_and_pushes(spark):
    inc = fx.incidencias(spark, SF)
    p = inc.select("incidencia_id", "incidencia_horas").filter("incidencia_horas >= 45")._jdf \
        .queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in p            # unused column not read
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,45.0)" in p


def test_summary_single_shuffle(spark, tiny):
    raw = spark.createDataFrame([fact(1)], FACT_SCHEMA)
    p = plan(P.summary_by_scope(enrich(raw, tiny), tiny))
    # the fact is shuffled once, on the scope, after a partial aggregate ...
    assert p.count("Exchange hashpartitioning(session_jefe") == 1 and "partial_sum" in p
    # ... and never on a dimension key (dimensions are broadcast)
    for key in ("(trabajador", "(_dest", "(_cat"):
        assert f"Exchange hashpartitioning{key}" not in p


def test_dim_counts_once(spark, tiny):
    d = Dim(tiny.account_dim.df, "x", max_rows=10)
    assert d.rows == 4 and d.broadcastable


def test_hot_worker_is_split_when_dimension_is_shuffled(spark, tiny):
    """Above the broadcast bound, a worker holding most incidents is split by AQE."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        m = Masters(spark, tiny.centros, tiny.trabajadores, tiny.tarifas, tiny.motivos,
                    excluded_supervisors=("EXCLUDED",), max_broadcast_rows=0)
        rows = [fact(i, worker="PEPE" if i % 20 else "MARIA") for i in range(4000)]
        df = enrich(spark.createDataFrame(rows, FACT_SCHEMA).repartition(8), m)
        got = df.groupBy("trabajador").count().collect()
        assert {r["trabajador"]: r["count"] for r in got} == {"PEPE": 3800, "MARIA": 200}
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in final
        assert "SortMergeJoin(skew=true)" in final
    finally:
        for k in conf:
            spark.conf.unset(k)
