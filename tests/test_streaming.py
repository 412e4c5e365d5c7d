"""The streaming re-aim gives the batch totals."""

import tempfile

from covercost.operators import pricing as P
from covercost.plans.context import context
from covercost.streaming import costing_stream as CS

SF = "/root/testdata/sf0.001"


def test_stream_totals_equal_batch(spark):
    c = context(spark, SF)
    src = tempfile.mkdtemp(prefix="covercost-stream-src-", dir="/tmp")
    c.incidencias.repartition(4).write.mode("overwrite").parquet(src)
    q = CS.start_totals(spark, CS.incident_stream(spark, src, max_files_per_trigger=2), c.masters, "totals_test")
    try:
        q.processAllAvailable()
        got = {(r["session_jefe"], r["imputacion_nomina"]): r["total_con_ss"]
               for r in spark.table("totals_test").collect()}
    finally:
        q.stop()
    want = {(r["session_jefe"], r["imputacion_nomina"]): r["total_con_ss"]
            for r in P.summary_by_scope(c.facts, c.masters).collect()}
    assert got == want


def test_costed_stream_is_append_capable(spark):
    c = context(spark, SF)
    src = tempfile.mkdtemp(prefix="covercost-stream-src-", dir="/tmp")
    c.incidencias.limit(100).write.mode("overwrite").parquet(src)
    s = CS.costed_stream(CS.incident_stream(spark, src), c.masters)
    assert s.isStreaming
    q = s.writeStream.format("memory").queryName("costed_test").outputMode("append").start()
    try:
        q.processAllAvailable()
        n = spark.table("costed_test").count()
    finally:
        q.stop()
    assert 0 < n <= 100
