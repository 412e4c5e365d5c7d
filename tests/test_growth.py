"""Queries that read their incidents several times join the tables behind them once."""

import pytest
from pyspark.sql import functions as F

from covercost.operators import edits as E
from covercost.operators import pricing as P
from covercost.operators import report as R
from covercost.operators.enrich import enrich
from covercost.plans import queries as Q
from covercost.sources import kept as K
from tests.conftest import FACT_SCHEMA, fact


@pytest.fixture
def calls(spark, tiny):
    """Facts of which each evaluated row is counted."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    raw = spark.createDataFrame([fact(i, horas=float(i)) for i in range(40)], FACT_SCHEMA)
    facts = enrich(raw, tiny).repartition(2)
    return seen, facts.mapInArrow(count, facts.schema)


def test_kept_facts_are_evaluated_once(spark, calls, tmp_path):
    seen, facts = calls
    K.save(facts, str(tmp_path))
    assert seen.value == 40
    assert K.load(spark, str(tmp_path)).count() == 40
    assert [r.ultima for r in K.marks(spark, str(tmp_path)).collect()] == [40]


def test_appended_rows_are_evaluated_once(spark, calls, tmp_path, tiny):
    seen, facts = calls
    K.save(enrich(spark.createDataFrame([fact("a"), fact("b")], FACT_SCHEMA), tiny), str(tmp_path))
    K.append(spark, str(tmp_path), facts, ["incidencia_id"])
    assert seen.value == 40
    assert sorted(r.seq for r in K.load(spark, str(tmp_path)).collect()) == list(range(1, 43))


def test_page_digests_are_evaluated_once(spark, calls, tiny):
    seen, facts = calls
    digests = R.page_fingerprint(facts.select("*", F.col("incidencia_horas").cast("long").alias("seq"), F.lit(1).cast("long").alias("pagina")))
    edits = spark.createDataFrame([("7", "9")], "incidencia_id string, incidencia_horas string")
    after = E.apply_edits(enrich(spark.createDataFrame([fact(i, horas=float(i)) for i in range(40)], FACT_SCHEMA), tiny), edits, tiny)
    changed = R.changed_pages(digests, R.page_fingerprint(R.paged_incidents(after))).collect()
    assert seen.value == 40
    assert [r.estado for r in changed] == ["changed"]


def test_edited_incidents_are_evaluated_once(spark, calls, tiny):
    seen, facts = calls
    edits = spark.createDataFrame([("7", "9")], "incidencia_id string, incidencia_horas string")
    P.edit_deltas(facts, edits, tiny).collect()
    assert seen.value == 40


@pytest.mark.parametrize("query", [Q.page_changes, Q.repriced_pages, Q.append_intake])
def test_numbered_queries_join_the_tables_once(spark, query):
    """What is numbered comes from written rows: no plan that is left joins line items and orders."""
    out = query(spark, "/root/testdata/sf0.001")
    assert "l_orderkey" not in out._jdf.queryExecution().optimizedPlan().toString()
