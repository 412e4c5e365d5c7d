"""Marked incidents go without moving or enriching the others."""

import re

from conftest import FACT_SCHEMA, fact
from covercost.operators import edits as E
from covercost.operators.enrich import enrich
from covercost.plans import queries
from test_generated_code import conf


def test_marks_are_sent_to_the_incidents(spark, tiny):
    raw = spark.createDataFrame([fact(i) for i in (1, 2, 2, 3, 4)], FACT_SCHEMA)
    edits = spark.createDataFrame([("2", True), ("3", False), ("4", None), (None, True), ("2", True)], "incidencia_id string, borrar boolean")
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        kept = E.delete_marked(raw, edits)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin .*LeftAnti", plan) and "SortMergeJoin" not in plan
    # incidents that go needn't be enriched first
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(enrich(kept, tiny)) == rows(E.delete_marked(enrich(raw, tiny), edits)) and sorted(r[0] for r in kept.collect()) == ["1", "3", "4"]


def test_delete_marked_compares_incidents_before_they_are_enriched(spark, tiny, monkeypatch):
    raw = spark.createDataFrame([fact(1), fact(2)], FACT_SCHEMA)
    marked = spark.createDataFrame([("2", True)], "incidencia_id string, borrar boolean")
    seen = []

    class Held:
        incidencias, edits, masters = raw, marked, tiny
        facts = enrich(raw, tiny)

    monkeypatch.setattr(queries, "context", lambda s, d: Held)
    monkeypatch.setattr(queries.E, "delete_marked", lambda f, e, own=E.delete_marked: seen.append(f.columns) or own(f, e))
    got = queries.delete_marked(spark, "")
    assert got.columns == Held.facts.columns and [r[0] for r in got.collect()] == ["1"] and seen == [raw.columns]
