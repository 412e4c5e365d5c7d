"""Edits (upsert, re-enrichment, delete) and bulk intake."""

import pytest

from conftest import FACT_SCHEMA, fact
from covercost.operators import edits as E
from covercost.operators import intake as I
from covercost.operators.enrich import enrich

EDIT_SCHEMA = ("incidencia_id string, borrar boolean, trabajador string, motivo string, "
               "codigo_crown_destino string, incidencia_horas string")


@pytest.fixture(scope="module")
def facts(spark, tiny):
    raw = spark.createDataFrame([fact(1), fact(3, worker="MARIA", dest="", motivo="Refuerzo"), fact(5),
                                 fact(6, worker="JUAN", dest="101")], FACT_SCHEMA)
    return enrich(raw, tiny)


@pytest.fixture(scope="module")
def edits(spark):
    return spark.createDataFrame([
        ("1", False, "MARIA", "Absentismo", "101.0", "3"),     # worker change -> re-enrich
        ("3", True, "MARIA", "Refuerzo", "102", "2"),          # delete
        ("5", False, "PEPE", " nan ", "10.05", "bad"),         # text and number cleaning
        ("6", False, "NADIE", "Absentismo", "101", "1"),       # unknown worker keeps old attributes
    ], EDIT_SCHEMA)


def test_apply_edits(facts, edits, tiny):
    out = {r["incidencia_id"]: r for r in E.apply_edits(facts, edits, tiny).collect()}
    assert set(out) == {"1", "5", "6"}
    r1 = out["1"]
    assert (r1["trabajador"], r1["categoria"], r1["codigo_crown_destino"], r1["nombre_crown_destino"],
            r1["coste_hora"], r1["incidencia_horas"]) == ("MARIA", "Camarera", "101", "Centro Uno", 0.0, 3.0)
    r5 = out["5"]
    assert (r5["motivo"], r5["codigo_crown_destino"], r5["incidencia_horas"]) == ("nan", "105", 0.0)
    assert r5["categoria"] == "g Cocina"             # same worker: no re-enrichment
    r6 = out["6"]
    assert r6["trabajador"] == "NADIE" and r6["categoria"] == "limpieza"


def test_delete_and_flags(facts, edits):
    kept = {r[0] for r in E.delete_marked(facts, edits).select("incidencia_id").collect()}
    assert kept == {"1", "5", "6"}
    flags = {r["incidencia_id"]: r for r in E.edit_change_flags(facts, edits).collect()}
    assert flags["3"]["borrar"] and flags["3"]["cambiado"]
    assert flags["1"]["cambia_trabajador"] and not flags["5"]["cambia_trabajador"]
    assert flags["5"]["cambiado"]


def test_intake(spark, tiny):
    req = spark.createDataFrame([
        (1, "S1", "01-Enero", "centro", "102", "", "101", 1),
        (2, "S1", "01-Enero", "trabajador", "", "102 - JUAN", "101,,102", 3),
        (3, "S1", "01-Enero", "trabajador", "", "MARIA", ",".join(["101"] * 11), 1),
        (4, "S2", "01-Enero", "trabajador", "", "", "101", 1),
        (5, "S2", "01-Enero", "centro", "102", "", "101,,102", 1),
        (6, "S2", "01-Enero", "centro", "", "", "101", 1),
        (7, "S2", "01-Enero", "centro", "102", "", "", 1),
    ], "request_id long, session_jefe string, imputacion_nomina string, kind string, centro_origen string, "
       "trabajador string, destinos_csv string, num_rows long")
    by_centre = I.intake_by_centre(req, tiny).collect()
    assert sorted(r["trabajador"] for r in by_centre if r["request_id"] == 1) == ["MARIA", "PEPE"]
    assert all(r["facturable"] == "" for r in by_centre)
    # every listed destination, for every worker
    assert sorted((r["trabajador"], r["codigo_crown_destino"]) for r in by_centre if r["request_id"] == 5) == [
        ("MARIA", "101"), ("MARIA", "102"), ("PEPE", "101"), ("PEPE", "102")]
    rejected = {r["request_id"]: r["motivo_rechazo"] for r in I.intake_rejected(req).collect()}
    assert rejected == {3: "demasiados_destinos", 4: "sin_trabajador", 6: "sin_centro_origen", 7: "sin_destino"}
    accepted = {r["request_id"] for r in by_centre + I.intake_by_worker(req, tiny).collect()}
    assert accepted | set(rejected) == set(range(1, 8)) and not accepted & set(rejected)
    by_worker = I.intake_by_worker(req, tiny).collect()
    assert sorted(r["codigo_crown_destino"] for r in by_worker) == ["101", "102"]   # blank skipped, 11 refused
    assert all(r["trabajador"] == "JUAN" and r["codigo_crown_origen"] == "" for r in by_worker)
    rep = I.intake_replicate(req, tiny).collect()
    assert sum(r["request_id"] == 2 for r in rep) == 6 and all(r["request_id"] != 4 for r in rep)


def test_null_scope_and_repeated_edits(spark, tiny, facts):
    from pyspark.sql import functions as F
    from covercost.operators import quality as Q
    blank = facts.withColumn("session_jefe", F.lit(None).cast("string"))
    assert Q.invalid_reasons(blank).count() == Q.invalid_reasons(facts.withColumn("session_jefe", F.lit("S"))).count() > 0
    req = spark.createDataFrame([(1, None, "01-Enero", "centro", "102", "", "101", 1)],
                                "request_id long, session_jefe string, imputacion_nomina string, kind string, "
                                "centro_origen string, trabajador string, destinos_csv string, num_rows long")
    seqs = [r["seq"] for r in I.append_intake(blank, I.intake_by_centre(req, tiny)).collect()]
    assert sorted(seqs) == list(range(1, len(seqs) + 1))
    twice = spark.createDataFrame([("5", 1, "2"), ("5", 2, "3"), (None, 3, "4")], "incidencia_id string, edit_seq int, incidencia_horas string")
    out = E.apply_edits(facts, twice, tiny).collect()
    assert len(out) == facts.count() and [r["incidencia_horas"] for r in out if r["incidencia_id"] == "5"] == [3.0]


def test_append_and_clear(spark, tiny, facts):
    req = spark.createDataFrame([(1, "S1", "01-Enero", "centro", "102", "", "101", 1)],
                                "request_id long, session_jefe string, imputacion_nomina string, kind string, "
                                "centro_origen string, trabajador string, destinos_csv string, num_rows long")
    out = I.append_intake(facts, I.intake_by_centre(req, tiny)).collect()
    seqs = sorted(r["seq"] for r in out)
    assert seqs == list(range(1, len(out) + 1))       # new rows continue after existing ones
    assert I.clear_scope(facts, "S1", "01-Enero").count() == 0


def test_edits_from_view_round_trip(spark, tiny, facts):
    from covercost.operators import report as R
    view = R.edit_view(R.working_view(facts, tiny)).filter("incidencia_id = '5'")
    e = E.edits_from_view(view.withColumn("Motivo", view["Motivo"]).withColumn("Borrar", view["Borrar"]))
    assert "trabajador" in e.columns and "precio_nocturnidad" not in e.columns
    out = {r["incidencia_id"]: r for r in E.apply_edits(facts, e, tiny).collect()}
    before = {r["incidencia_id"]: r for r in facts.collect()}
    # saving an unchanged page leaves the row as it was
    assert out["5"].asDict() == before["5"].asDict()
