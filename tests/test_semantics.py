"""Decisions of SURVEY §2.13 that are easy to get wrong."""

import hashlib

from pyspark.sql import functions as F

from conftest import FACT_SCHEMA, fact
from covercost.operators import edits as E
from covercost.operators import quality as Q
from covercost.operators import report as R
from covercost.operators.enrich import enrich
from covercost.operators.masters import Masters, worker_dim

EDIT_SCHEMA = ("incidencia_id string, borrar boolean, trabajador string, motivo string, "
               "codigo_crown_destino string, incidencia_horas string")


def test_t7_destination_only_edit_keeps_stale_name(spark, tiny):
    facts = enrich(spark.createDataFrame([fact(1, dest="102")], FACT_SCHEMA), tiny)
    edits = spark.createDataFrame([("1", False, "PEPE", "Absentismo", "101", "2")], EDIT_SCHEMA)
    kept = E.apply_edits(facts, edits, tiny).first()
    assert kept["codigo_crown_destino"] == "101" and kept["nombre_crown_destino"] == "Centro Dos"
    fresh = E.apply_edits(facts, edits, tiny, refresh_destination_name=True).first()
    assert fresh["nombre_crown_destino"] == "Centro Uno"


def test_t15_whitespace_is_valid(spark):
    df = spark.createDataFrame([fact(1, worker=" ", fecha=" ")], FACT_SCHEMA)
    assert Q.valid_incidents(df).count() == 1


def test_t22_nan_cost_becomes_zero(spark, tiny):
    w = tiny.trabajadores.withColumn("coste_hora", F.when(F.col("row_idx") == 4, F.lit(float("nan")))
                                     .otherwise(F.col("coste_hora")))
    m = Masters(spark, tiny.centros, w, tiny.tarifas, tiny.motivos, excluded_supervisors=("EXCLUDED",))
    pepe = m.worker_dim.df.filter("nombre_empleado = 'PEPE'").first()
    assert pepe["coste_hora"] == 0.0


def test_t23_null_prints_none_in_fingerprint(spark):
    df = spark.createDataFrame([fact("a", motivo=None)], FACT_SCHEMA)
    fp = R.page_fingerprint(R.paged_incidents(df)).first()["huella"]
    assert fp == hashlib.md5(b"PEPE|None|2025-01-02|2.0|10.0").hexdigest()


def test_t5_t6_first_match_name_last_match_attributes(tiny):
    # centre 101 appears twice: the destination name is the first row's,
    # while the worker keeps the attributes of its last fan-out row
    cf = {r["cod_centro_preferente"]: r["desc_centro_preferente"] for r in tiny.centre_first.df.collect()}
    assert cf["101"] == "Centro Uno"
    rows = tiny.workers_enriched.filter("row_idx = 1").orderBy("_centre_row_idx").collect()
    assert [r["nombre_jefe_ope"] for r in rows] == ["Ana", "Luis"]
    assert worker_dim(tiny.workers_enriched.filter("row_idx = 1")).first()["nombre_jefe_ope"] == "Luis"


def test_domain_rules_by_hand(spark):
    """Each rule on rows that break just it."""
    from covercost.operators.quality import domain_violations

    def row(i, empresa="", obs="obs", **kw):
        return (*fact(i, **kw)[:-1], obs, empresa)

    raw = spark.createDataFrame([
        row(1), row(2, fact_="Quizás"), row(3, motivo="Otra cosa"), row(4, empresa="E9"), row(5, mes="13-Mes"),
        row(6, worker="NADIE"), row(7, dest="999"), row(8, horas=-1.0), row(9, precio=-1.0), row(10, noct=-1.0),
        row(11, tras=-1.0), row(12, motivo=""), row(13, obs=""), row(14, fecha=None), row(15, worker=""), row(16, dest=""),
    ], FACT_SCHEMA + ", empresa_destino string")
    names = spark.createDataFrame([("PEPE",)], "nombre_empleado string")
    codes = spark.createDataFrame([("102",)], "codigo_centro string")
    got = {(int(r["incidencia_id"]), r["regla"]) for r in domain_violations(raw, names, codes, ("E0",)).collect()}
    assert got == {
        (2, "facturable_fuera_de_dominio"), (3, "motivo_fuera_de_dominio"), (4, "empresa_fuera_de_dominio"), (5, "mes_fuera_de_dominio"),
        (6, "trabajador_desconocido"), (7, "centro_destino_desconocido"), (8, "incidencia_horas_negativo"), (9, "incidencia_precio_negativo"),
        (10, "nocturnidad_horas_negativo"), (11, "traslados_total_negativo"), (12, "falta_motivo"), (13, "falta_observaciones"),
        (14, "falta_fecha"), (15, "falta_trabajador"), (16, "falta_codigo_crown_destino")}
