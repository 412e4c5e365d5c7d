"""Enrichment, night rate, accounts, row cost and totals."""

import pytest
from pyspark.sql import functions as F

from conftest import FACT_SCHEMA, fact
from covercost.operators import pricing as P
from covercost.operators.enrich import enrich


@pytest.fixture(scope="module")
def facts(spark, tiny):
    raw = spark.createDataFrame([
        fact(1), fact(2, worker="UNKNOWN"), fact(3, worker="MARIA", dest="", motivo="Refuerzo"),
        fact(4, worker="JUAN", dest=""), fact(5, fecha=""),
    ], FACT_SCHEMA)
    return enrich(raw, tiny)


def by_id(df):
    return {r["incidencia_id"]: r for r in df.collect()}


def test_enrich(facts):
    f = by_id(facts)
    assert (f["1"]["trabajador"], f["1"]["categoria"], f["1"]["codigo_crown_origen"], f["1"]["nombre_crown_destino"],
            f["1"]["coste_hora"]) == ("PEPE", "g Cocina", "102", "Centro Dos", 6.0)
    assert f["2"]["trabajador"] == "" and f["2"]["codigo_crown_destino"] == "" and f["2"]["coste_hora"] == 0.0
    assert f["3"]["codigo_crown_destino"] == "102"   # blank destination -> own centre
    assert f["4"]["codigo_crown_destino"] == ""      # no centre at all


def test_night_rate(facts, tiny):
    r = by_id(P.with_night_rate(facts, tiny))
    assert r["1"]["precio_nocturnidad"] == 4.0      # 'g Cocina' -> COCINA, last rate row wins
    assert r["3"]["precio_nocturnidad"] == 0.0      # bad rate text was skipped
    assert r["2"]["precio_nocturnidad"] == 0.0      # blank key


def test_export_row(facts, tiny):
    e = P.export_costed(facts, tiny).collect()
    assert len(e) == 2                               # 1 and 3 are complete
    row = {r["Trabajador"]: r for r in e}["PEPE"]
    assert len(e[0]) == 30                           # 29 exported columns + session
    assert row["73_plus_sustitucion"] == 20.0 and row["72_incentivos"] == 0.0
    assert row["74_plus_nocturnidad"] == 4.0
    assert row["Coste_total"] == pytest.approx((2 * 10 + 1 * 4.0) * 1.3195 + 4)
    assert row["Empresa Origen"] == "102" and row["porcen_contrato"] == "80" and row["nombre_centro"] == "Centro Dos"


def test_hand_row_cost(spark):
    df = spark.createDataFrame([(2.0, 10.0, 1.0, 3.0, 4.0)], "h double, p double, n double, r double, t double")
    v = df.select(P.coste_total(F.col("h"), F.col("p"), F.col("n"), F.col("r"), F.col("t"))).first()[0]
    assert v == pytest.approx(34.3485)


def test_hand_totals(spark):
    df = spark.createDataFrame([(10.0, 2.0, 3.0, 1.0, 4.0, 5.0)],
                               "incidencia_precio double, incidencia_horas double, precio_nocturnidad double, "
                               "nocturnidad_horas double, traslados_total double, coste_hora double")
    t = P.totals_of(P.total_parts(df, [])).first().asDict()
    assert t == {"n_validas": 1, "total_incidencias": 20.0, "total_nocturnidad": 3.0, "total_traslados": 20.0,
                 "total_simple": 43.0, "total_con_ss": 50.3485}


def test_summary_by_scope(facts, tiny):
    s = P.summary_by_scope(facts, tiny).first().asDict()
    assert s["n_validas"] == 2
    assert s["total_incidencias"] == 40.0 and s["total_nocturnidad"] == 4.0
    assert s["total_traslados"] == 4 * 6.0 + 4 * 0.0
    assert s["total_con_ss"] == pytest.approx(44 * 1.3195 + 24)


def test_account_74_goes_nowhere(spark, tiny):
    raw = spark.createDataFrame([fact(9, motivo="Nocturnidad")], FACT_SCHEMA)
    r = P.export_costed(enrich(raw, tiny), tiny).first()
    assert (r["73_plus_sustitucion"], r["72_incentivos"], r["70_71_festivos"]) == (0.0, 0.0, 0.0)
    assert r["Coste_total"] > 0


def test_rate_for_pair_outside_workers(spark, tiny):
    # a pair no worker carries is still priced (per-row normalisation path)
    df = spark.createDataFrame([("x", " h  asl", "99100165012001.0"), ("y", "h ASL", "9.9100165012001E13"),
                                ("z", "g cocina", "99100165012003")],
                               "incidencia_id string, categoria string, cod_reg_convenio string")
    r = {row["incidencia_id"]: row["precio_nocturnidad"] for row in P.with_night_rate(df, tiny).collect()}
    assert r == {"x": 0.0, "y": 3.0, "z": 4.0}
