import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from covercost.operators.masters import Masters  # noqa: E402
from covercost.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app_name="covercost-tests")
    yield s


CENTROS = [
    # row_idx, code, desc, supervisor, alta, baja, almacen
    (1, "101.0", "Centro Uno", "Ana", None, None, "A1"),
    (2, "102", "Centro Dos", None, None, None, "A1"),
    (3, "103", "Centro Cerrado", "Ana", None, "2001-01-01 00:00:00", "A1"),
    (4, "104", "Centro Excluido", "EXCLUDED", None, None, "A1"),
    (5, None, "Sin codigo", "Ana", None, None, "A1"),
    (6, "", "Codigo blanco", "Ana", None, None, "A1"),
    (7, "101", "Centro Uno bis", "Luis", None, None, "A1"),
]
TRABAJADORES = [
    # row_idx, name, centre, category, agreement, cost, own supervisor, share, company
    (1, "pepe", "101.0", "h ASL", "99100165012001.0", 5.0, "OWN", "100", "E0"),
    (2, "maria", "102", "Camarera", "9.9100165012002E13", None, None, "50", "E1"),
    (3, "juan", None, "limpieza", "", 7.5, "OWNJ", "75", "E2"),
    (4, "pepe", "102", "g Cocina", "99100165012003", 6.0, None, "80", "E0"),
    (5, None, "101", "X", "1", 1.0, None, "1", "E0"),
]
TARIFAS = [
    (1, " asl ", "99100165012001.0", "3"),
    (2, "COCINA", "99100165012003", "2.5"),
    (3, "cocina", "99100165012003.0", "4.0"),   # same key, later row wins
    (4, "CAMARERA", "99100165012002", "n/a"),   # bad rate: skipped
    (5, "h ASL", "99100165012001", "9"),        # rate side keeps the prefix: unreachable
]
MOTIVOS = [
    (0, "Festivos y Fines de Semana", "70/71 Festivos"), (1, "Absentismo", "72 Incentivos"),
    (2, "Refuerzo", "72 Incentivos"), (3, "Nocturnidad", "74 Plus nocturnidad"), (4, "Otros", None),
    (5, "Absentismo", "73 Plus sustitucion"), (6, "Refuerzo", "sin cuenta"),
]


@pytest.fixture(scope="session")
def tiny(spark):
    from pyspark.sql import functions as F
    c = spark.createDataFrame(CENTROS, "row_idx long, cod_centro_preferente string, desc_centro_preferente string, "
                              "nombre_jefe_ope string, fecha_alta_centro string, fecha_baja_centro string, "
                              "almacen_centro string")
    c = c.withColumn("fecha_alta_centro", F.col("fecha_alta_centro").cast("timestamp")) \
         .withColumn("fecha_baja_centro", F.col("fecha_baja_centro").cast("timestamp"))
    w = spark.createDataFrame(TRABAJADORES, "row_idx long, nombre_empleado string, centro_preferente string, "
                              "cat_empleado string, cod_reg_convenio string, coste_hora double, "
                              "nombre_jefe_ope string, porcen_contrato string, cod_empresa string")
    t = spark.createDataFrame(TARIFAS, "row_idx long, descripcion string, cod_convenio string, tarifa_noct string")
    mo = spark.createDataFrame(MOTIVOS, "row_idx int, motivo string, desc_cuenta string")
    return Masters(spark, c, w, t, mo, excluded_supervisors=("EXCLUDED",))


FACT_SCHEMA = ("incidencia_id string, session_jefe string, imputacion_nomina string, trabajador string, "
               "facturable string, motivo string, codigo_crown_destino string, incidencia_horas double, "
               "incidencia_precio double, nocturnidad_horas double, traslados_total double, fecha string, "
               "observaciones string")


def fact(i, worker="PEPE", dest="102", motivo="Absentismo", fact_="Sí", fecha="2025-01-02", horas=2.0,
         precio=10.0, noct=1.0, tras=4.0, jefe="S1", mes="01-Enero"):
    return (str(i), jefe, mes, worker, fact_, motivo, dest, horas, precio, noct, tras, fecha, "obs")
