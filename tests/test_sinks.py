"""Export sink round trip, names and the file manifest."""

import datetime as dt
import os
import tempfile


import pytest
from pyspark.errors import AnalysisException

from covercost.operators.joins import last_by
from covercost.operators import pricing as P
from covercost.plans.context import context
from covercost.sources import manifest as MF
from covercost.sources import masters as SM
from covercost.sources import sinks as S

SF = "/root/testdata/sf0.001"


def test_export_round_trip(spark):
    c = context(spark, SF)
    costed = P.export_costed(c.facts, c.masters)
    out = tempfile.mkdtemp(prefix="covercost-export-", dir="/tmp")
    assert S.write_export(costed, out)
    back = spark.read.parquet(out)
    assert back.count() == costed.count()
    assert set(back.columns) == set(costed.columns)
    assert any(name.startswith("session_jefe=") for name in os.listdir(out))
    assert not S.write_export(costed.limit(0), out + "-empty")


def test_export_names(spark):
    df = spark.createDataFrame([("Ana Ruiz", "01-Enero", 3), ("Luis", "02-Febrero", 0)],
                               "session_jefe string, imputacion_nomina string, n_validas long")
    out = S.export_names(df, dt.datetime(2025, 1, 31, 12, 0, 0), "xlsx").collect()
    assert [r["nombre_fichero"] for r in out] == ["incidencias_Ana_Ruiz_20250131_120000.xlsx"]


def test_manifest_detects_change(spark):
    d = tempfile.mkdtemp(prefix="covercost-manifest-", dir="/tmp")
    for name, text in (("a.txt", "uno"), ("b.txt", "dos")):
        with open(os.path.join(d, name), "w") as fh:
            fh.write(text)
    first = MF.file_manifest(spark, d + "/*.txt")
    prev = spark.createDataFrame([tuple(r) for r in first.select("path", "length", "md5").collect()],
                                 "path string, length bigint, md5 string")
    with open(os.path.join(d, "b.txt"), "w") as fh:
        fh.write("tres")
    now = {os.path.basename(r["path"]): r["estado"] for r in MF.file_manifest(spark, d + "/*.txt", prev).collect()}
    assert now == {"a.txt": "unchanged", "b.txt": "changed"}


def test_header_normalize_and_missing_table(spark):
    df = spark.createDataFrame([("x", 1)], "` Nombre ` string, `coste\nhora` int")
    out = SM.resolve_name_column(SM.normalize_headers(df, newline_to_space=True))
    assert out.columns == ["nombre_empleado", "coste hora"]
    empty = SM.load_table(spark, "/nonexistent/centros", "centros")
    assert empty.count() == 0 and "cod_centro_preferente" in empty.columns


def test_load_masters_from_csv(spark):
    d = tempfile.mkdtemp(prefix="covercost-masters-", dir="/tmp")
    files = {
        "centros": "cod_centro_preferente,desc_centro_preferente,nombre_jefe_ope\n101.0,Uno,Ana\n102,Dos,\n",
        "trabajadores": " Nombre ,centro_preferente,cat_empleado,cod_reg_convenio,coste_hora\n"
                        "pepe,101,h ASL,99100165012001,5\n",
        # rate sheet: only the first three columns count; a fourth is ignored
        "tarifas": "Descripción,cod_convenio,tarifa_noct,extra\nASL,99100165012001.0,3,x\n",
        "motivos": "Motivo,desc_cuenta\nAbsentismo,73 Plus\n",
    }
    for name, text in files.items():
        os.makedirs(os.path.join(d, name))
        with open(os.path.join(d, name, "part.csv"), "w") as fh:
            fh.write(text)
    m = SM.load_masters(spark, d, fmt="csv", excluded_supervisors=())
    assert [tuple(r) for r in m.tariff_dim.df.collect()] == [("ASL", "99100165012001", 3.0)]
    w = m.worker_dim.df.first()
    assert (w["nombre_empleado"], w["centro_preferente"], w["nombre_jefe_ope"]) == ("PEPE", "101", "Ana")
    # a rate sheet whose first three columns lack a required name is empty
    os.makedirs(os.path.join(d, "bad"))
    with open(os.path.join(d, "bad", "part.csv"), "w") as fh:
        fh.write("x,Descripción,cod_convenio,tarifa_noct\n1,ASL,1,2\n")
    assert SM.load_table(spark, os.path.join(d, "bad"), "tarifas", "csv").count() == 0


def test_source_order_over_files_and_required_tables(spark, tmp_path):
    d = tmp_path / "motivos"
    d.mkdir()
    (d / "a.csv").write_text("motivo,desc_cuenta\nX,1\n")
    (d / "b.csv").write_text("motivo,desc_cuenta\n" + "Y,7\n" * 500 + "X,9\n")  # the larger file comes last
    t = SM.load_table(spark, f"file://{d}", "motivos", "csv")
    last = {r["motivo"]: r["desc_cuenta"] for r in last_by(t, ["motivo"], ["row_idx"]).collect()}
    assert last == {"X": "9", "Y": "7"}
    with pytest.raises(AnalysisException):
        SM.load_table(spark, str(tmp_path / "none"), "centros", "csv", required=True)
    with pytest.raises(ValueError):
        SM.load_table(spark, str(d), "centros", "csv", required=True)
