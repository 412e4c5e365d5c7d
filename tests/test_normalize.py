"""Scalar rules against hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from covercost.functions import normalize as N


def run(spark, fn, values, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_centre_code(spark):
    vals = ["101.0", "101.5", "007", "-5", "9.9E+13", "1-2", "X7", None, "", "1.2.3"]
    assert run(spark, N.centre_code, vals) == ["101", "101", "7", "-5", "9.9E+13", "1-2", "X7", None, "", "1.2.3"]


def test_agreement_code(spark):
    vals = ["9.91002E+13", "99100165012016.0", " ab ", None, "", "nan", "inf", "5d", "1_0"]
    assert run(spark, N.agreement_code, vals) == [
        "99100200000000", "99100165012016", "ab", "", "", "nan", "inf", "5d", "10"]


def test_categories(spark):
    assert run(spark, N.incident_category, ["h ASL", "hh ASL", "h  ASL", None, " g  small ", "ASL"]) == [
        "ASL", "HH ASL", " ASL", "", " SMALL", "ASL"]
    assert run(spark, N.rate_category, [" asl ", None, "h ASL"]) == ["ASL", "NAN", "H ASL"]


def test_py_float(spark):
    vals = ["1.5", " 2 ", "1e3", "bad", "5d", "0x10", "inf", "-Infinity", "1_000.5", "1__0", "", None, "3.f"]
    out = run(spark, N.py_float, vals)
    assert out[:4] == [1.5, 2.0, 1000.0, None]
    assert out[4:6] == [None, None]
    assert out[6] == float("inf") and out[7] == float("-inf")
    assert out[8] == 1000.5 and out[9] is None and out[10] is None and out[11] is None and out[12] is None


def test_edit_cleaning(spark):
    assert run(spark, N.edit_code, ["101.0", "10.05", "nan", None, "None", " 7 "]) == ["101", "105", "", "", "", "7"]
    assert run(spark, N.edit_text, [" nan ", "NaN", "None", " x ", None, ""]) == ["nan", "", "", "x", "", ""]
    assert run(spark, N.edit_number, ["bad", "", None, " 3 ", "nan"])[:4] == [0.0, 0.0, 0.0, 3.0]
    assert run(spark, N.view_text, ["nan", "None", None, "x"]) == ["", "", "", "x"]


def test_account_code(spark):
    vals = ["x 70/71", "73 Plus", "72 Inc", "74 Noct", "174", None, "70/71 y 73"]
    assert run(spark, N.account_code, vals) == ["70_71", "73", "72", "74", None, None, "70_71"]


def test_service(spark):
    assert run(spark, N.service_for, ["Standard Limp", "h ASL", "Cocina", None]) == [
        "020 Limpieza", "020 Limpieza", "010 Restauración", "010 Restauración"]


def test_split_label(spark):
    df = spark.createDataFrame([("101 - ANA - B",), ("ANA",)], "x string")
    code, name = N.split_label(F.col("x"))
    assert [tuple(r) for r in df.select(code, name).collect()] == [("101", "ANA - B"), ("", "ANA")]


def test_parse_fecha_and_money(spark):
    import datetime as dt
    out = run(spark, N.parse_fecha, ["3/4/2025", "2025-04-03", "bad", ""])
    assert out == [dt.date(2025, 4, 3), dt.date(2025, 4, 3), None, None]
    df = spark.createDataFrame([(1234.5,), (-0.125,)], "x double")
    assert [r[0] for r in df.select(N.money(F.col("x").cast("decimal(20,4)"))).collect()] == ["€1,234.50", "€-0.13"]


@pytest.mark.parametrize("text", ["\t x \n", "　x "])
def test_strip_unicode_whitespace(spark, text):
    assert run(spark, N.strip_ws, [text]) == ["x"]
