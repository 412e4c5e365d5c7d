"""Validity, counts, missing-field diagnosis and domain rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covercost.constants import (FACTURABLE_VALUES, MISSING_FIELD_LABELS, MONTHS,
                                 MOTIVO_VALUES, REQUIRED_FIELDS)
from covercost.functions import normalize as N
from covercost.operators.joins import Dim, sized_side

SCOPE = ("session_jefe", "imputacion_nomina")


def is_valid() -> Column:
    """All required fields non-null and non-blank (whitespace and NaN pass)."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c) != "") for c in REQUIRED_FIELDS])


def valid_incidents(facts: DataFrame) -> DataFrame:
    return facts.filter(is_valid())


def incident_counts(facts: DataFrame) -> DataFrame:
    """Total, valid and incomplete incidents per scope."""
    valid = F.count_if(is_valid())
    return facts.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_total"), valid.alias("n_validas"),
                                     (F.count(F.lit(1)) - valid).alias("n_incompletas"))


def scopes_without_valid(facts: DataFrame) -> DataFrame:
    """Per scope: does it need the diagnosis (rows present, none valid)?"""
    c = incident_counts(facts)
    return c.select(*SCOPE, "n_total", "n_validas",
                    ((F.col("n_total") > 0) & (F.col("n_validas") == 0)).alias("sin_validas"))


def missing_labels() -> Column:
    """Labels of the empty fields among the diagnosed six, joined by ', '."""
    arr = F.array_compact(F.array(*[F.when(N.is_blank(c), F.lit(lbl)) for c, lbl in MISSING_FIELD_LABELS]))
    return F.array_join(arr, ", ")


def invalid_reasons(facts: DataFrame, first_n: int = 3, order: str = "incidencia_id") -> DataFrame:
    """The first ``first_n`` incidents of each scope with their missing fields.

    ``n_mas`` is how many more incidents the scope has.  ``row_number() <= n``
    is planned with a partial group limit before the shuffle.
    """
    w = Window.partitionBy(*SCOPE).orderBy(order)
    firsts = (facts.withColumn("posicion", F.row_number().over(w)).filter(F.col("posicion") <= first_n)
              .select(*SCOPE, "incidencia_id", F.col("posicion").cast("bigint").alias("posicion"),
                      missing_labels().alias("problemas")))
    counts = facts.groupBy(*SCOPE).agg(F.greatest(F.count(F.lit(1)) - first_n, F.lit(0)).alias("n_mas"))
    # Both sides hold a few rows per scope; adaptive execution broadcasts the
    # smaller one at run time (an up-front count would re-read the facts).
    counts = counts.withColumnsRenamed({c: f"_{c}" for c in SCOPE})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SCOPE]  # a scope may lack its session or month
    return firsts.join(counts, same[0] & same[1]).drop(*(f"_{c}" for c in SCOPE))


def _membership_side(d, col: str, alias: str, flag: str) -> DataFrame:
    """Key list with a marker column; a counted ``Dim`` decides broadcast itself,
    a plain DataFrame gets a bounded size check."""
    df = d.side() if isinstance(d, Dim) else sized_side(d)
    return df.select(F.col(col).alias(alias), F.lit(True).alias(flag))


def domain_violations(facts: DataFrame, worker_names, centre_codes,
                      companies) -> DataFrame:
    """One row per (incident, broken rule).

    Value rules are column predicates; membership of the worker and the
    destination centre is checked by joins against the dimensions.
    """
    names = _membership_side(worker_names, "nombre_empleado", "_wn", "_wk")
    codes = _membership_side(centre_codes, "codigo_centro", "_cc", "_ck")
    f = (facts.join(names, F.col("trabajador") == F.col("_wn"), "left")
         .join(codes, F.col("codigo_crown_destino") == F.col("_cc"), "left"))
    rules = [
        (~F.coalesce(F.col("facturable"), F.lit("")).isin(*FACTURABLE_VALUES), "facturable_fuera_de_dominio"),
        (~N.is_blank("motivo") & ~F.col("motivo").isin(*MOTIVO_VALUES), "motivo_fuera_de_dominio"),
        (~F.coalesce(F.col("empresa_destino"), F.lit("")).isin("", *companies), "empresa_fuera_de_dominio"),
        (~F.coalesce(F.col("imputacion_nomina"), F.lit("")).isin(*MONTHS), "mes_fuera_de_dominio"),
        (~N.is_blank("trabajador") & F.col("_wk").isNull(), "trabajador_desconocido"),
        (~N.is_blank("codigo_crown_destino") & F.col("_ck").isNull(), "centro_destino_desconocido"),
    ]
    rules += [(F.col(c) < 0, f"{c}_negativo") for c in
              ("incidencia_horas", "incidencia_precio", "nocturnidad_horas", "traslados_total")]
    rules += [(N.is_blank(c), f"falta_{c}") for c in (*REQUIRED_FIELDS, "observaciones")]
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))
    return f.select("incidencia_id", F.explode(broken).alias("regla"))
