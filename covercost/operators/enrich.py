"""Incident enrichment: copy worker attributes and the destination name.

For a known worker the incident takes name, category, service, centre (also
as origin), agreement, supervisor and cost/hour from the worker dimension;
the destination is the given one, or the worker's own centre when blank, and
its name is the first centre-lookup match.  An unknown worker leaves every
one of these fields blank (so the incident is incomplete).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covercost.functions import normalize as N
from covercost.operators.masters import Masters

# Canonical fact columns, in order.
FACT_COLUMNS = (
    "incidencia_id", "session_jefe", "imputacion_nomina", "trabajador", "facturable", "motivo",
    "codigo_crown_origen", "codigo_crown_destino", "empresa_destino", "incidencia_horas",
    "incidencia_precio", "nocturnidad_horas", "traslados_total", "coste_hora", "fecha",
    "observaciones", "centro_preferente", "nombre_jefe_ope", "categoria", "servicio",
    "cod_reg_convenio", "nombre_crown_destino",
)
NUMERIC_FIELDS = ("incidencia_horas", "incidencia_precio", "nocturnidad_horas", "traslados_total", "coste_hora")
# Fields written by enrichment (the rest are entered by the user).
ENRICHED_FIELDS = ("trabajador", "categoria", "servicio", "centro_preferente", "codigo_crown_origen",
                   "cod_reg_convenio", "nombre_jefe_ope", "codigo_crown_destino", "nombre_crown_destino",
                   "coste_hora")


def with_defaults(df: DataFrame) -> DataFrame:
    """Add missing fact fields with their defaults ('' or 0.0)."""
    for c in FACT_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0) if c in NUMERIC_FIELDS else F.lit(""))
    return df


def _worker_side(m: Masters) -> DataFrame:
    return m.worker_dim.side().select(*[F.col(c).alias(f"_w_{c}") for c in m.worker_dim.df.columns])


def _centre_name_side(m: Masters) -> DataFrame:
    return m.centre_first.side().select(F.col("cod_centro_preferente").alias("_cf_code"),
                                        F.col("desc_centro_preferente").alias("_cf_desc"))


def enrich(facts: DataFrame, m: Masters, name_col: str = "trabajador",
           dest_col: str = "codigo_crown_destino") -> DataFrame:
    """Fill the worker-derived fields of every incident (fresh-intake semantics)."""
    facts = with_defaults(facts)
    j = facts.join(_worker_side(m), F.col(name_col) == F.col("_w_nombre_empleado"), "left")
    known = F.col("_w_nombre_empleado").isNotNull()
    origin = F.col("_w_centro_preferente")
    dest = (F.when(~known, F.lit(""))
            .when(~N.is_blank(dest_col), F.col(dest_col).cast("string")).otherwise(origin))
    j = j.withColumn("_dest", dest)
    j = j.join(_centre_name_side(m), F.col("_dest") == F.col("_cf_code"), "left")
    filled = {
        "trabajador": F.when(known, F.col("_w_nombre_empleado")).otherwise(F.lit("")),
        "categoria": F.when(known, F.col("_w_cat_empleado")).otherwise(F.lit("")),
        "servicio": F.when(known, F.col("_w_servicio")).otherwise(F.lit("")),
        "centro_preferente": F.when(known, origin).otherwise(F.lit("")),
        "codigo_crown_origen": F.when(known, origin).otherwise(F.lit("")),
        "cod_reg_convenio": F.when(known, F.col("_w_cod_reg_convenio")).otherwise(F.lit("")),
        "nombre_jefe_ope": F.when(known, F.col("_w_nombre_jefe_ope")).otherwise(F.lit("")),
        "codigo_crown_destino": F.col("_dest"),
        "nombre_crown_destino": F.when(known, F.coalesce(F.col("_cf_desc"), F.lit(""))).otherwise(F.lit("")),
        "coste_hora": F.when(known, F.col("_w_coste_hora")).otherwise(F.lit(0.0)),
    }
    extra = [c for c in facts.columns if c not in FACT_COLUMNS]
    return j.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in FACT_COLUMNS], *extra)


def re_enrich(facts: DataFrame, m: Masters, when_col: str) -> DataFrame:
    """Re-run enrichment on rows where ``when_col`` is true and the worker is known.

    Unknown workers keep their previous attributes (the edited name stays).
    """
    j = facts.join(_worker_side(m), F.col("trabajador") == F.col("_w_nombre_empleado"), "left")
    hit = F.col(when_col) & F.col("_w_nombre_empleado").isNotNull()
    origin = F.col("_w_centro_preferente")
    dest = F.when(hit, F.when(~N.is_blank("codigo_crown_destino"), F.col("codigo_crown_destino"))
                  .otherwise(origin)).otherwise(F.col("codigo_crown_destino"))
    j = j.withColumn("_re_hit", hit).withColumn("_re_dest", dest)
    j = j.join(_centre_name_side(m), F.col("_re_dest") == F.col("_cf_code"), "left")
    new = {
        "trabajador": F.col("_w_nombre_empleado"),
        "categoria": F.col("_w_cat_empleado"),
        "servicio": F.col("_w_servicio"),
        "centro_preferente": origin,
        "codigo_crown_origen": origin,
        "cod_reg_convenio": F.col("_w_cod_reg_convenio"),
        "nombre_jefe_ope": F.col("_w_nombre_jefe_ope"),
        "codigo_crown_destino": F.col("_re_dest"),
        "nombre_crown_destino": F.coalesce(F.col("_cf_desc"), F.lit("")),
        "coste_hora": F.col("_w_coste_hora"),
    }
    keep = [c for c in facts.columns]
    return j.select(*[F.when(F.col("_re_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
                      for c in keep])
