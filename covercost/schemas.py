"""Canonical schemas of the master, fact, edit and request tables."""

from pyspark.sql.types import (BooleanType, DoubleType, LongType, StringType, StructField, StructType,
                               TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


CENTROS = _s(("row_idx", LongType()), ("cod_centro_preferente", StringType()),
             ("desc_centro_preferente", StringType()), ("nombre_jefe_ope", StringType()),
             ("fecha_alta_centro", TimestampType()), ("fecha_baja_centro", TimestampType()),
             ("almacen_centro", StringType()))
TRABAJADORES = _s(("row_idx", LongType()), ("nombre_empleado", StringType()), ("centro_preferente", StringType()),
                  ("cat_empleado", StringType()), ("cod_reg_convenio", StringType()), ("coste_hora", DoubleType()),
                  ("nombre_jefe_ope", StringType()), ("porcen_contrato", StringType()),
                  ("cod_empresa", StringType()))
TARIFAS = _s(("row_idx", LongType()), ("descripcion", StringType()), ("cod_convenio", StringType()),
             ("tarifa_noct", StringType()))
MOTIVOS = _s(("row_idx", LongType()), ("motivo", StringType()), ("desc_cuenta", StringType()))
INCIDENCIAS = _s(("incidencia_id", StringType()), ("session_jefe", StringType()),
                 ("imputacion_nomina", StringType()), ("trabajador", StringType()), ("facturable", StringType()),
                 ("motivo", StringType()), ("codigo_crown_destino", StringType()),
                 ("incidencia_horas", DoubleType()), ("incidencia_precio", DoubleType()),
                 ("nocturnidad_horas", DoubleType()), ("traslados_total", DoubleType()), ("fecha", StringType()),
                 ("observaciones", StringType()))
EDITS = _s(("incidencia_id", StringType()), ("borrar", BooleanType()), ("trabajador", StringType()),
           ("motivo", StringType()), ("codigo_crown_destino", StringType()), ("incidencia_horas", StringType()))
REQUESTS = _s(("request_id", LongType()), ("session_jefe", StringType()), ("imputacion_nomina", StringType()),
              ("kind", StringType()), ("centro_origen", StringType()), ("trabajador", StringType()),
              ("destinos_csv", StringType()), ("num_rows", LongType()))

SCHEMAS = {"centros": CENTROS, "trabajadores": TRABAJADORES, "tarifas": TARIFAS, "motivos": MOTIVOS,
           "incidencias": INCIDENCIAS, "edits": EDITS, "requests": REQUESTS}
