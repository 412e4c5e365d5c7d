"""Input tables as projections of the TPC-H-style test tables.

The driver's tables (supplier, customer, part, lineitem, orders, nation) are
mapped onto the costing data model: centres, workers, night rates, facts,
edits and bulk-intake requests.  The same projections exist as SQL in
``covercost.plans.oracle`` so that both engines see identical inputs.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.constants import MONTHS

#: Supervisors whose centres are excluded, and accepted destination companies, of the test tables.
EXCLUDED_SUPERVISORS = ("NATION_0", "NATION_1", "NATION_2")
COMPANIES = ("E0", "E1", "E2")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return c.cast("string")


def centros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work centres: null/blank/text/float-like and repeated codes, closed centres."""
    s = read_table(spark, sf_dir, "supplier")
    n = read_table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    code = (F.when(k % 17 == 16, F.lit(None).cast("string"))
            .when(k % 19 == 18, F.lit(""))
            .when(k % 23 == 22, F.concat(F.lit("X"), _s(k)))
            .when(k % 13 == 12, _s(99 + k))
            .when(k % 2 == 0, F.concat(_s(100 + k), F.lit(".0")))
            .otherwise(_s(100 + k)))
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(k.alias("row_idx"),
                    code.alias("cod_centro_preferente"),
                    F.col("s_name").alias("desc_centro_preferente"),
                    F.when(F.col("s_nationkey") % 7 != 6, F.col("n_name")).alias("nombre_jefe_ope"),
                    F.lit(None).cast("timestamp").alias("fecha_alta_centro"),
                    F.when(F.col("s_acctbal") < 0, F.lit(_dt.datetime(2001, 1, 1))).alias("fecha_baja_centro"),
                    F.lit("A1").alias("almacen_centro")))


def trabajadores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers: repeated names, null centre, prefixed categories, null cost."""
    c = read_table(spark, sf_dir, "customer")
    n_centres = read_table(spark, sf_dir, "supplier").select(F.count("*")).scalar()
    k = F.col("c_custkey")
    name_key = F.when(k % 10 == 9, k - 9).otherwise(k)
    seg = F.col("c_mktsegment")
    return c.select(
        k.alias("row_idx"),
        F.lower(F.concat(F.lit("Employee#"), _s(name_key))).alias("nombre_empleado"),
        F.when(k % 31 != 30, F.concat(_s(100 + k % n_centres), F.lit(".0"))).alias("centro_preferente"),
        (F.when(seg == "BUILDING", "h Economy").when(seg == "HOUSEHOLD", "Standard Limp")
         .when(seg == "MACHINERY", "promo").when(seg == "FURNITURE", "g small")).alias("cat_empleado"),
        F.concat(_s(F.lit(99100165012001) + F.col("c_nationkey")),
                 F.when(k % 2 == 0, F.lit(".0")).otherwise(F.lit(""))).alias("cod_reg_convenio"),
        F.when(k % 13 != 12, F.col("c_acctbal") / 100).alias("coste_hora"),
        F.when(k % 3 == 0, F.lit("OWN_SUP")).alias("nombre_jefe_ope"),
        _s(50 + k % 51).alias("porcen_contrato"),
        F.concat(F.lit("E"), _s(F.col("c_nationkey") % 3)).alias("cod_empresa"),
    )


def tarifas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Night rates: padded mixed-case categories, float-like codes, bad rate text."""
    p = read_table(spark, sf_dir, "part")
    brand_no = F.col("p_brand").substr(F.lit(7), F.length("p_brand")).cast("bigint")
    return p.select(
        F.col("p_partkey").alias("row_idx"),
        F.when(F.col("p_type") == "STANDARD", F.lit("Standard Limp"))
        .otherwise(F.concat(F.lit(" "), F.lower("p_type"), F.lit(" "))).alias("descripcion"),
        F.concat(_s(F.lit(99100165012000) + brand_no), F.lit(".0")).alias("cod_convenio"),
        F.when(F.col("p_partkey") % 11 == 10, F.lit("n/a"))
        .otherwise(_s(F.col("p_retailprice") / 100)).alias("tarifa_noct"),
    )


# Reason -> account master: a fixed reference list (row order matters).
MOTIVOS_ROWS = (
    (0, "Festivos y Fines de Semana", "70/71 Festivos"),
    (1, "Absentismo", "72 Incentivos"),
    (2, "Refuerzo", "72 Incentivos"),
    (3, "Nocturnidad", "74 Plus nocturnidad"),
    (4, "Otros", None),
    (5, "Absentismo", "73 Plus sustitucion"),
    (6, "Refuerzo", "sin cuenta"),
)


def motivos(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    """The reason list as a literal table built in the JVM (no Python worker)."""
    rows = [F.struct(F.lit(i).cast("int").alias("row_idx"), F.lit(m).cast("string").alias("motivo"),
                     F.lit(d).cast("string").alias("desc_cuenta")) for i, m, d in MOTIVOS_ROWS]
    return spark.range(1).select(F.inline(F.array(*rows)))


def incidencias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts: one incident per line item, scoped by supervisor session and month."""
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    ship = F.col("l_shipdate").cast("date")
    cust = F.col("o_custkey")
    worker_key = F.when(cust % 10 == 9, cust - 9).otherwise(cust)
    prio = F.col("o_orderpriority")
    flag = F.col("l_returnflag")
    # Two large tables: joined by a shuffle at any size, which also spreads a
    # line-item file of a single row group over the session's partitions.
    return (li.join(o.hint("merge"), li.l_orderkey == o.o_orderkey)
            .select(
                F.concat_ws("-", _s(F.col("l_orderkey")), _s(F.col("l_linenumber")), _s(F.col("l_partkey")),
                            _s(F.col("l_suppkey")), _s(F.col("l_quantity").cast("int")), _s(ship)).alias("incidencia_id"),
                F.concat(F.lit("SUP"), _s(cust % 5)).alias("session_jefe"),
                F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month("l_shipdate")).alias("imputacion_nomina"),
                F.when(F.col("l_partkey") % 37 == 36, F.lit("UNKNOWN"))
                .otherwise(F.upper(F.concat(F.lit("employee#"), _s(worker_key)))).alias("trabajador"),
                (F.when(flag == "A", "Sí").when(flag == "N", "No").when(F.col("l_linestatus") == "F", "")
                 .otherwise("Sí")).alias("facturable"),
                (F.when(prio == "1-URGENT", "Festivos y Fines de Semana").when(prio == "2-HIGH", "Absentismo")
                 .when(prio == "3-MEDIUM", "Refuerzo").when(prio == "4-NOT SPECIFIED", "Nocturnidad")
                 .otherwise("Otros")).alias("motivo"),
                F.when(F.col("l_suppkey") % 29 == 28, F.lit(""))
                .otherwise(_s(100 + F.col("l_suppkey"))).alias("codigo_crown_destino"),
                F.col("l_quantity").alias("incidencia_horas"),
                (F.col("l_discount") * 100 + 5).alias("incidencia_precio"),
                (F.col("l_tax") * 100).alias("nocturnidad_horas"),
                F.col("l_linenumber").cast("double").alias("traslados_total"),
                F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(_s(ship)).alias("fecha"),
                F.concat(F.lit("obs "), F.col("l_linestatus")).alias("observaciones"),
            ))


def edits(spark: SparkSession, sf_dir: str, facts: DataFrame | None = None) -> DataFrame:
    """Edited rows keyed by incident id: delete marks, worker change, bad text."""
    inc = facts if facts is not None else incidencias(spark, sf_dir)
    return (inc.filter(F.col("incidencia_horas") >= 45)
            .select("incidencia_id",
                    (F.col("traslados_total") == 3).alias("borrar"),
                    F.when(F.col("traslados_total") == 2, F.lit("EMPLOYEE#1"))
                    .otherwise(F.col("trabajador")).alias("trabajador"),
                    F.when(F.col("nocturnidad_horas") > 6, F.lit(" nan ")).otherwise(F.col("motivo")).alias("motivo"),
                    F.concat(F.col("codigo_crown_destino"), F.lit(".0")).alias("codigo_crown_destino"),
                    F.when(F.col("nocturnidad_horas") < 2, F.lit("bad"))
                    .otherwise(_s(F.col("incidencia_horas") + 1)).alias("incidencia_horas")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk-intake requests: by centre or by worker, 1-2 destinations, 1-3 copies."""
    s = read_table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("request_id"),
        F.concat(F.lit("SUP"), _s(k % 5)).alias("session_jefe"),
        F.lit(MONTHS[0]).alias("imputacion_nomina"),
        F.when(k % 2 == 0, F.lit("centro")).otherwise(F.lit("trabajador")).alias("kind"),
        _s(100 + k).alias("centro_origen"),
        F.concat(F.lit("EMPLOYEE#"), _s(k)).alias("trabajador"),
        F.concat(_s(101 + k), F.when(k % 3 == 0, F.lit(",X22")).otherwise(F.lit(""))).alias("destinos_csv"),
        (1 + k % 3).alias("num_rows"),
    )


def odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bulk-intake requests, of which each rule of the intake stops some."""
    k = F.col("request_id")
    return requests(spark, sf_dir).withColumns({
        "kind": F.when(k % 7 == 1, "otro").when(k % 7 == 2, F.lit(None)).otherwise(F.col("kind")),
        "centro_origen": F.when(k % 5 != 0, F.col("centro_origen")),
        "trabajador": F.when(k % 11 == 0, "").otherwise(F.col("trabajador")),
        "destinos_csv": F.when(k % 13 == 0, ",").when(k % 13 == 1, F.lit(",".join(f"D{n}" for n in range(11)))).otherwise(F.col("destinos_csv")),
    })


def odd_incidents(facts: DataFrame) -> DataFrame:
    """Incidents of which each domain rule is broken by those of one value of ``traslados_total``."""
    t = F.col("traslados_total")
    negative = {c: F.when(t == 2, -F.col(c) - 1).otherwise(F.col(c)) for c in ("incidencia_horas", "incidencia_precio", "nocturnidad_horas", "traslados_total")}
    return facts.withColumns({
        **{c: F.when(t == n, v).otherwise(F.col(c)) for c, n, v in (
            ("observaciones", 1, ""), ("facturable", 3, "Quizá"), ("motivo", 4, "Huelga"), ("empresa_destino", 5, "E9"),
            ("imputacion_nomina", 6, "13-Mes"), ("trabajador", 7, "NADIE"), ("codigo_crown_destino", 7, "X"))},
        **negative})
