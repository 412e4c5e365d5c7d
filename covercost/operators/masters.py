"""Master tables: centres, workers, night rates and reason accounts.

Cleaning rules run as column expressions; "last row wins" and "first match
wins" (dictionary overwrite and first-index lookup in a row-ordered sheet)
are expressed with the ``row_idx`` source-order column.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.constants import MISSING_TEXT, WORKER_DEFAULTS
from covercost.functions import normalize as N
from covercost.operators.joins import Dim, first_by, last_by

def centros_clean(centros: DataFrame, excluded=()) -> DataFrame:
    """Open centres with a code, codes normalised, excluded supervisors removed.

    A null supervisor is kept (``NOT IN`` on null would drop it).
    """
    code = F.col("cod_centro_preferente")
    df = centros.filter(code.isNotNull() & (code != ""))
    if "fecha_baja_centro" in df.columns:
        df = df.filter(F.col("fecha_baja_centro").isNull())
    df = df.withColumn("cod_centro_preferente", N.centre_code(code))
    df = df.drop("fecha_alta_centro", "fecha_baja_centro", "almacen_centro")
    if "nombre_jefe_ope" not in df.columns:
        df = df.withColumn("nombre_jefe_ope", F.lit(None).cast("string"))
    if excluded:
        df = df.filter(~F.coalesce(F.col("nombre_jefe_ope").isin(*excluded), F.lit(False)))
    return df.withColumn("codigo_centro", F.col("cod_centro_preferente"))


def centros_lookup(clean: DataFrame) -> DataFrame:
    """Distinct (code, description, display label); label is ``code - description``."""
    df = clean.select("row_idx", N.centre_code("cod_centro_preferente").alias("cod_centro_preferente"),
                      "desc_centro_preferente")
    df = df.withColumn("nombre_centro_display", F.concat(
        F.col("cod_centro_preferente"), F.lit(" - "),
        F.coalesce(F.col("desc_centro_preferente"), F.lit(MISSING_TEXT))))
    keys = ["cod_centro_preferente", "desc_centro_preferente", "nombre_centro_display"]
    return df.groupBy(*keys).agg(F.min("row_idx").alias("row_idx")).select("row_idx", *keys)


def centre_first(lookup: DataFrame) -> DataFrame:
    """Description of the first lookup row for each centre code."""
    return first_by(lookup, ["cod_centro_preferente"], ["row_idx"]).select(
        "cod_centro_preferente", "desc_centro_preferente", "row_idx")


def workers_clean(trabajadores: DataFrame) -> DataFrame:
    """Upper-case worker names; derive the service from the category when absent."""
    df = trabajadores
    if "nombre_empleado" in df.columns:
        df = df.withColumn("nombre_empleado", F.upper("nombre_empleado"))
    if "servicio" not in df.columns and "cat_empleado" in df.columns:
        df = df.withColumn("servicio", N.service_for("cat_empleado"))
    return df


def centre_join_side(clean: DataFrame) -> DataFrame:
    return clean.select("codigo_centro", F.col("nombre_jefe_ope").alias("_centre_jefe"),
                        F.col("desc_centro_preferente").alias("nombre_centro_preferente"),
                        F.col("row_idx").alias("_centre_row_idx"))


def workers_enriched(clean_workers: DataFrame, centre_side: DataFrame) -> DataFrame:
    """Workers left-joined to centres on the normalised centre code.

    Repeated centre codes fan a worker out (one row per matching centre); the
    supervisor is the centre's, else the worker's own.
    """
    w = clean_workers.withColumn("centro_preferente", N.centre_code("centro_preferente"))
    j = w.join(centre_side, w.centro_preferente == centre_side.codigo_centro, "left")
    jefe = F.col("_centre_jefe")
    if "nombre_jefe_ope" in clean_workers.columns:
        jefe = F.coalesce(jefe, w.nombre_jefe_ope)
    cols = [c for c in clean_workers.columns if c != "nombre_jefe_ope"]
    return j.select(*[w[c] for c in cols], jefe.alias("nombre_jefe_ope"),
                    "nombre_centro_preferente", "_centre_row_idx")


def worker_dim(enriched: DataFrame) -> DataFrame:
    """Name -> attributes, last row wins; missing/null/blank attributes get defaults."""
    df = enriched.filter(F.col("nombre_empleado").isNotNull() & (F.col("nombre_empleado") != ""))
    df = last_by(df, ["nombre_empleado"], ["row_idx", "_centre_row_idx"])
    out = [F.col("nombre_empleado")]
    for name, default in WORKER_DEFAULTS:
        if name not in df.columns:
            out.append(F.lit(default).alias(name))
        elif isinstance(default, float):
            out.append(F.coalesce(N.nan_to_null(N.py_float(name) if dict(df.dtypes)[name] == "string"
                                                else F.col(name).cast("double")), F.lit(default)).alias(name))
        else:
            out.append(F.coalesce(F.col(name).cast("string"), F.lit(default)).alias(name))
    return df.select(*out)


def tariff_dim(tarifas: DataFrame) -> DataFrame:
    """(category, agreement) -> night rate; rows with a blank key or bad rate are skipped."""
    df = tarifas.select("row_idx", N.rate_category("descripcion").alias("cat_key"),
                        N.agreement_code("cod_convenio").alias("conv_key"),
                        N.py_float("tarifa_noct").alias("tarifa"))
    df = df.filter((F.col("cat_key") != "") & (F.col("conv_key") != "")
                   & F.col("tarifa").isNotNull() & ~F.isnan("tarifa"))
    return last_by(df, ["cat_key", "conv_key"], ["row_idx"]).select("cat_key", "conv_key", "tarifa")


def account_dim(motivos: DataFrame) -> DataFrame:
    """Reason -> account code; only rows that map to an account overwrite earlier ones."""
    df = motivos.select("row_idx", F.coalesce(F.col("motivo"), F.lit("")).alias("motivo"),
                        N.account_code("desc_cuenta").alias("cuenta_codigo"))
    df = df.filter(F.col("cuenta_codigo").isNotNull())
    return last_by(df, ["motivo"], ["row_idx"]).select("motivo", "cuenta_codigo")


def rate_by_pair(workers: DataFrame, tariffs: DataFrame) -> DataFrame:
    """Night rate of every distinct raw (category, agreement) pair of the workers.

    Incidents copy these two fields from a worker, so pricing them once per
    pair here spares the per-incident normalisation.
    """
    pairs = workers.select(F.col("cat_empleado").alias("categoria"), "cod_reg_convenio").distinct()
    keyed = (pairs.withColumn("_cat", N.incident_category("categoria"))
             .withColumn("_conv", N.agreement_code("cod_reg_convenio")))
    j = keyed.join(tariffs, (F.col("_cat") == tariffs.cat_key) & (F.col("_conv") == tariffs.conv_key), "left")
    # blank keys never match a rate row (rate rows have non-blank keys)
    return j.select("categoria", "cod_reg_convenio", F.coalesce(F.col("tarifa"), F.lit(0.0)).alias("tarifa"))


class Masters:
    """The four master tables and the dimensions derived from them.

    Dimensions are built lazily, persisted once and counted, so each join can
    decide between broadcast and shuffle from a checked size.
    """

    def __init__(self, spark: SparkSession, centros: DataFrame, trabajadores: DataFrame,
                 tarifas: DataFrame, motivos: DataFrame,
                 excluded_supervisors=(), max_broadcast_rows: int | None = None):
        self.spark = spark
        self.centros = centros
        self.trabajadores = trabajadores
        self.tarifas = tarifas
        self.motivos = motivos
        self.excluded = tuple(excluded_supervisors or ())
        self.max_rows = max_broadcast_rows

    @cached_property
    def centros_clean(self) -> DataFrame:
        return centros_clean(self.centros, self.excluded)

    @cached_property
    def centros_lookup(self) -> DataFrame:
        return centros_lookup(self.centros_clean)

    @cached_property
    def centre_side(self) -> Dim:
        return Dim(centre_join_side(self.centros_clean), "centre_side", self.max_rows)

    @cached_property
    def centre_first(self) -> Dim:
        return Dim(centre_first(self.centros_lookup), "centre_first", self.max_rows)

    @cached_property
    def workers_clean(self) -> DataFrame:
        return workers_clean(self.trabajadores)

    @cached_property
    def workers_enriched(self) -> DataFrame:
        return workers_enriched(self.workers_clean, self.centre_side.side())

    @cached_property
    def worker_dim(self) -> Dim:
        return Dim(worker_dim(self.workers_enriched), "worker_dim", self.max_rows)

    @cached_property
    def tariff_dim(self) -> Dim:
        return Dim(tariff_dim(self.tarifas), "tariff_dim", self.max_rows)

    @cached_property
    def centre_codes(self) -> Dim:
        """Distinct codes of the open centres (membership checks)."""
        return Dim(self.centros_clean.select("codigo_centro").dropna().distinct(), "centre_codes", self.max_rows)

    @cached_property
    def rate_by_pair(self) -> Dim:
        return Dim(rate_by_pair(self.worker_dim.df, self.tariff_dim.side()), "rate_by_pair", self.max_rows)

    @cached_property
    def account_dim(self) -> Dim:
        return Dim(account_dim(self.motivos), "account_dim", self.max_rows)


# -- picker lists and small derived views -----------------------------------

def supervisors(clean: DataFrame) -> DataFrame:
    return clean.select("nombre_jefe_ope").dropna().distinct().orderBy("nombre_jefe_ope")


def centre_codes(clean: DataFrame) -> DataFrame:
    return clean.select(F.col("codigo_centro").cast("string").alias("codigo_centro")).dropna().distinct() \
        .orderBy("codigo_centro")


def centre_options(clean: DataFrame) -> DataFrame:
    """Blank option followed by the centre codes."""
    blank = clean.sparkSession.range(1).select(F.lit("").alias("option"))
    codes = centre_codes(clean).select(F.col("codigo_centro").alias("option"))
    return blank.unionByName(codes)


def employees(enriched: DataFrame) -> DataFrame:
    return enriched.select("nombre_empleado").dropna().distinct().orderBy("nombre_empleado")


def employees_with_centre(enriched: DataFrame) -> DataFrame:
    """Labels ``centre - NAME`` (missing parts print as 'nan'), distinct, sorted."""
    label = F.concat(F.coalesce(F.col("centro_preferente"), F.lit(MISSING_TEXT)), F.lit(" - "),
                     F.coalesce(F.col("nombre_empleado"), F.lit(MISSING_TEXT)))
    return enriched.select(label.alias("etiqueta")).distinct().orderBy("etiqueta")


def employees_by_centre(enriched: DataFrame) -> DataFrame:
    """Distinct worker names of every centre; blank centre codes list nobody."""
    return (enriched.filter(F.coalesce(F.col("centro_preferente"), F.lit("")) != "")
            .select(F.col("centro_preferente").alias("codigo_centro"), "nombre_empleado")
            .dropna().distinct())


def workers_per_centre(enriched: DataFrame) -> DataFrame:
    return (employees_by_centre(enriched).groupBy("codigo_centro")
            .agg(F.count(F.lit(1)).alias("n_trabajadores")))


def centre_by_label(lookup: DataFrame, labels: DataFrame, label_col: str = "nombre_centro_display") -> DataFrame:
    """Centre code of each label: the first lookup row carrying that label."""
    first = first_by(lookup, ["nombre_centro_display"], ["row_idx"]).select(
        F.col("nombre_centro_display").alias("_label"), F.col("cod_centro_preferente"))
    return labels.join(first, labels[label_col] == first["_label"], "left").drop("_label")


def legacy_centre_map(centros: DataFrame) -> DataFrame:
    """First three data columns by position, renamed (legacy centre map)."""
    data_cols = [c for c in centros.columns if c != "row_idx"][:3]
    names = ["codigo_centro", "nombre_centro", "cod_centro_preferente"]
    return centros.select("row_idx", *[F.col(c).alias(n) for c, n in zip(data_cols, names)])
