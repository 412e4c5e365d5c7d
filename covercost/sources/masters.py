"""Reading master tables from Parquet or CSV folders.

Headers are normalised once at load (trim; for workers inner newlines become
spaces; the worker-name column is found by alias), so every later operator
works on fixed column names.  A missing optional table reads as an empty
DataFrame with its schema.
"""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from covercost.constants import NAME_ALIASES
from covercost.operators.masters import Masters
from covercost.schemas import SCHEMAS



def normalize_headers(df: DataFrame, newline_to_space: bool = False) -> DataFrame:
    names = [c.strip() for c in df.columns]
    if newline_to_space:
        names = [c.replace("\n", " ") for c in names]
    return df.toDF(*names)


def resolve_name_column(df: DataFrame, target: str = "nombre_empleado") -> DataFrame:
    """Rename the first column whose trimmed lower-case name is a known alias."""
    if target in df.columns:
        return df
    for c in df.columns:
        if c.lower().strip() in NAME_ALIASES:
            return df.withColumnRenamed(c, target)
    return df


# Columns each master table must have after header normalisation; without
# them the table is treated as empty.
REQUIRED = {
    "centros": ("cod_centro_preferente",),
    "trabajadores": ("nombre_empleado",),
    "tarifas": ("descripcion", "cod_convenio", "tarifa_noct"),
    "motivos": ("motivo", "desc_cuenta"),
}
# The rate sheet is read by position: only its first three columns.
POSITIONAL_COLUMNS = {"tarifas": 3}


def has_columns(df: DataFrame, required) -> bool:
    return set(required).issubset(df.columns)


def empty_of(spark: SparkSession, schema) -> DataFrame:
    """An empty table with ``schema`` (StructType), built without Python rows."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def empty_like(spark: SparkSession, table: str) -> DataFrame:
    return empty_of(spark, SCHEMAS[table])


def header_of(spark: SparkSession, path: str) -> str:
    """First line of a CSV table (all files of a table have the same header)."""
    row = spark.read.text(path).first()
    return row[0] if row else ""


def _named(df: DataFrame, table: str) -> DataFrame:
    """Headers normalised, the worker name and the two renamed columns found, the rate sheet cut to its positions."""
    if table in POSITIONAL_COLUMNS:
        data = [c for c in df.columns if c not in ("row_idx", REJECTED)][:POSITIONAL_COLUMNS[table]]
        df = df.select(*[c for c in df.columns if c in ("row_idx", REJECTED)], *data)
    df = normalize_headers(df, newline_to_space=(table == "trabajadores"))
    if table == "trabajadores":
        df = resolve_name_column(df)
    if table == "tarifas" and "Descripción" in df.columns:
        df = df.withColumnRenamed("Descripción", "descripcion")
    if table == "motivos" and "Motivo" in df.columns:
        df = df.withColumnRenamed("Motivo", "motivo")
    return df


#: Column of a line as it stands in the file, where it doesn't fit the schema.
REJECTED = "_registro"


def _checked_schema(spark: SparkSession, header: list[str], table: str) -> str:
    """Read schema of a CSV table: the master's type for each column of its header, text for others, and the rejected line."""
    names = _named(spark.range(0).select(*[F.lit(None).cast("string").alias(f"{c}") for c in header]), table).columns
    types = {f.name: f.dataType.simpleString() for f in SCHEMAS[table].fields}
    renamed = dict(zip(header, names, strict=False)) if len(names) == len(header) else {}
    cols = [f"`{c.replace('`', '``')}` {types.get(renamed.get(c, c.strip()), 'string')}" for c in header]
    return ", ".join([*cols, f"{REJECTED} string"])


def load_checked(spark: SparkSession, path: str, table: str, out: str) -> tuple[DataFrame, DataFrame, dict]:
    """Good rows, rejected rows (row_idx, _registro) and counts (n_filas, n_rechazadas) of a CSV master table.

    The file is read once, with an explicit schema: a line with missing or
    further fields, or with text where a number or date belongs, is rejected.
    Both kinds are written under ``out`` (shared storage) in that pass, and the
    counts are observed in it.
    """
    first = header_of(spark, path)
    header = next(csv.reader([first])) if first else []
    reader = spark.read.option("header", True).option("multiLine", first.count('"') % 2 == 1)
    df = reader.schema(_checked_schema(spark, header, table)).option("columnNameOfCorruptRecord", REJECTED).csv(path)
    source = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
    seen = Observation()
    df = df.select(source.alias("row_idx"), "*").observe(seen, F.count(F.lit(1)).alias("n_filas"), F.count(REJECTED).alias("n_rechazadas"))
    df = _named(df, table)
    df.withColumn("rechazada", F.col(REJECTED).isNotNull()).write.mode("overwrite").partitionBy("rechazada").parquet(out)
    both = spark.read.schema(df.schema.add("rechazada", "boolean")).parquet(out)
    return both.where("not rechazada").drop(REJECTED, "rechazada"), both.where("rechazada").select("row_idx", REJECTED), seen.get


def load_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet", required: bool = False,
               checked: str | None = None) -> DataFrame:
    """Read one master table.

    Spark looks for the path in its own file system.  A missing path, or a
    table without its key columns, raises when ``required``; else it gives an
    empty table with its schema.  Without a ``row_idx`` column, rows count in
    the order of (file path, block, place in the block).  A CSV table is split
    between tasks unless its header goes over several lines.  ``checked`` (a
    folder) reads a CSV table by ``load_checked``: its broken lines are kept
    there instead of becoming odd rows.
    """
    try:
        if fmt == "csv" and checked:
            df = load_checked(spark, path, table, checked)[0]
        else:
            reader = spark.read
            if fmt == "csv":
                reader = reader.option("header", True).option("multiLine", header_of(spark, path).count('"') % 2 == 1)
            df = reader.format(fmt).load(path)
            source = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place"))
            if "row_idx" not in df.columns:
                df = df.select(source.alias("row_idx"), "*")
            df = _named(df, table)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_like(spark, table)
    if not has_columns(df, REQUIRED.get(table, ())):
        if required:
            raise ValueError(f"{path}: {table} needs the columns {REQUIRED[table]}")
        return empty_like(spark, table)
    return df


def load_masters(spark: SparkSession, base_dir: str, fmt: str = "parquet", **kwargs) -> Masters:
    """Masters from ``base_dir/{centros,trabajadores,tarifas,motivos}``; centres and workers must be there."""
    t = {name: load_table(spark, f"{base_dir.rstrip('/')}/{name}", name, fmt, name in ("centros", "trabajadores"))
         for name in ("centros", "trabajadores", "tarifas", "motivos")}
    return Masters(spark, t["centros"], t["trabajadores"], t["tarifas"], t["motivos"], **kwargs)


def scan_masters(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each table (one global aggregate per table)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_filas")).select(F.lit(name).alias("tabla"), "n_filas")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
