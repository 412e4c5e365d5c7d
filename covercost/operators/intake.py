"""Bulk intake: requests become incident rows.

* by centre: one incident per worker of the origin centre and listed
  destination;
* by worker: one incident per listed destination (1-10), origin is the
  worker's own centre;
* replicate: ``num_rows`` identical incidents for one worker and each listed
  destination.

Blank entries of a destination list don't count.  New incidents carry blank
user fields; enrichment fills the worker fields.  Requests that a rule stops
are in ``intake_rejected``, with the rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covercost.constants import MAX_DESTINATIONS, RANGE_ROWS
from covercost.functions import normalize as N
from covercost.operators.enrich import FACT_COLUMNS, enrich
from covercost.operators.joins import number_within
from covercost.operators.masters import Masters, employees_by_centre

SCOPE = ("session_jefe", "imputacion_nomina")


def with_destinations(requests: DataFrame) -> DataFrame:
    """Destination list from a comma-separated text column when needed."""
    if "destinos" in requests.columns:
        return requests
    return requests.withColumn("destinos", F.split(F.coalesce(F.col("destinos_csv"), F.lit("")), ","))


def _new_incidents(df: DataFrame, id_part) -> DataFrame:
    return df.select(F.concat_ws(":", F.lit("R"), F.col("request_id").cast("string"), F.col("kind"), id_part)
                     .alias("incidencia_id"), *SCOPE, F.col("request_id"), F.col("_orden"),
                     F.col("_name").alias("trabajador"), F.col("_dest").alias("codigo_crown_destino"))


def _listed(requests: DataFrame) -> DataFrame:
    """Requests with their non-blank destinations (``destinos``) and worker name (``_name``)."""
    r = with_destinations(requests)
    _, name = N.split_label(F.col("trabajador"))
    listed = F.filter(F.coalesce("destinos", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return r.withColumn("destinos", listed).withColumn("_name", name)


def _rejection() -> F.Column:
    """Why a bulk request adds nothing; null when it is accepted."""
    n = F.size("destinos")
    return (F.when(~F.coalesce(F.col("kind").isin("centro", "trabajador"), F.lit(False)), "tipo_desconocido")
            .when((F.col("kind") == "centro") & N.is_blank("centro_origen"), "sin_centro_origen")
            .when((F.col("kind") == "trabajador") & N.is_blank("_name"), "sin_trabajador")
            .when(n == 0, "sin_destino")
            .when((F.col("kind") == "trabajador") & (n > MAX_DESTINATIONS), "demasiados_destinos"))


def intake_rejected(requests: DataFrame) -> DataFrame:
    """request_id and reason of every bulk request that a rule stops."""
    return _listed(requests).select("request_id", _rejection().alias("motivo_rechazo")).filter("motivo_rechazo is not null")


def intake_by_centre(requests: DataFrame, m: Masters) -> DataFrame:
    """Each accepted 'centro' request adds one incident per distinct worker of its origin centre and destination."""
    r = _listed(requests).filter((F.col("kind") == "centro") & _rejection().isNull()).drop("_name")
    staff = employees_by_centre(m.workers_enriched)
    j = r.join(staff, r.centro_origen == staff.codigo_centro, "inner")
    j = j.select("*", F.posexplode("destinos").alias("_pos", "_dest")).withColumn("_name", F.col("nombre_empleado"))
    j = j.withColumn("_orden", F.concat_ws(":", F.format_string("%010d", F.col("_pos")), F.col("_name")))
    return enrich(_new_incidents(j, F.col("_orden")), m)


def intake_by_worker(requests: DataFrame, m: Masters) -> DataFrame:
    """Each accepted 'trabajador' request adds one incident per destination."""
    r = _listed(requests).filter((F.col("kind") == "trabajador") & _rejection().isNull())
    j = r.select("*", F.posexplode("destinos").alias("_pos", "_dest"))
    j = j.withColumn("_orden", F.format_string("%010d", F.col("_pos")))
    return enrich(_new_incidents(j, F.col("_orden")), m)


def intake_replicate(requests: DataFrame, m: Masters, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each request adds ``num_rows`` copies for its worker and every listed destination (a blank one when none is).

    Copies are cut into ranges, which are dealt over the session's partitions
    before any copy is made: a request of any size is worked on by many tasks.
    """
    r = _listed(requests).filter(~N.is_blank("_name") & (F.col("num_rows") >= 1))
    listed = F.when(F.size("destinos") > 0, F.col("destinos")).otherwise(F.array(F.lit("")))
    j = r.select("*", F.posexplode(listed).alias("_pos", "_dest")).withColumn("_n", F.col("num_rows").cast("long"))
    firsts = F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(range_rows).cast("long"))
    j = j.withColumn("_first", F.explode(firsts))
    # a given number of partitions, which adaptive execution doesn't put together for being small
    j = j.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id", "_pos", "_first")
    j = j.withColumn("_copy", F.explode(F.sequence("_first", F.least(F.col("_n"), F.col("_first") + (range_rows - 1)))))
    j = j.withColumn("_orden", F.format_string("%010d:%010d", F.col("_pos"), F.col("_copy")))
    return enrich(_new_incidents(j, F.col("_orden")), m)


def append_intake(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Append new incidents after the existing ones of their scope.

    Existing rows are numbered by incident id; new rows continue from the
    scope's count in (request, order) order.  Both numberings are
    distributed (see ``number_within``).
    """
    old = number_within(facts.select(*FACT_COLUMNS), list(SCOPE), ["incidencia_id"])
    counts = facts.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_base"))
    fresh = number_within(new, list(SCOPE), ["request_id", "_orden"], name="_local")
    # One row per scope: adaptive execution broadcasts it once its (tiny)
    # aggregate has run; a count up front would cost a pass over the facts.
    counts = counts.withColumnsRenamed({c: f"_{c}" for c in SCOPE})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SCOPE]
    fresh = fresh.join(counts, same[0] & same[1], "left").drop(*(f"_{c}" for c in SCOPE))
    fresh = fresh.withColumn("seq", (F.coalesce(F.col("_base"), F.lit(0)) + F.col("_local")).cast("bigint"))
    return old.unionByName(fresh.select(*FACT_COLUMNS, "seq"))


def clear_scope(facts: DataFrame, session_jefe: str, imputacion_nomina: str) -> DataFrame:
    """All incidents except those of one (supervisor, month) session."""
    hit = (F.col("session_jefe") == session_jefe) & (F.col("imputacion_nomina") == imputacion_nomina)
    return facts.filter(~F.coalesce(hit, F.lit(False)))


__all__ = ["intake_by_centre", "intake_by_worker", "intake_rejected", "intake_replicate", "append_intake", "clear_scope"]
