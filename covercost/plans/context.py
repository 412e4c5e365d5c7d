"""Per-session inputs: fixture tables, masters and enriched facts for one folder."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.constants import RANGES_STAGED
from covercost.operators.enrich import enrich
from covercost.operators.joins import Dim, add_rows, cuts_of, in_range, materialize, new_folder, scratch
from covercost.operators.masters import Masters
from covercost.session import app_id, release
from covercost.sources.files import remove, versions
from covercost.sources import fixtures as fx

_CONTEXTS: dict[tuple[str, str], tuple[tuple, "Context"]] = {}


class Context:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def masters(self) -> Masters:
        s, d = self.spark, self.sf_dir
        return Masters(s, fx.centros(s, d), fx.trabajadores(s, d), fx.tarifas(s, d), fx.motivos(s, d),
                       excluded_supervisors=fx.EXCLUDED_SUPERVISORS)

    @cached_property
    def incidencias(self) -> DataFrame:
        return fx.incidencias(self.spark, self.sf_dir)

    @cached_property
    def facts(self) -> DataFrame:
        """Enriched incidents; the plan object is reused, the data is never cached (large side)."""
        return enrich(self.incidencias, self.masters)

    @cached_property
    def edits(self) -> DataFrame:
        return fx.edits(self.spark, self.sf_dir)

    @cached_property
    def requests(self) -> DataFrame:
        return fx.requests(self.spark, self.sf_dir)

    @cached_property
    def cuts(self) -> list[str]:
        """Ids at which the incidents are cut into ranges; none while they are few."""
        return cuts_of(self.incidencias, "incidencia_id")

    def _over(self, incidents: DataFrame) -> "Context":
        copy = Context(self.spark, self.sf_dir)
        copy.masters = self.masters
        copy.incidencias = incidents
        copy.edits = fx.edits(self.spark, self.sf_dir, incidents)
        copy.cuts = self.cuts
        return copy

    def written(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` materialized; where there are many incidents, the shuffles behind it go at once."""
        out = materialize(df, label)
        if self.cuts:
            release(self.spark)
        return out

    def parts(self, where: Column | None = None) -> Iterator["Context"]:
        """This context in ranges of incident ids, ascending: each over a written copy of its incidents, with their edits.

        Edits and enriched facts of a part are scans of its copy; the tables
        behind are joined once, for a few ranges at a time.  A part's copy and
        what is written while it is worked on go when the next is asked for,
        and so do the shuffles: what lies on disk is bounded by a few ranges,
        besides what the caller keeps.  Call it inside a ``scratch``.
        ``where``: only the incidents that meet it, decided before they are written.
        """
        asked = self.incidencias if where is None else self.incidencias.where(where)
        if not self.cuts:
            with scratch(self.spark):
                yield self._over(materialize(asked, "incidencias"))
            return
        bounds = [None, *self.cuts, None]
        for first in range(0, len(bounds) - 1, RANGES_STAGED):
            some = bounds[first:first + RANGES_STAGED + 1]
            with scratch(self.spark):
                folder = new_folder(self.spark, "incidencias")
                before = (F.when(F.col("incidencia_id") >= F.lit(x), 1).otherwise(0) for x in some[1:-1])
                rows = asked.where(in_range("incidencia_id", some[0], some[-1])).withColumn("_parte", reduce(add, before, F.lit(0)))
                add_rows(rows, folder, "_parte")
                for k in range(len(some) - 1):
                    release(self.spark)
                    with scratch(self.spark):
                        yield self._over(self.spark.read.schema(rows.schema).parquet(folder).where(F.col("_parte") == k).drop("_parte"))
                    remove(self.spark, f"{folder}/_parte={k}")
        release(self.spark)

    def free(self) -> None:
        """Unpersist the dimensions that were built."""
        for dim in vars(self.__dict__.get("masters", self)).values():
            if isinstance(dim, Dim):
                dim.unpersist()


def context(spark: SparkSession, sf_dir: str) -> Context:
    """One context per (application, folder): dimensions are built and counted once.

    Its key holds the versions of the input files, on whatever file system they
    are; when they change, a new context is built and the dimensions of the old
    one are freed.
    """
    key, now = (app_id(spark), sf_dir), versions(spark, sf_dir)
    held = _CONTEXTS.get(key)
    if held is None or held[0] != now:
        if held is not None:
            held[1].free()
        _CONTEXTS[key] = (now, Context(spark, sf_dir))
    return _CONTEXTS[key][1]
