"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each one reads the test tables of ``sf_dir`` (through the fixture
projections) and runs one operator of the pipeline over whole tables.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.constants import MONTHS
from covercost.functions import normalize as N
from covercost.operators import edits as E
from covercost.operators import intake as I
from covercost.operators import joins as J
from covercost.operators import masters as M
from covercost.operators import pricing as P
from covercost.operators import quality as Q
from covercost.operators import report as R
from covercost.operators.enrich import FACT_COLUMNS, enrich
from covercost.plans.context import context
from covercost.session import ensure_checkpoint_dir, release
from covercost.sources import fixtures as fx
from covercost.sources import kept as K
from covercost.sources import manifest as MF
from covercost.sources import masters as SM
from covercost.sources import sinks as S
from covercost.sources.files import remove

# Export timestamp used by the naming query (fixed for reproducibility).
EXPORT_TS = _dt.datetime(2025, 1, 31, 12, 0, 0)
FACTS = list(FACT_COLUMNS)


def scan_masters(spark, d):
    c = context(spark, d)
    m = c.masters
    return SM.scan_masters({"centros": m.centros, "trabajadores": m.trabajadores, "tarifas": m.tarifas,
                            "motivos": m.motivos, "incidencias": c.incidencias, "edits": c.edits,
                            "requests": c.requests})


def centros_clean(spark, d):
    return context(spark, d).masters.centros_clean


def centros_lookup(spark, d):
    return context(spark, d).masters.centros_lookup


def centre_first(spark, d):
    return context(spark, d).masters.centre_first.df


def centre_by_label(spark, d):
    lk = context(spark, d).masters.centros_lookup
    return M.centre_by_label(lk, lk.select("nombre_centro_display").distinct())


def normalize_centre_code(spark, d):
    m = context(spark, d).masters
    a = m.centros.select(F.lit("centros").alias("fuente"), "row_idx", F.col("cod_centro_preferente").alias("codigo"))
    b = m.trabajadores.select(F.lit("trabajadores").alias("fuente"), "row_idx",
                              F.col("centro_preferente").alias("codigo"))
    return a.unionByName(b).withColumn("codigo_normalizado", N.centre_code("codigo"))


def normalize_agreement(spark, d):
    m = context(spark, d).masters
    a = m.trabajadores.select(F.lit("trabajadores").alias("fuente"), "row_idx",
                              F.col("cod_reg_convenio").alias("codigo"))
    b = m.tarifas.select(F.lit("tarifas").alias("fuente"), "row_idx", F.col("cod_convenio").alias("codigo"))
    return a.unionByName(b).withColumn("codigo_normalizado", N.agreement_code("codigo"))


def workers_clean(spark, d):
    return context(spark, d).masters.workers_clean


def workers_enriched(spark, d):
    return context(spark, d).masters.workers_enriched.drop("_centre_row_idx")


def worker_dim(spark, d):
    return context(spark, d).masters.worker_dim.df


def tariff_dim(spark, d):
    return context(spark, d).masters.tariff_dim.df


def supervisors(spark, d):
    return M.supervisors(context(spark, d).masters.centros_clean)


def centre_codes(spark, d):
    return M.centre_codes(context(spark, d).masters.centros_clean)


def centre_options(spark, d):
    return M.centre_options(context(spark, d).masters.centros_clean)


def employees(spark, d):
    return M.employees(context(spark, d).masters.workers_enriched)


def employees_with_centre(spark, d):
    return M.employees_with_centre(context(spark, d).masters.workers_enriched)


def employees_by_centre(spark, d):
    return M.employees_by_centre(context(spark, d).masters.workers_enriched)


def workers_per_centre(spark, d):
    return M.workers_per_centre(context(spark, d).masters.workers_enriched)


def legacy_centre_map(spark, d):
    return M.legacy_centre_map(context(spark, d).masters.centros)


def split_worker_label(spark, d):
    labels = M.employees_with_centre(context(spark, d).masters.workers_enriched)
    code, name = N.split_label(F.col("etiqueta"))
    return labels.select("etiqueta", code.alias("cod_centro_visual"), name.alias("nombre_trabajador"))


def incident_enrich(spark, d):
    return context(spark, d).facts


def valid_incidents(spark, d):
    return Q.valid_incidents(context(spark, d).facts)


def night_rate(spark, d):
    c = context(spark, d)
    return P.with_night_rate(c.facts, c.masters).select("incidencia_id", "categoria", "cod_reg_convenio",
                                                        "precio_nocturnidad")


def distinct_rate_keys(spark, d):
    c = context(spark, d)
    return P.distinct_rate_keys(c.facts, c.masters)


def account_code(spark, d):
    c = context(spark, d)
    return P.with_account(c.facts, c.masters).select("incidencia_id", "motivo", "cuenta_codigo")


def export_costed(spark, d):
    c = context(spark, d)
    return P.export_costed(c.facts, c.masters)


def account_split(spark, d):
    c = context(spark, d)
    v = P.with_account(Q.valid_incidents(c.facts), c.masters)
    v = P.account_split(v.withColumn("_amount", P.incident_amount(F.col("incidencia_precio"),
                                                                  F.col("incidencia_horas"))))
    return v.select("incidencia_id", F.col("motivo").alias("Motivo"), "cuenta_codigo",
                    *[n for n, _ in P.ACCOUNT_COLUMNS])


def row_cost(spark, d):
    c = context(spark, d)
    v = P.with_night_rate(Q.valid_incidents(c.facts), c.masters)
    return v.select("incidencia_id",
                    (F.col("precio_nocturnidad") * F.col("nocturnidad_horas")).alias("74_plus_nocturnidad"),
                    P.coste_total(F.col("incidencia_horas"), F.col("incidencia_precio"), F.col("nocturnidad_horas"),
                                  F.col("precio_nocturnidad"), F.col("traslados_total")).alias("Coste_total"))


def summary_by_scope(spark, d):
    c = context(spark, d)
    return P.summary_by_scope(c.facts, c.masters)


def summary_totals(spark, d):
    c = context(spark, d)
    return P.summary_totals(c.facts, c.masters)


def summary_formatted(spark, d):
    c = context(spark, d)
    return P.summary_formatted(c.facts, c.masters)


def totals_after_edits(spark, d):
    """Totals of all sessions, brought up to date from the edited incidents alone."""
    kept, deltas = J.new_folder(spark, "totals"), J.new_folder(spark, "deltas")
    with J.scratch(spark):
        for c in context(spark, d).parts():
            J.add_rows(P.total_parts(P.priced(c.facts, c.masters), list(P.SCOPE)), kept)
            J.add_rows(P.edit_deltas(c.facts, c.edits, c.masters), deltas)
    return P.totals_after(spark.read.parquet(kept), spark.read.parquet(deltas))


def incident_counts(spark, d):
    return Q.incident_counts(context(spark, d).facts)


def scopes_without_valid(spark, d):
    return Q.scopes_without_valid(context(spark, d).facts)


def invalid_reasons(spark, d):
    return Q.invalid_reasons(context(spark, d).facts)


def _edited_facts(spark, d):
    c = context(spark, d)
    return E.apply_edits(c.facts, c.edits, c.masters)


def domain_violations(spark, d):
    m = context(spark, d).masters
    return Q.domain_violations(_edited_facts(spark, d), m.worker_dim, m.centre_codes, fx.COMPANIES)


def parse_fecha(spark, d):
    return context(spark, d).incidencias.select("incidencia_id", "fecha", N.parse_fecha("fecha").alias("fecha_dt"))


def apply_edits(spark, d):
    return _edited_facts(spark, d)


def delete_marked(spark, d):
    # the marks name incidents as they were entered: those that go needn't be enriched, and the narrow rows are compared
    c = context(spark, d)
    return enrich(E.delete_marked(c.incidencias, c.edits), c.masters)


def edit_change_flags(spark, d):
    c = context(spark, d)
    return E.edit_change_flags(c.facts, c.edits)


def working_view(spark, d):
    c = context(spark, d)
    return R.working_view(c.facts, c.masters)


def edit_view(spark, d):
    return R.edit_view(working_view(spark, d))


def paged_incidents(spark, d):
    """All incidents with their positions and pages; many are numbered and enriched range by range of their ids, and written."""
    c = context(spark, d)
    if not c.cuts:
        return _paged(c)
    out = J.new_folder(spark, "paged")
    with J.scratch(spark):
        last = _Last(spark)
        for part in c.parts():
            J.add_rows(enrich(R.paged_incidents(part.incidencias, given=last.given), part.masters), out)
            last.add(part.incidencias)
    return spark.read.parquet(out)


def _paged(c) -> DataFrame:
    return enrich(R.paged_incidents(c.incidencias), c.masters)


def page_slice(spark, d):
    c = context(spark, d)
    return R.page_slice(c.facts, R.page_index(c.incidencias), "SUP1", MONTHS[2], page=2)


def page_counts(spark, d):
    return R.page_counts(context(spark, d).incidencias, current_page=30)


def page_fingerprint(spark, d):
    return R.page_fingerprint(_paged(context(spark, d)))


def clear_scope(spark, d):
    return I.clear_scope(context(spark, d).facts, "SUP0", MONTHS[0])


def intake_by_centre(spark, d):
    c = context(spark, d)
    return I.intake_by_centre(c.requests, c.masters).select(*FACTS)


def intake_by_worker(spark, d):
    c = context(spark, d)
    return I.intake_by_worker(c.requests, c.masters).select(*FACTS)


def intake_replicate(spark, d):
    c = context(spark, d)
    return I.intake_replicate(c.requests, c.masters).select(*FACTS)


def intake_rejected(spark, d):
    return I.intake_rejected(context(spark, d).requests)


def append_intake(spark, d):
    c = context(spark, d)
    new = I.intake_by_centre(c.requests, c.masters).unionByName(I.intake_by_worker(c.requests, c.masters))
    # both are read three times: written first, each enrichment runs and broadcasts once
    return I.append_intake(J.materialize(c.facts, "facts"), J.materialize(new, "intake"))


class _Last:
    """Last positions of the sessions after the ranges of incidents so far, which lie in a folder of the open scratch."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n, self.given = spark, J.new_folder(spark, "last"), 0, None

    def add(self, facts: DataFrame) -> None:
        self.n += 1
        J.add_rows(R.last_positions(facts, self.given), f"{self.folder}/{self.n}")
        self.given = self.spark.read.parquet(f"{self.folder}/{self.n}")


def _kept_facts(c) -> str:
    """All facts kept in a new folder of the shared directory: ranges of ids ascend, so each goes behind those before."""
    base = f"{ensure_checkpoint_dir(c.spark).rstrip('/')}/covercost-kept-{uuid.uuid4().hex}"
    with J.scratch(c.spark):
        for k, part in enumerate(c.parts()):
            if k:
                K.append(c.spark, base, part.facts, ["incidencia_id"])
            else:
                K.save(part.facts, base)
    return base


def stored_edits(spark, d):
    """Facts kept by scope, edited and deleted from in place, with their new positions."""
    c = context(spark, d)
    base = _kept_facts(c)
    K.save_edits(spark, base, c.edits, c.masters)
    return K.load(spark, base)


def stored_clear(spark, d):
    """Facts kept by scope, of which one supervisor's January and a session that doesn't exist are cleared."""
    c = context(spark, d)
    base = _kept_facts(c)
    asked = c.incidencias.where((F.col("session_jefe") == "SUP0") & (F.col("imputacion_nomina") == MONTHS[0])).select(*P.SCOPE)
    with J.scratch(spark):
        asked = J.materialize(asked.distinct(), "asked")  # named twice
        K.clear(spark, base, asked.unionByName(asked.select(F.lit("nobody").alias("session_jefe"), "imputacion_nomina")))
    return K.load(spark, base)


def stored_append(spark, d):
    """Facts kept by scope, with the bulk intake added behind them; kept rows aren't touched."""
    c = context(spark, d)
    base = _kept_facts(c)
    new = I.intake_by_centre(c.requests, c.masters).unionByName(I.intake_by_worker(c.requests, c.masters))
    K.append(spark, base, new, ["request_id", "_orden"])
    return K.load(spark, base)


def stored_page(spark, d):
    """A page of a session, read from the kept facts by its positions."""
    return K.page(spark, _kept_facts(context(spark, d)), "SUP1", MONTHS[2], 2)


def export_names(spark, d):
    return S.export_names(Q.incident_counts(context(spark, d).facts), EXPORT_TS)


def header_normalize(spark, d):
    """Workers read with untidy headers (padding, alias name column) and normalised."""
    raw = fx.trabajadores(spark, d)
    messy = raw.toDF(*[(" Nombre " if c == "nombre_empleado" else f" {c}\n") for c in raw.columns])
    return SM.resolve_name_column(SM.normalize_headers(messy, newline_to_space=True))


def file_manifest(spark, d):
    return MF.file_manifest(spark, f"{d.rstrip('/')}/*.parquet")


def _scope_manifest(rows: DataFrame) -> DataFrame:
    text = F.concat_ws("|", "incidencia_id", R.row_fingerprint_text())
    return rows.groupBy(F.concat_ws("/", *P.SCOPE).alias("path")).agg(F.count(F.lit(1)).alias("length"), MF.row_digest(text).alias("md5"))


def manifest_states(spark, d):
    """Manifests of the sessions' contents before and after the edits: the first without a month, the second without a supervisor."""
    c = context(spark, d)
    old, new, kept = (J.new_folder(spark, x) for x in ("last", "now", "same"))
    with J.scratch(spark):
        for part in c.parts(F.col("imputacion_nomina") != ""):  # without a date there is no month; written, it would pass for December
            facts = part.written(part.facts, "facts")  # read three times
            J.add_rows(_scope_manifest(facts.where(F.col("imputacion_nomina") != MONTHS[1])), old)
            now = E.apply_edits(facts, part.edits, part.masters)
            J.add_rows(_scope_manifest(now.where((F.col("session_jefe") != "SUP4") & (F.col("imputacion_nomina") != MONTHS[3]))), new)
            J.add_rows(_scope_manifest(facts.where(F.col("imputacion_nomina") == MONTHS[3])), kept)
    last, now, same = (MF.merged(spark.read.parquet(x)) for x in (old, new, kept))
    return MF.compare(now.unionByName(same), last)


def _changed_pages(c, rows: list[str] | None = None) -> DataFrame:
    """Pages that the edits change; ``rows`` gets the folders of the paged rows with the edits, one for each range of ids.

    Numbering reads its rows three times, so those without and with the edits are written first.
    """
    spark, folders = c.spark, [J.new_folder(c.spark, x) for x in ("before", "after")]
    last = [_Last(spark), _Last(spark)]
    kept = J.new_folder(spark, "paged") if rows is not None else None
    for part in c.parts():
        facts = part.written(part.facts, "facts")
        both = facts, part.written(E.apply_edits(facts, part.edits, part.masters), "edited")
        paged = [R.paged_incidents(x, given=n.given) for x, n in zip(both, last, strict=True)]
        if rows is not None:
            rows.append(f"{kept}/{len(rows)}")
            J.add_rows(paged[1], rows[-1])
            paged[1] = spark.read.parquet(rows[-1])
            if part.cuts:
                release(spark)
        for x, n, pages, folder in zip(both, last, paged, folders, strict=True):
            J.add_rows(R.page_parts(pages), folder)
            n.add(x)
    before, after = (R.joined_pages(spark.read.parquet(x)) for x in folders)
    return R.changed_pages(after, before)


def page_changes(spark, d):
    """Pages that the edits change, by their digests before and after."""
    out = J.new_folder(spark, "changed")
    with J.scratch(spark):
        J.add_rows(_changed_pages(context(spark, d)), out)
    return spark.read.parquet(out)


def repriced_pages(spark, d):
    """Costed rows of the pages that the edits change, and of no others."""
    c, out, rows = context(spark, d), J.new_folder(spark, "repriced"), []
    with J.scratch(spark):
        changed = J.materialize(_changed_pages(c, rows), "changed")
        for folder in rows:  # a range's rows go when they are priced
            J.add_rows(R.reprice_pages(spark.read.parquet(folder), changed, c.masters), out)
            remove(spark, folder)
            if len(rows) > 1:
                release(spark)
    return spark.read.parquet(out)


def bad_input(spark, d):
    """A CSV worker list of which some lines lack fields or hold text for a number, loaded with its broken lines set apart."""
    w = fx.trabajadores(spark, d)
    k, names = F.col("row_idx"), ["nombre_empleado", "centro_preferente", "cat_empleado", "cod_reg_convenio", "coste_hora", "cod_empresa"]
    cost = F.when(k % 50 == 1, F.lit("n/a")).otherwise(F.coalesce(F.col("coste_hora").cast("string"), F.lit("")))
    whole = F.concat_ws(",", *[cost if c == "coste_hora" else F.coalesce(c, F.lit("")) for c in names])
    line = F.when(k % 50 == 0, F.concat("nombre_empleado", F.lit(",roto"))).otherwise(whole)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/covercost-lines-{uuid.uuid4().hex}"
    # one text column, whose name is the header line; the separator never occurs, so nothing is quoted
    w.select(line.alias(",".join([" Nombre ", *names[1:]]))).write.option("header", True).option("sep", "\u0001").csv(f"{base}/in")
    good, rejected, _ = SM.load_checked(spark, f"{base}/in", "trabajadores", f"{base}/out")
    good = good.select(F.lit("buena").alias("estado"), "nombre_empleado", "cat_empleado", "coste_hora", F.lit(None).cast("string").alias("registro"))
    none = F.lit(None).cast("string")
    return good.unionByName(rejected.select(F.lit("rechazada").alias("estado"), none.alias("nombre_empleado"), none.alias("cat_empleado"),
                                            F.lit(None).cast("double").alias("coste_hora"), F.col(SM.REJECTED).alias("registro")))


def intake_rules(spark, d):
    """Requests of which each rule stops some."""
    return I.intake_rejected(fx.odd_requests(spark, d))


def domain_rules(spark, d):
    """Incidents of which some break each rule, with the rules they break."""
    c = context(spark, d)
    return Q.domain_violations(fx.odd_incidents(c.facts), c.masters.worker_dim, c.masters.centre_codes, fx.COMPANIES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in list(globals().items())
    if callable(fn) and getattr(fn, "__module__", None) == __name__ and not name.startswith("_")
}

# Queries checked by row count only (no SQL oracle): file bytes are not a table.
ROWS_ONLY = ("file_manifest",)
