"""Night rate, payroll account, row costs, export table and scope totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covercost.constants import ACCOUNT_COLUMNS, EXPORT_FIELDS, NIGHT_COLUMN, SS_FACTOR, TOTAL_COLUMN
from covercost.functions import exact
from covercost.functions import normalize as N
from covercost.operators.edits import apply_edits
from covercost.operators.enrich import FACT_COLUMNS
from covercost.operators.joins import materialize, null_if_blank
from covercost.operators.masters import Masters
from covercost.operators.quality import valid_incidents

SCOPE = ("session_jefe", "imputacion_nomina")

# The products behind the totals, summed exactly (see functions.exact).
PRODUCTS = {
    "total_incidencias": ("incidencia_precio", "incidencia_horas"),
    "total_nocturnidad": ("precio_nocturnidad", "nocturnidad_horas"),
    "total_traslados": ("traslados_total", "coste_hora"),
}


def with_night_rate(facts: DataFrame, m: Masters, out: str = "precio_nocturnidad") -> DataFrame:
    """Night rate for each incident by (category, agreement); blank key or no match -> 0.0.

    Pairs copied from a worker are priced by a hash lookup on the raw pair
    (normalised once per pair in ``Masters.rate_by_pair``); any other pair
    is normalised per row and looked up in the rate dimension.
    """
    p = m.rate_by_pair.side().select(F.col("categoria").alias("_p_cat"), F.col("cod_reg_convenio").alias("_p_conv"),
                                     F.col("tarifa").alias("_p_rate"), F.lit(True).alias("_p_hit"))
    j = facts.join(p, F.col("categoria").eqNullSafe(F.col("_p_cat"))
                   & F.col("cod_reg_convenio").eqNullSafe(F.col("_p_conv")), "left")
    miss = F.col("_p_hit").isNull()
    # step by step, so that no long expression is written out twice: a generated method over the JIT's limit runs interpreted
    j = j.withColumns({"_cat": F.when(miss, N.incident_category("categoria")), "_conv": F.when(miss, N.strip_ws("cod_reg_convenio"))})
    j = j.withColumn("_conv", F.when(miss, N.agreement_of("_conv")))
    j = j.withColumns({"_cat": null_if_blank(F.col("_cat")), "_conv": null_if_blank(F.col("_conv"))})
    t = m.tariff_dim.side()
    j = j.join(t, (F.col("_cat") == t.cat_key) & (F.col("_conv") == t.conv_key), "left")
    rate = F.when(miss, F.coalesce(F.col("tarifa"), F.lit(0.0))).otherwise(F.col("_p_rate"))
    return j.withColumn(out, rate).drop("_p_cat", "_p_conv", "_p_rate", "_p_hit", "_cat", "_conv", "cat_key",
                                        "conv_key", "tarifa")


def with_account(facts: DataFrame, m: Masters, motivo_col: str = "motivo") -> DataFrame:
    """Account code of the incident reason; unmapped -> 'Otros'."""
    a = m.account_dim.side().select(F.col("motivo").alias("_a_motivo"), F.col("cuenta_codigo").alias("_a_code"))
    j = facts.join(a, F.col(motivo_col) == F.col("_a_motivo"), "left")
    return j.withColumn("cuenta_codigo", N.account_or_default(F.col("_a_code"))).drop("_a_motivo", "_a_code")


def with_worker_export_attrs(facts: DataFrame, m: Masters) -> DataFrame:
    """Contract share, company and centre name of the incident's worker ('' when unknown)."""
    w = m.worker_dim.side().select(F.col("nombre_empleado").alias("_x_name"),
                                   F.col("porcen_contrato").alias("_x_porcen"),
                                   F.col("cod_empresa").alias("_x_empresa"),
                                   F.col("nombre_centro_preferente").alias("_x_centro"))
    j = facts.join(w, F.col("trabajador") == F.col("_x_name"), "left")
    return (j.withColumn("porcen_contrato", F.coalesce("_x_porcen", F.lit("")))
            .withColumn("cod_empresa", F.coalesce("_x_empresa", F.lit("")))
            .withColumn("nombre_centro", F.coalesce("_x_centro", F.lit("")))
            .drop("_x_name", "_x_porcen", "_x_empresa", "_x_centro"))


def incident_amount(precio: Column, horas: Column) -> Column:
    return precio * horas


def coste_total(horas: Column, precio: Column, noct: Column, rate: Column, traslado: Column,
                factor: float = SS_FACTOR) -> Column:
    """(hours·price + night hours·night rate)·factor + transfer hours (hours not priced)."""
    return (horas * precio + noct * rate) * F.lit(factor) + traslado


def account_split(df: DataFrame, code_col: str = "cuenta_codigo", amount_col: str = "_amount") -> DataFrame:
    out = df
    for name, code in ACCOUNT_COLUMNS:
        out = out.withColumn(name, F.when(F.col(code_col) == code, F.col(amount_col)).otherwise(F.lit(0.0)))
    return out


def export_costed(facts: DataFrame, m: Masters, factor: float = SS_FACTOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid incidents as the 29-column costed table (plus the session column, and columns to ``keep``)."""
    v = valid_incidents(facts)
    v = with_night_rate(v, m)
    v = with_account(v, m)
    v = with_worker_export_attrs(v, m)
    v = v.withColumn("_amount", incident_amount(F.col("incidencia_precio"), F.col("incidencia_horas")))
    v = account_split(v)
    cols = [F.col(src).alias(name) for name, src in EXPORT_FIELDS]
    cols += [F.col(name) for name, _ in ACCOUNT_COLUMNS]
    cols.append((F.col("precio_nocturnidad") * F.col("nocturnidad_horas")).alias(NIGHT_COLUMN))
    cols.append(coste_total(F.col("incidencia_horas"), F.col("incidencia_precio"), F.col("nocturnidad_horas"),
                            F.col("precio_nocturnidad"), F.col("traslados_total"), factor).alias(TOTAL_COLUMN))
    return v.select("session_jefe", *keep, *cols)


def _z(c: str) -> Column:
    return F.coalesce(N.nan_to_null(F.col(c)), F.lit(0.0))


TOTAL_NAMES = ("total_incidencias", "total_nocturnidad", "total_traslados", "total_simple", "total_con_ss")


def total_parts(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Row count and exact partial sums of priced incidents by ``keys``; null and NaN factors count as 0."""
    factors = {c for pair in PRODUCTS.values() for c in pair}
    clean = priced.select(*keys, *[_z(c).alias(c) for c in sorted(factors)])
    return exact.with_pieces(clean, PRODUCTS).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_validas"), *exact.sums(PRODUCTS))


def merged_parts(parts: DataFrame, keys: list[str], sign: Column | None = None) -> DataFrame:
    """Partial sums added up by ``keys``, each row with its ``sign`` (1 or -1) if given."""
    n = F.col("n_validas") if sign is None else F.col("n_validas") * sign
    return parts.groupBy(*keys).agg(F.sum(n).alias("n_validas"), *exact.sums(PRODUCTS, sign))


def totals_of(parts: DataFrame, factor: float = SS_FACTOR) -> DataFrame:
    """The five totals as doubles, each rounded once from its exact sums."""
    inc, noct, tras = (F.col(c) for c in PRODUCTS)
    return exact.with_values(parts, PRODUCTS).withColumns(
        {"total_simple": inc + noct + tras, "total_con_ss": (inc + noct) * F.lit(factor) + tras})


def scope_gate(df: DataFrame) -> DataFrame:
    """Nothing is reported until both supervisor and month are set."""
    return df.filter(~N.is_blank("session_jefe") & ~N.is_blank("imputacion_nomina"))


def priced(facts: DataFrame, m: Masters) -> DataFrame:
    """The valid incidents of sessions with a supervisor and month, with their night rates."""
    return with_night_rate(valid_incidents(scope_gate(facts)), m)


def summary_by_scope(facts: DataFrame, m: Masters, factor: float = SS_FACTOR) -> DataFrame:
    """Five cost totals of the valid incidents of every (supervisor session, month)."""
    return totals_of(total_parts(priced(facts, m), list(SCOPE)), factor)


def summary_totals(facts: DataFrame, m: Masters, factor: float = SS_FACTOR) -> DataFrame:
    """The five totals over all valid incidents (one row)."""
    return totals_of(total_parts(with_night_rate(valid_incidents(facts), m), []), factor)


def summary_formatted(facts: DataFrame, m: Masters, factor: float = SS_FACTOR) -> DataFrame:
    """Totals per scope as money text (``€1,234.50``)."""
    return summary_by_scope(facts, m, factor).select(*SCOPE, *[N.money(F.col(c).try_cast("decimal(38,10)")).alias(c) for c in TOTAL_NAMES])


def edit_deltas(before: DataFrame, edits: DataFrame, m: Masters) -> DataFrame:
    """What edits and deletions change in the partial sums of each scope.

    ``before``: the incidents as they are kept, of which only the edited ones
    are looked at.  Their old shares count with -1, their new ones with 1; as
    the sums are exact, adding a delta to kept sums gives those of a new count.
    """
    touched = before.join(edits.select("incidencia_id").distinct(), "incidencia_id", "left_semi").select(*before.columns)
    touched = materialize(touched, "touched")  # looked at before and after the edits
    after = apply_edits(touched, edits, m)
    old = total_parts(priced(touched, m), list(SCOPE)).withColumn("_sign", F.lit(-1))
    new = total_parts(priced(after, m), list(SCOPE)).withColumn("_sign", F.lit(1))
    return merged_parts(old.unionByName(new), list(SCOPE), F.col("_sign"))


def totals_after(parts: DataFrame, deltas: DataFrame, factor: float = SS_FACTOR) -> DataFrame:
    """Totals of kept partial sums with their deltas; scopes without valid incidents are left out."""
    now = merged_parts(parts.unionByName(deltas), list(SCOPE)).where("n_validas > 0")
    return totals_of(now, factor)


def distinct_rate_keys(facts: DataFrame, m: Masters) -> DataFrame:
    """Distinct (category, agreement) pairs of valid incidents with their night rate."""
    keys = valid_incidents(facts).select("categoria", "cod_reg_convenio").distinct()
    return with_night_rate(keys, m)


__all__ = ["FACT_COLUMNS", "export_costed", "summary_by_scope", "summary_totals", "with_night_rate"]
