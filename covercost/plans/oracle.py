"""Equivalent SQL for every registered query, in DuckDB's dialect.

The fixture projections are the same as the Spark ones; shared steps are
CTEs, and each query lists the CTEs it needs (dependencies are added).
Dialect notes: DuckDB's double->bigint cast rounds, so ``trunc`` comes
first; ``regexp_replace`` needs the 'g' flag to replace every match.
"""

from __future__ import annotations

from covercost.constants import (ACCOUNT_COLUMNS,
                                 EDIT_HIDDEN, EXPORT_FIELDS, FACTURABLE_VALUES, NIGHT_COLUMN, TOTAL_COLUMN,
                                 VIEW_FIELDS, VIEW_NUMBERS, VIEW_TEXT,
                                 MISSING_FIELD_LABELS, MONTHS, MOTIVO_VALUES, REQUIRED_FIELDS, ROWS_PER_PAGE,
                                 SS_FACTOR)
from covercost.functions import exact
from covercost.operators.pricing import PRODUCTS, TOTAL_NAMES
from covercost.sources.fixtures import MOTIVOS_ROWS


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def in_list(values) -> str:
    return ", ".join(lit(v) for v in values)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def int_text(x: str) -> str:
    return f"CAST(try_cast(trunc(try_cast({x} AS DOUBLE)) AS BIGINT) AS VARCHAR)"


def n1(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({x}, '[-.0-9]*[0-9][-.0-9]*') AND {int_text(x)} IS NOT NULL "
            f"THEN {int_text(x)} ELSE {x} END")


def n2(x: str) -> str:
    return f"coalesce({int_text(x)}, {strip(x)}, '')"


def n3a(x: str) -> str:
    return "upper(" + strip(f"coalesce({x}, 'nan')") + ")"


def n3b(x: str) -> str:
    return "regexp_replace(upper(" + strip(f"coalesce({x}, '')") + "), '^[^ ] ', '')"


def blank(x: str) -> str:
    return f"coalesce({x}, '') = ''"


def z(x: str) -> str:
    return f"coalesce(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, 0.0)"


def edit_text(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR lower({x}) IN ('nan', 'none', '') THEN '' ELSE {strip(x)} END"


def edit_code(x: str) -> str:
    cleaned = strip(f"replace({x}, '.0', '')")
    return f"CASE WHEN {x} IS NULL OR {x} IN ('', 'nan', 'None') THEN '' ELSE {cleaned} END"


def edit_number(x: str) -> str:
    return f"coalesce(try_cast({x} AS DOUBLE), 0.0)"


def view_text(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} IN ('nan', 'None') THEN '' ELSE {x} END"


def last_wins(src: str, keys: str, order: str) -> str:
    return (f"SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn_ "
            f"FROM {src}) WHERE rn_ = 1")


FACT_COLUMNS = (
    "incidencia_id", "session_jefe", "imputacion_nomina", "trabajador", "facturable", "motivo",
    "codigo_crown_origen", "codigo_crown_destino", "empresa_destino", "incidencia_horas",
    "incidencia_precio", "nocturnidad_horas", "traslados_total", "coste_hora", "fecha",
    "observaciones", "centro_preferente", "nombre_jefe_ope", "categoria", "servicio",
    "cod_reg_convenio", "nombre_crown_destino",
)
FACTS = ", ".join(FACT_COLUMNS)
SCOPE = "session_jefe, imputacion_nomina"
VALID = " AND ".join(f"{c} IS NOT NULL AND {c} <> ''" for c in REQUIRED_FIELDS)

_MONTH_CASE = " ".join(f"WHEN {i + 1} THEN {lit(m)}" for i, m in enumerate(MONTHS))
_MOTIVOS_VALUES = ", ".join(f"({r}, {lit(m)}, {lit(d)})" for r, m, d in MOTIVOS_ROWS)

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


# -- fixtures -----------------------------------------------------------------
cte("centros", """
select s_suppkey as row_idx,
  case when s_suppkey % 17 = 16 then null when s_suppkey % 19 = 18 then ''
       when s_suppkey % 23 = 22 then concat('X', cast(s_suppkey as varchar))
       when s_suppkey % 13 = 12 then cast(99 + s_suppkey as varchar)
       when s_suppkey % 2 = 0 then concat(cast(100 + s_suppkey as varchar), '.0')
       else cast(100 + s_suppkey as varchar) end as cod_centro_preferente,
  s_name as desc_centro_preferente,
  case when s_nationkey % 7 = 6 then null else n_name end as nombre_jefe_ope,
  cast(null as timestamp) as fecha_alta_centro,
  case when s_acctbal < 0 then timestamp '2001-01-01 00:00:00' end as fecha_baja_centro,
  'A1' as almacen_centro
from supplier join nation on s_nationkey = n_nationkey""")

cte("trabajadores", """
select c_custkey as row_idx,
  lower(concat('Employee#', cast(case when c_custkey % 10 = 9 then c_custkey - 9 else c_custkey end as varchar))) as nombre_empleado,
  case when c_custkey % 31 = 30 then null
       else concat(cast(100 + c_custkey % (select count(*) from supplier) as varchar), '.0') end as centro_preferente,
  case c_mktsegment when 'BUILDING' then 'h Economy' when 'HOUSEHOLD' then 'Standard Limp'
       when 'MACHINERY' then 'promo' when 'FURNITURE' then 'g small' end as cat_empleado,
  concat(cast(99100165012001 + c_nationkey as varchar), case when c_custkey % 2 = 0 then '.0' else '' end) as cod_reg_convenio,
  case when c_custkey % 13 = 12 then null else c_acctbal / 100 end as coste_hora,
  case when c_custkey % 3 = 0 then 'OWN_SUP' end as nombre_jefe_ope,
  cast(50 + c_custkey % 51 as varchar) as porcen_contrato,
  concat('E', cast(c_nationkey % 3 as varchar)) as cod_empresa
from customer""")

cte("tarifas", """
select p_partkey as row_idx,
  case when p_type = 'STANDARD' then 'Standard Limp' else concat(' ', lower(p_type), ' ') end as descripcion,
  concat(cast(99100165012000 + cast(substr(p_brand, 7) as bigint) as varchar), '.0') as cod_convenio,
  case when p_partkey % 11 = 10 then 'n/a' else cast(p_retailprice / 100 as varchar) end as tarifa_noct
from part""")

cte("motivos", f"select * from (values {_MOTIVOS_VALUES}) as v(row_idx, motivo, desc_cuenta)")

cte("incidencias", f"""
select concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar), cast(l_partkey as varchar),
    cast(l_suppkey as varchar), cast(cast(l_quantity as int) as varchar), cast(cast(l_shipdate as date) as varchar)) as incidencia_id,
  concat('SUP', cast(o_custkey % 5 as varchar)) as session_jefe,
  case extract(month from l_shipdate) {_MONTH_CASE} end as imputacion_nomina,
  case when l_partkey % 37 = 36 then 'UNKNOWN'
       else upper(concat('employee#', cast(case when o_custkey % 10 = 9 then o_custkey - 9 else o_custkey end as varchar))) end as trabajador,
  case when l_returnflag = 'A' then 'Sí' when l_returnflag = 'N' then 'No' when l_linestatus = 'F' then '' else 'Sí' end as facturable,
  case o_orderpriority when '1-URGENT' then 'Festivos y Fines de Semana' when '2-HIGH' then 'Absentismo'
    when '3-MEDIUM' then 'Refuerzo' when '4-NOT SPECIFIED' then 'Nocturnidad' else 'Otros' end as motivo,
  case when l_suppkey % 29 = 28 then '' else cast(100 + l_suppkey as varchar) end as codigo_crown_destino,
  l_quantity as incidencia_horas, l_discount * 100 + 5 as incidencia_precio, l_tax * 100 as nocturnidad_horas,
  cast(l_linenumber as double) as traslados_total,
  case when l_linenumber = 7 then '' else cast(cast(l_shipdate as date) as varchar) end as fecha,
  concat('obs ', l_linestatus) as observaciones
from lineitem join orders on l_orderkey = o_orderkey""")

cte("edits", """
select incidencia_id, traslados_total = 3 as borrar,
  case when traslados_total = 2 then 'EMPLOYEE#1' else trabajador end as trabajador,
  case when nocturnidad_horas > 6 then ' nan ' else motivo end as motivo,
  concat(codigo_crown_destino, '.0') as codigo_crown_destino,
  case when nocturnidad_horas < 2 then 'bad' else cast(incidencia_horas + 1 as varchar) end as incidencia_horas
from incidencias where incidencia_horas >= 45""", "incidencias")

cte("requests", f"""
select s_suppkey as request_id, concat('SUP', cast(s_suppkey % 5 as varchar)) as session_jefe, {lit(MONTHS[0])} as imputacion_nomina,
  case when s_suppkey % 2 = 0 then 'centro' else 'trabajador' end as kind,
  cast(100 + s_suppkey as varchar) as centro_origen,
  concat('EMPLOYEE#', cast(s_suppkey as varchar)) as trabajador,
  concat(cast(101 + s_suppkey as varchar), case when s_suppkey % 3 = 0 then ',X22' else '' end) as destinos_csv,
  1 + s_suppkey % 3 as num_rows
from supplier""")

# -- masters ------------------------------------------------------------------
cte("centros_clean", f"""
select row_idx, {n1('cod_centro_preferente')} as cod_centro_preferente, desc_centro_preferente, nombre_jefe_ope,
  {n1('cod_centro_preferente')} as codigo_centro
from centros
where cod_centro_preferente is not null and cod_centro_preferente <> '' and fecha_baja_centro is null
  and not coalesce(nombre_jefe_ope in ('NATION_0', 'NATION_1', 'NATION_2'), false)""", "centros")

cte("centros_lookup", f"""
select min(row_idx) as row_idx, code as cod_centro_preferente, descr as desc_centro_preferente, label as nombre_centro_display
from (select row_idx, code, descr, code || ' - ' || coalesce(descr, 'nan') as label
      from (select row_idx, {n1('cod_centro_preferente')} as code, desc_centro_preferente as descr from centros_clean) a) b
group by code, descr, label""", "centros_clean")

cte("centre_first", f"""
select cod_centro_preferente, desc_centro_preferente, row_idx
from ({last_wins('centros_lookup', 'cod_centro_preferente', 'row_idx asc')})""", "centros_lookup")

cte("workers_clean", """
select row_idx, upper(nombre_empleado) as nombre_empleado, centro_preferente, cat_empleado, cod_reg_convenio, coste_hora,
  nombre_jefe_ope, porcen_contrato, cod_empresa,
  case when coalesce(regexp_matches(cat_empleado, 'limp|asl', 'i'), false) then '020 Limpieza' else '010 Restauración' end as servicio
from trabajadores""", "trabajadores")

cte("workers_enriched", f"""
select w.row_idx, w.nombre_empleado, w.cp as centro_preferente, w.cat_empleado, w.cod_reg_convenio, w.coste_hora,
  w.porcen_contrato, w.cod_empresa, w.servicio, coalesce(c.nombre_jefe_ope, w.nombre_jefe_ope) as nombre_jefe_ope,
  c.desc_centro_preferente as nombre_centro_preferente, c.row_idx as centre_row_idx
from (select *, {n1('centro_preferente')} as cp from workers_clean) w
left join centros_clean c on w.cp = c.codigo_centro""", "workers_clean", "centros_clean")

cte("worker_dim", f"""
select nombre_empleado, coalesce(cat_empleado, '') as cat_empleado, coalesce(servicio, '') as servicio, '' as cod_crown,
  coalesce(centro_preferente, '') as centro_preferente, coalesce(nombre_centro_preferente, '') as nombre_centro_preferente,
  coalesce(nombre_jefe_ope, '') as nombre_jefe_ope, {z('coste_hora')} as coste_hora,
  coalesce(cod_reg_convenio, '') as cod_reg_convenio, coalesce(porcen_contrato, '') as porcen_contrato,
  coalesce(cod_empresa, '') as cod_empresa
from ({last_wins("(select * from workers_enriched where nombre_empleado is not null and nombre_empleado <> '')",
                 'nombre_empleado', 'row_idx desc nulls first, centre_row_idx desc nulls first')})""", "workers_enriched")

cte("tariff_dim", f"""
select cat_key, conv_key, tarifa from ({last_wins(f'''(select * from (select row_idx, {n3a('descripcion')} as cat_key,
      {n2('cod_convenio')} as conv_key, try_cast(tarifa_noct as double) as tarifa from tarifas) t
    where cat_key <> '' and conv_key <> '' and tarifa is not null and not isnan(tarifa))''',
    'cat_key, conv_key', 'row_idx desc')})""", "tarifas")

cte("account_dim", f"""
select motivo, cuenta_codigo from ({last_wins('''(select * from (select row_idx, coalesce(motivo, '') as motivo,
      case when coalesce(desc_cuenta, '') like '%70/71%' then '70_71'
           when starts_with(coalesce(desc_cuenta, ''), '73') then '73'
           when starts_with(coalesce(desc_cuenta, ''), '72') then '72'
           when starts_with(coalesce(desc_cuenta, ''), '74') then '74' end as cuenta_codigo from motivos) t
    where cuenta_codigo is not null)''', 'motivo', 'row_idx desc')})""", "motivos")

# -- facts --------------------------------------------------------------------
_DEST = ("case when w.nombre_empleado is null then '' when coalesce(i.codigo_crown_destino, '') <> '' "
         "then i.codigo_crown_destino else w.centro_preferente end")


def enrich_sql(src: str, extra: str = "") -> str:
    """Enrichment of a table with user fields (fresh-intake semantics)."""
    return f"""
select i.incidencia_id, i.session_jefe, i.imputacion_nomina,
  case when w.nombre_empleado is null then '' else w.nombre_empleado end as trabajador,
  i.facturable, i.motivo,
  case when w.nombre_empleado is null then '' else w.centro_preferente end as codigo_crown_origen,
  {_DEST} as codigo_crown_destino, i.empresa_destino,
  i.incidencia_horas, i.incidencia_precio, i.nocturnidad_horas, i.traslados_total,
  case when w.nombre_empleado is null then 0.0 else w.coste_hora end as coste_hora, i.fecha, i.observaciones,
  case when w.nombre_empleado is null then '' else w.centro_preferente end as centro_preferente,
  case when w.nombre_empleado is null then '' else w.nombre_jefe_ope end as nombre_jefe_ope,
  case when w.nombre_empleado is null then '' else w.cat_empleado end as categoria,
  case when w.nombre_empleado is null then '' else w.servicio end as servicio,
  case when w.nombre_empleado is null then '' else w.cod_reg_convenio end as cod_reg_convenio,
  case when w.nombre_empleado is null then '' else coalesce(cf.desc_centro_preferente, '') end as nombre_crown_destino
  {extra}
from {src} i
left join worker_dim w on i.trabajador = w.nombre_empleado
left join centre_first cf on cf.cod_centro_preferente = {_DEST}"""


cte("facts", enrich_sql("(select *, '' as empresa_destino from incidencias)"), "incidencias", "worker_dim",
    "centre_first")
cte("valid", f"select * from facts where {VALID}", "facts")

_RATE_JOIN = f"left join tariff_dim t on t.cat_key = {n3b('f.categoria')} and t.conv_key = {n2('f.cod_reg_convenio')}"

cte("rated_valid", f"select f.*, coalesce(t.tarifa, 0.0) as precio_nocturnidad from valid f {_RATE_JOIN}",
    "valid", "tariff_dim")
cte("rated_facts", f"select f.*, coalesce(t.tarifa, 0.0) as precio_nocturnidad from facts f {_RATE_JOIN}",
    "facts", "tariff_dim")

# Exact sums: no factor is rounded before it is multiplied (functions.exact, with DuckDB's rounding and shift).
_SHIFT = "({} >> {})"
_FACTORS = sorted({c for pair in PRODUCTS.values() for c in pair})
_CLEAN = ", ".join(f"{z(c)} as {c}" for c in _FACTORS)
_SPLIT = ", ".join(f"{sql} as {c}" for name, (a, b) in PRODUCTS.items() for c, sql in exact.product_sql(a, b, name))
_PIECES = [piece for name in PRODUCTS for piece in exact.pieces_sql(name, "round_even({}, 0)")]
_SUMS = "count(*) as n_validas, " + ", ".join(
    f"coalesce(sum({c}), 0)::{'double' if c.endswith('_x') else 'bigint'} as {c}" for c, _ in _PIECES)
_VALUES = ", ".join(f"{exact.value_sql(name, _SHIFT)} as {name}" for name in PRODUCTS)
_TOTALS = f"""total_incidencias, total_nocturnidad, total_traslados,
  total_incidencias + total_nocturnidad + total_traslados as total_simple,
  (total_incidencias + total_nocturnidad) * {SS_FACTOR}e0 + total_traslados as total_con_ss"""


def _sums_of(rows: str, by: str = "") -> str:
    """Totals of priced rows, of all or by scope."""
    pieces = ", ".join(f"{sql} as {c}" for c, sql in _PIECES)
    on = f"{by}, " if by else ""
    return f"""select {on}n_validas, {_VALUES} from (select {on}{_SUMS} from (select {on}{pieces} from (
      select {on}{_SPLIT} from (select {on}{_CLEAN} from {rows}))){f' group by {by}' if by else ''})"""


_GATED = "(select * from {} where coalesce(session_jefe, '') <> '' and coalesce(imputacion_nomina, '') <> '')"
cte("scope_totals", _sums_of(_GATED.format("rated_valid"), SCOPE), "rated_valid")

cte("costed", f"""
select f.*, coalesce(a.cuenta_codigo, 'Otros') as cuenta_codigo,
  coalesce(w.porcen_contrato, '') as porcen_contrato, coalesce(w.cod_empresa, '') as cod_empresa,
  coalesce(w.nombre_centro_preferente, '') as nombre_centro, f.incidencia_precio * f.incidencia_horas as amount_
from rated_valid f left join account_dim a on f.motivo = a.motivo
left join worker_dim w on f.trabajador = w.nombre_empleado""", "rated_valid", "account_dim", "worker_dim")

_EXPORT = ", ".join(
    ["session_jefe"]
    + [f"{src} as {q(name)}" for name, src in EXPORT_FIELDS]
    + [f"case when cuenta_codigo = '{code}' then amount_ else 0.0 end as {q(name)}" for name, code in ACCOUNT_COLUMNS]
    + [f"precio_nocturnidad * nocturnidad_horas as {q(NIGHT_COLUMN)}",
       f"(incidencia_horas * incidencia_precio + nocturnidad_horas * precio_nocturnidad) * cast({SS_FACTOR} as double)"
       f" + traslados_total as {q(TOTAL_COLUMN)}"])

# -- edits ----------------------------------------------------------------------
cte("edited", f"""
select f.*, e.incidencia_id is not null as hit_, coalesce(e.borrar, false) as borrar_,
  {edit_text('e.trabajador')} as n_trabajador, {edit_text('f.facturable')} as n_facturable,
  {edit_text('e.motivo')} as n_motivo, {edit_text('f.empresa_destino')} as n_empresa_destino,
  {edit_text(view_text('f.observaciones'))} as n_observaciones,
  {edit_code(view_text('f.codigo_crown_origen'))} as n_codigo_crown_origen,
  {edit_code('e.codigo_crown_destino')} as n_codigo_crown_destino,
  {edit_number('e.incidencia_horas')} as n_incidencia_horas, {z('f.incidencia_precio')} as n_incidencia_precio,
  {z('f.nocturnidad_horas')} as n_nocturnidad_horas, {z('f.traslados_total')} as n_traslados_total,
  coalesce({strip(view_text('f.fecha'))}, '') as n_fecha
from facts f join edits e on f.incidencia_id = e.incidencia_id""", "facts", "edits")

_EDITABLE = ("trabajador", "facturable", "motivo", "empresa_destino", "observaciones", "codigo_crown_origen",
             "codigo_crown_destino", "incidencia_horas", "incidencia_precio", "nocturnidad_horas",
             "traslados_total", "fecha")

cte("edit_rows", f"""
select {', '.join(('n_' + c + ' as ' + c) if c in _EDITABLE else c for c in FACT_COLUMNS)},
  n_trabajador <> '' and n_trabajador <> trabajador as changed_
from edited where not borrar_""", "edited")

_RE = {"trabajador": "w.nombre_empleado", "categoria": "w.cat_empleado", "servicio": "w.servicio",
       "centro_preferente": "w.centro_preferente", "codigo_crown_origen": "w.centro_preferente",
       "cod_reg_convenio": "w.cod_reg_convenio", "nombre_jefe_ope": "w.nombre_jefe_ope",
       "codigo_crown_destino": "d_", "nombre_crown_destino": "coalesce(cf.desc_centro_preferente, '')",
       "coste_hora": "w.coste_hora"}

cte("edit_rows_dest", """
select r.*, w.nombre_empleado as w_name,
  case when r.changed_ and w.nombre_empleado is not null then
    case when coalesce(r.codigo_crown_destino, '') <> '' then r.codigo_crown_destino else w.centro_preferente end
  else r.codigo_crown_destino end as d_
from edit_rows r left join worker_dim w on r.trabajador = w.nombre_empleado""", "edit_rows", "worker_dim")

cte("applied", f"""
select {', '.join(f"case when r.changed_ and r.w_name is not null then {_RE[c].replace('w.', 'w2.')} else r.{c} end as {c}"
                  if c in _RE else f"r.{c}" for c in FACT_COLUMNS)}
from edit_rows_dest r left join worker_dim w2 on r.trabajador = w2.nombre_empleado
left join centre_first cf on cf.cod_centro_preferente = r.d_
union all
select {FACTS} from facts where incidencia_id not in (select incidencia_id from edits)""",
    "edit_rows_dest", "worker_dim", "centre_first", "facts", "edits")

# -- paging ---------------------------------------------------------------------
cte("paged", f"""
select *, row_number() over (partition by {SCOPE} order by incidencia_id) as seq,
  cast(floor((row_number() over (partition by {SCOPE} order by incidencia_id) - 1) / {ROWS_PER_PAGE}) + 1 as bigint) as pagina
from facts""", "facts")

# -- intake -----------------------------------------------------------------------
cte("req", """
select * exclude (l_), list_filter(l_, lambda x: x <> '') as destinos,
  case when strpos(trabajador, ' - ') > 0 then substr(trabajador, strpos(trabajador, ' - ') + 3) else trabajador end as name_
from (select *, string_split(coalesce(destinos_csv, ''), ',') as l_ from requests)""", "requests")
cte("staff", """
select distinct centro_preferente as codigo_centro, nombre_empleado from workers_enriched
where coalesce(centro_preferente, '') <> '' and nombre_empleado is not null""", "workers_enriched")
cte("new_by_centre", """
select concat_ws(':', 'R', cast(request_id as varchar), kind, orden_) as incidencia_id, session_jefe, imputacion_nomina, request_id, orden_,
  nombre_empleado as trabajador, dest_ as codigo_crown_destino
from (select r.*, s.nombre_empleado, u.dest_, lpad(cast(u.pos_ - 1 as varchar), 10, '0') || ':' || s.nombre_empleado as orden_
      from req r join staff s on r.centro_origen = s.codigo_centro, unnest(r.destinos) with ordinality as u(dest_, pos_)
      where r.kind = 'centro' and coalesce(r.centro_origen, '') <> '') t""", "req", "staff")
cte("new_by_worker", """
select concat_ws(':', 'R', cast(request_id as varchar), kind, orden_) as incidencia_id,
  session_jefe, imputacion_nomina, request_id, orden_, name_ as trabajador, dest_ as codigo_crown_destino
from (select r.*, u.dest_, lpad(cast(u.pos_ - 1 as varchar), 10, '0') as orden_
      from req r, unnest(r.destinos) with ordinality as u(dest_, pos_)
      where r.kind = 'trabajador' and len(r.destinos) between 1 and 10) t
where coalesce(name_, '') <> ''""", "req")
cte("new_replicate", """
select concat_ws(':', 'R', cast(request_id as varchar), kind, orden_) as incidencia_id,
  session_jefe, imputacion_nomina, request_id, orden_, name_ as trabajador, dest_ as codigo_crown_destino
from (select r.*, u.dest_, lpad(cast(u.pos_ - 1 as varchar), 10, '0') || ':' || lpad(cast(g.k as varchar), 10, '0') as orden_
      from req r, generate_series(1, r.num_rows) as g(k),
        unnest(case when len(r.destinos) > 0 then r.destinos else [''] end) with ordinality as u(dest_, pos_) where r.num_rows >= 1) t
where coalesce(name_, '') <> ''""", "req")

_USER_BLANK = ("(select *, '' as facturable, '' as motivo, '' as empresa_destino, 0.0 as incidencia_horas, "
               "0.0 as incidencia_precio, 0.0 as nocturnidad_horas, 0.0 as traslados_total, '' as fecha, "
               "'' as observaciones from {src})")
for _n in ("new_by_centre", "new_by_worker", "new_replicate"):
    cte(f"enriched_{_n}", enrich_sql(_USER_BLANK.format(src=_n), ", i.request_id, i.orden_"), _n, "worker_dim",
        "centre_first")


cte("v_", """select a.*, w.wk_, c.ck_ from applied a
left join (select nombre_empleado, true as wk_ from worker_dim) w on a.trabajador = w.nombre_empleado
left join (select distinct codigo_centro, true as ck_ from centros_clean) c on a.codigo_crown_destino = c.codigo_centro""",
    "applied", "worker_dim", "centros_clean")


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]})" for n in order]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _labels_sql() -> str:
    return (f"select etiqueta from (select distinct coalesce(centro_preferente, 'nan') || ' - ' || "
            f"coalesce(nombre_empleado, 'nan') as etiqueta from workers_enriched)")


def _missing_sql() -> str:
    cases = ", ".join(f"case when {blank(c)} then {lit(lbl)} end" for c, lbl in MISSING_FIELD_LABELS)
    return f"concat_ws(', ', {cases})"


def _violations_sql(rows: str = "v_") -> str:
    rules = [
        (f"coalesce(facturable, '') not in ({in_list(FACTURABLE_VALUES)})", "facturable_fuera_de_dominio"),
        (f"not ({blank('motivo')}) and motivo not in ({in_list(MOTIVO_VALUES)})", "motivo_fuera_de_dominio"),
        (f"coalesce(empresa_destino, '') not in ('', 'E0', 'E1', 'E2')", "empresa_fuera_de_dominio"),
        (f"coalesce(imputacion_nomina, '') not in ({in_list(MONTHS)})", "mes_fuera_de_dominio"),
        (f"not ({blank('trabajador')}) and wk_ is null", "trabajador_desconocido"),
        (f"not ({blank('codigo_crown_destino')}) and ck_ is null", "centro_destino_desconocido"),
    ]
    rules += [(f"{c} < 0", f"{c}_negativo") for c in
              ("incidencia_horas", "incidencia_precio", "nocturnidad_horas", "traslados_total")]
    rules += [(blank(c), f"falta_{c}") for c in (*REQUIRED_FIELDS, "observaciones")]
    return " union all ".join(f"select incidencia_id, {lit(name)} as regla from {rows} where {cond}" for cond, name in rules)


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["scan_masters"] = with_ctes(" union all ".join(
        f"select '{t}' as tabla, count(*) as n_filas from {t}"
        for t in ("centros", "trabajadores", "tarifas", "motivos", "incidencias", "edits", "requests")),
        "centros", "trabajadores", "tarifas", "motivos", "incidencias", "edits", "requests")
    out["centros_clean"] = with_ctes("select * from centros_clean", "centros_clean")
    out["centros_lookup"] = with_ctes("select * from centros_lookup", "centros_lookup")
    out["centre_first"] = with_ctes("select * from centre_first", "centre_first")
    out["centre_by_label"] = with_ctes(f"""select nombre_centro_display, cod_centro_preferente from
        ({last_wins('centros_lookup', 'nombre_centro_display', 'row_idx asc')})""", "centros_lookup")
    out["normalize_centre_code"] = with_ctes(f"""
        select 'centros' as fuente, row_idx, cod_centro_preferente as codigo, {n1('cod_centro_preferente')} as codigo_normalizado from centros
        union all select 'trabajadores', row_idx, centro_preferente, {n1('centro_preferente')} from trabajadores""",
                                             "centros", "trabajadores")
    out["normalize_agreement"] = with_ctes(f"""
        select 'trabajadores' as fuente, row_idx, cod_reg_convenio as codigo, {n2('cod_reg_convenio')} as codigo_normalizado from trabajadores
        union all select 'tarifas', row_idx, cod_convenio, {n2('cod_convenio')} from tarifas""", "trabajadores", "tarifas")
    out["workers_clean"] = with_ctes("select * from workers_clean", "workers_clean")
    out["workers_enriched"] = with_ctes("select * exclude (centre_row_idx) from workers_enriched", "workers_enriched")
    out["worker_dim"] = with_ctes("select * from worker_dim", "worker_dim")
    out["tariff_dim"] = with_ctes("select * from tariff_dim", "tariff_dim")
    out["supervisors"] = with_ctes("select distinct nombre_jefe_ope from centros_clean where nombre_jefe_ope is not null",
                                   "centros_clean")
    out["centre_codes"] = with_ctes("select distinct codigo_centro from centros_clean where codigo_centro is not null",
                                    "centros_clean")
    out["centre_options"] = with_ctes("select '' as option union all select distinct codigo_centro from centros_clean "
                                      "where codigo_centro is not null", "centros_clean")
    out["employees"] = with_ctes("select distinct nombre_empleado from workers_enriched where nombre_empleado is not null",
                                 "workers_enriched")
    out["employees_with_centre"] = with_ctes(_labels_sql(), "workers_enriched")
    out["employees_by_centre"] = with_ctes("select * from staff", "staff")
    out["workers_per_centre"] = with_ctes("select codigo_centro, count(*) as n_trabajadores from staff group by codigo_centro",
                                          "staff")
    out["legacy_centre_map"] = with_ctes("""select row_idx, cod_centro_preferente as codigo_centro,
        desc_centro_preferente as nombre_centro, nombre_jefe_ope as cod_centro_preferente from centros""", "centros")
    out["split_worker_label"] = with_ctes(f"""select etiqueta,
        case when strpos(etiqueta, ' - ') > 0 then substr(etiqueta, 1, strpos(etiqueta, ' - ') - 1) else '' end as cod_centro_visual,
        case when strpos(etiqueta, ' - ') > 0 then substr(etiqueta, strpos(etiqueta, ' - ') + 3) else etiqueta end as nombre_trabajador
        from ({_labels_sql()})""", "workers_enriched")
    out["incident_enrich"] = with_ctes("select * from facts", "facts")
    out["valid_incidents"] = with_ctes("select * from valid", "valid")
    out["night_rate"] = with_ctes("select incidencia_id, categoria, cod_reg_convenio, precio_nocturnidad from rated_facts",
                                  "rated_facts")
    out["distinct_rate_keys"] = with_ctes(f"""select k.categoria, k.cod_reg_convenio, coalesce(t.tarifa, 0.0) as precio_nocturnidad
        from (select distinct categoria, cod_reg_convenio from valid) k
        left join tariff_dim t on t.cat_key = {n3b('k.categoria')} and t.conv_key = {n2('k.cod_reg_convenio')}""",
                                          "valid", "tariff_dim")
    out["account_code"] = with_ctes("""select f.incidencia_id, f.motivo, coalesce(a.cuenta_codigo, 'Otros') as cuenta_codigo
        from facts f left join account_dim a on f.motivo = a.motivo""", "facts", "account_dim")
    out["export_costed"] = with_ctes(f"select {_EXPORT} from costed", "costed")
    out["account_split"] = with_ctes(f"""select incidencia_id, motivo as {q('Motivo')}, cuenta_codigo,
        case when cuenta_codigo = '73' then amount_ else 0.0 end as {q('73_plus_sustitucion')},
        case when cuenta_codigo = '72' then amount_ else 0.0 end as {q('72_incentivos')},
        case when cuenta_codigo = '70_71' then amount_ else 0.0 end as {q('70_71_festivos')} from costed""", "costed")
    out["row_cost"] = with_ctes(f"""select incidencia_id, precio_nocturnidad * nocturnidad_horas as {q('74_plus_nocturnidad')},
        (incidencia_horas * incidencia_precio + nocturnidad_horas * precio_nocturnidad) * cast({SS_FACTOR} as double)
          + traslados_total as {q('Coste_total')} from rated_valid""", "rated_valid")
    out["summary_by_scope"] = with_ctes(f"select {SCOPE}, n_validas, {_TOTALS} from scope_totals", "scope_totals")
    out["summary_totals"] = with_ctes(f"select n_validas, {_TOTALS} from ({_sums_of('rated_valid')})", "rated_valid")
    money = ", ".join(f"'€' || printf('%,.2f', printf('%.10f', {n})::decimal(38,10)::decimal(38,2)) as {n}" for n in TOTAL_NAMES)
    out["summary_formatted"] = with_ctes(f"select {SCOPE}, {money} from (select {SCOPE}, {_TOTALS} from scope_totals)", "scope_totals")
    edited = f"(select f.*, coalesce(t.tarifa, 0.0) as precio_nocturnidad from (select * from applied where {VALID}) f {_RATE_JOIN})"
    out["totals_after_edits"] = with_ctes(f"select {SCOPE}, n_validas, {_TOTALS} from ({_sums_of(_GATED.format(edited), SCOPE)})",
                                          "applied", "tariff_dim")
    out["incident_counts"] = with_ctes(f"""select {SCOPE}, count(*) as n_total, count_if({VALID}) as n_validas,
        count(*) - count_if({VALID}) as n_incompletas from facts group by {SCOPE}""", "facts")
    out["scopes_without_valid"] = with_ctes(f"""select {SCOPE}, count(*) as n_total, count_if({VALID}) as n_validas,
        count(*) > 0 and count_if({VALID}) = 0 as sin_validas from facts group by {SCOPE}""", "facts")
    out["invalid_reasons"] = with_ctes(f"""select p.session_jefe, p.imputacion_nomina, p.incidencia_id, p.posicion, p.problemas, c.n_mas
        from (select {SCOPE}, incidencia_id, seq as posicion, {_missing_sql()} as problemas from paged where seq <= 3) p
        join (select {SCOPE}, greatest(count(*) - 3, 0) as n_mas from facts group by {SCOPE}) c
        on p.session_jefe = c.session_jefe and p.imputacion_nomina = c.imputacion_nomina""", "paged", "facts")
    out["domain_violations"] = with_ctes(_violations_sql(), "v_")
    out["parse_fecha"] = with_ctes(f"""select incidencia_id, fecha, coalesce(
        cast(try_strptime({strip('fecha')}, '%d/%m/%Y') as date), cast(try_strptime({strip('fecha')}, '%d-%m-%Y') as date),
        cast(try_strptime({strip('fecha')}, '%d.%m.%Y') as date), cast(try_strptime({strip('fecha')}, '%Y-%m-%d') as date)) as fecha_dt
        from facts""", "facts")
    out["apply_edits"] = with_ctes("select * from applied", "applied")
    out["delete_marked"] = with_ctes("select f.* from facts f where incidencia_id not in "
                                     "(select incidencia_id from edits where borrar)", "facts", "edits")
    diffs = " or ".join(f"(n_{c} is distinct from {c})" for c in _EDITABLE)
    out["edit_change_flags"] = with_ctes(f"""select incidencia_id, borrar_ as borrar,
        n_trabajador <> '' and n_trabajador <> trabajador as cambia_trabajador,
        borrar_ or {diffs} or (n_trabajador <> '' and n_trabajador <> trabajador) as cambiado from edited""", "edited")
    def shown(name: str, src: str) -> str:
        if name in VIEW_TEXT:
            return view_text(src)
        if name in VIEW_NUMBERS:
            return z(src)
        return src

    view_cols = [(name, shown(name, src)) for name, src in VIEW_FIELDS]
    hidden = set(EDIT_HIDDEN)
    view = ", ".join(f"{expr} as {q(name)}" for name, expr in view_cols)
    edit = ", ".join(f"{expr} as {q(name)}" for name, expr in view_cols if name not in hidden)
    out["working_view"] = with_ctes(f"select incidencia_id, {SCOPE}, false as {q('Borrar')}, {view} from rated_facts",
                                    "rated_facts")
    out["edit_view"] = with_ctes(f"select incidencia_id, {SCOPE}, false as {q('Borrar')}, {edit} from rated_facts",
                                 "rated_facts")
    out["paged_incidents"] = with_ctes("select * from paged", "paged")
    out["page_slice"] = with_ctes(f"""select * exclude (pagina) from paged where session_jefe = 'SUP1'
        and imputacion_nomina = {lit(MONTHS[2])} and seq between {ROWS_PER_PAGE + 1} and {2 * ROWS_PER_PAGE}""", "paged")
    out["page_counts"] = with_ctes(f"""select {SCOPE}, n_filas, n_paginas, least(30, n_paginas) as pagina_actual from
        (select {SCOPE}, count(*) as n_filas, cast(greatest(1, ceil(count(*) / {ROWS_PER_PAGE})) as bigint) as n_paginas
         from facts group by {SCOPE})""", "facts")
    out["page_fingerprint"] = with_ctes(f"""select {SCOPE}, pagina, md5(string_agg(
          concat_ws('|', coalesce(trabajador, 'None'), coalesce(motivo, 'None'), coalesce(fecha, 'None'),
                    coalesce(cast(incidencia_horas as varchar), 'None'), coalesce(cast(incidencia_precio as varchar), 'None')),
          '||' order by seq)) as huella from paged group by {SCOPE}, pagina""", "paged")
    out["clear_scope"] = with_ctes(f"""select * from facts where not coalesce(session_jefe = 'SUP0'
        and imputacion_nomina = {lit(MONTHS[0])}, false)""", "facts")
    rejected = """select request_id, motivo_rechazo from (select request_id,
  case when coalesce(kind, '') not in ('centro', 'trabajador') then 'tipo_desconocido'
       when kind = 'centro' and coalesce(centro_origen, '') = '' then 'sin_centro_origen'
       when kind = 'trabajador' and coalesce(name_, '') = '' then 'sin_trabajador'
       when len(destinos) = 0 then 'sin_destino'
       when kind = 'trabajador' and len(destinos) > 10 then 'demasiados_destinos' end as motivo_rechazo from {})
where motivo_rechazo is not null"""
    out["intake_rejected"] = with_ctes(rejected.format("req"), "req")
    eleven = ",".join(f"D{n}" for n in range(11))
    odd = f"""(select request_id, session_jefe, imputacion_nomina, num_rows,
      case when request_id % 7 = 1 then 'otro' when request_id % 7 = 2 then null else kind end as kind,
      case when request_id % 5 <> 0 then centro_origen end as centro_origen,
      case when request_id % 11 = 0 then '' else trabajador end as trabajador,
      case when request_id % 13 = 0 then ',' when request_id % 13 = 1 then '{eleven}' else destinos_csv end as destinos_csv from requests)"""
    out["intake_rules"] = with_ctes(rejected.format("(" + CTES["req"][0].replace("from requests)", f"from {odd})") + ")"), "requests")
    bad = {"observaciones": (1, "''"), "facturable": (3, "'Quizá'"), "motivo": (4, "'Huelga'"), "empresa_destino": (5, "'E9'"),
           "imputacion_nomina": (6, "'13-Mes'"), "trabajador": (7, "'NADIE'"), "codigo_crown_destino": (7, "'X'")}
    bad |= {c: (2, f"-{c} - 1") for c in ("incidencia_horas", "incidencia_precio", "nocturnidad_horas", "traslados_total")}
    odd = ", ".join(f"case when traslados_total = {n} then {v} else {c} end as {c}" for c, (n, v) in bad.items())
    odd = f"(select * replace ({odd}) from facts)"
    out["domain_rules"] = with_ctes(_violations_sql("(" + CTES["v_"][0].replace("from applied a", f"from {odd} a") + ")"), "facts", "worker_dim", "centros_clean")
    for key, src in (("intake_by_centre", "enriched_new_by_centre"), ("intake_by_worker", "enriched_new_by_worker"),
                     ("intake_replicate", "enriched_new_replicate")):
        out[key] = with_ctes(f"select {FACTS} from {src}", src)
    out["append_intake"] = with_ctes(f"""select {FACTS}, seq from paged
        union all
        select {', '.join('n.' + c for c in FACT_COLUMNS)}, coalesce(c.n_, 0) + row_number() over (partition by n.session_jefe, n.imputacion_nomina
               order by n.request_id, n.orden_) as seq
        from (select * from enriched_new_by_centre union all select * from enriched_new_by_worker) n
        left join (select {SCOPE}, count(*) as n_ from facts group by {SCOPE}) c
          on n.session_jefe = c.session_jefe and n.imputacion_nomina = c.imputacion_nomina""",
                                     "paged", "enriched_new_by_centre", "enriched_new_by_worker", "facts")
    out["export_names"] = with_ctes(f"""select {SCOPE}, 'incidencias_' || replace(session_jefe, ' ', '_')
        || '_20250131_120000.parquet' as nombre_fichero from
        (select {SCOPE}, count_if({VALID}) as n_validas from facts group by {SCOPE}) where n_validas > 0""", "facts")
    out["header_normalize"] = with_ctes("select * from trabajadores", "trabajadores")
    numbered = f"row_number() over (partition by {SCOPE} order by incidencia_id) as seq"
    out["stored_edits"] = with_ctes(f"select *, {numbered} from applied", "applied")
    out["stored_clear"] = with_ctes(f"""select {FACTS}, seq from paged where not coalesce(session_jefe = 'SUP0'
        and imputacion_nomina = {lit(MONTHS[0])}, false)""", "paged")
    out["stored_append"], out["stored_page"] = out["append_intake"], out["page_slice"]
    text = """concat_ws('|', coalesce(trabajador, 'None'), coalesce(motivo, 'None'), coalesce(fecha, 'None'),
        coalesce(cast(incidencia_horas as varchar), 'None'), coalesce(cast(incidencia_precio as varchar), 'None'))"""

    def manifest(rows: str) -> str:
        return f"""select session_jefe || '/' || imputacion_nomina as path, count(*) as length,
          sum(('0x' || substr(md5(incidencia_id || '|' || {text}), 1, 14))::bigint)::varchar as md5 from {rows} group by {SCOPE}"""

    def states(now: str, last: str, keys: tuple[str, ...], digest: str) -> str:
        same = " and ".join(f"n.{k} is not distinct from l.{k}" for k in keys)
        return f"""n.{digest}, case when n.{digest} is null then 'removed' when l.{digest} is null then 'new'
            when n.{digest} = l.{digest} then 'unchanged' else 'changed' end as estado from {now} n full join {last} l on {same}"""

    now = f"""({manifest(f"(select * from applied where session_jefe <> 'SUP4' and imputacion_nomina <> {lit(MONTHS[3])})")}
        union all {manifest(f"(select * from facts where imputacion_nomina = {lit(MONTHS[3])})")})"""
    last = f"({manifest(f'(select * from facts where imputacion_nomina <> {lit(MONTHS[1])})')})"
    out["manifest_states"] = with_ctes(f"select coalesce(n.path, l.path) as path, n.length, {states(now, last, ('path',), 'md5')}", "facts", "applied")

    def pages(rows: str) -> str:
        numbers = CTES["paged"][0].replace("from facts", f"from {rows}")
        return f"(select {SCOPE}, pagina, md5(string_agg({text}, '||' order by seq)) as huella from ({numbers}) group by {SCOPE}, pagina)"

    page = (*SCOPE.split(", "), "pagina")
    both = ", ".join(f"coalesce(n.{k}, l.{k}) as {k}" for k in page)
    out["page_changes"] = with_ctes(f"select * from (select {both}, {states(pages('applied'), pages('facts'), page, 'huella')}) where estado <> 'unchanged'", "applied", "facts")
    where = " and ".join(f"a.{k} = c.{k}" for k in page)
    priced = f"""(select f.*, coalesce(t.tarifa, 0.0) as precio_nocturnidad from (select a.* from ({CTES['paged'][0].replace('from facts', 'from applied')}) a
        join (select * from (select {both}, {states(pages('applied'), pages('facts'), page, 'huella')}) where estado in ('new', 'changed')) c on {where}
        where {VALID}) f {_RATE_JOIN})"""
    out["repriced_pages"] = with_ctes(f"select pagina, {_EXPORT} from ({CTES['costed'][0].replace('from rated_valid f', f'from {priced} f')})",
                                      "applied", "facts", "tariff_dim", "account_dim", "worker_dim")
    names = ["nombre_empleado", "centro_preferente", "cat_empleado", "cod_reg_convenio", "coste_hora", "cod_empresa"]
    line = " || ',' || ".join("'n/a'" if c == "coste_hora" else f"coalesce({c}, '')" for c in names)
    out["bad_input"] = with_ctes(f"""
        select 'buena' as estado, nombre_empleado, cat_empleado, coste_hora, null::varchar as registro from trabajadores where row_idx % 50 > 1
        union all select 'rechazada', null, null, null, case when row_idx % 50 = 0 then nombre_empleado || ',roto' else {line} end
        from trabajadores where row_idx % 50 < 2""", "trabajadores")
    return out
