"""Fixed values and tunable defaults.

The values in the "fixed values" block must equal the behaviour being
reproduced (labels, domains, factors); they are stated here once, in natural
order, and imported everywhere else.
"""

# ---------------------------------------------------------------------------
# Fixed values (must match the reproduced behaviour exactly)
# ---------------------------------------------------------------------------

# Employer social-security uplift applied to incident and night costs.
SS_FACTOR = 1.3195

# Rows per page of the incident table.
ROWS_PER_PAGE = 50

# Largest number of destinations a single by-worker request may carry.
MAX_DESTINATIONS = 10

# Payroll month labels, January to December.
MONTHS = (
    "01-Enero", "02-Febrero", "03-Marzo", "04-Abril", "05-Mayo", "06-Junio",
    "07-Julio", "08-Agosto", "09-Septiembre", "10-Octubre", "11-Noviembre",
    "12-Diciembre",
)

# Allowed values of the "Facturable" field.
FACTURABLE_VALUES = ("", "Sí", "No")

# Allowed incident reasons.
MOTIVO_VALUES = (
    "Absentismo", "Refuerzo", "Eventos", "Festivos y Fines de Semana",
    "Permiso retribuido", "Puesto pendiente de cubrir", "Formación", "Otros",
    "Nocturnidad",
)

# Service derived from the worker category when the table has no service.
SERVICE_CLEANING = "020 Limpieza"
SERVICE_CATERING = "010 Restauración"
SERVICE_CLEANING_PATTERN = "limp|asl"

# Account code assigned when a reason has no mapped account.
DEFAULT_ACCOUNT = "Otros"

# Text used for a missing description inside display labels.
MISSING_TEXT = "nan"

# Labels of the missing-field diagnosis, in the order they are checked.
MISSING_FIELD_LABELS = (
    ("trabajador", "Falta Trabajador"),
    ("imputacion_nomina", "Falta Imputación"),
    ("facturable", "Falta Facturable"),
    ("motivo", "Falta Motivo"),
    ("codigo_crown_destino", "Falta Crown Destino"),
    ("fecha", "Falta Fecha"),
)

# Fields that must be non-blank for an incident to be exported.
REQUIRED_FIELDS = ("trabajador", "facturable", "motivo", "codigo_crown_destino", "fecha")

# Export file name pattern pieces.
EXPORT_PREFIX = "incidencias_"
EXPORT_TS_FORMAT = "yyyyMMdd_HHmmss"
EXPORT_TS_FORMAT_PY = "%Y%m%d_%H%M%S"

# Accepted spellings of the worker-name header (lower-cased, trimmed).
NAME_ALIASES = ("nombre_empleado", "nombre empleado", "nombre")

# Worker attributes and their defaults when missing, null or blank.
WORKER_DEFAULTS = (
    ("servicio", ""), ("cat_empleado", ""), ("cod_crown", ""), ("centro_preferente", ""),
    ("nombre_centro_preferente", ""), ("nombre_jefe_ope", ""), ("coste_hora", 0.0),
    ("cod_reg_convenio", ""), ("porcen_contrato", ""), ("cod_empresa", ""),
)

# Exported columns (export name, fact field), in export order.
EXPORT_FIELDS = (
    ("Jefe de Operaciones", "nombre_jefe_ope"), ("Mes imputació nómina", "imputacion_nomina"),
    ("Facturable", "facturable"), ("Servicio", "servicio"), ("Motivo", "motivo"),
    ("Trabajador", "trabajador"), ("Empresa Destino", "empresa_destino"),
    ("Código Crown Destino", "codigo_crown_destino"), ("Centro Destino", "nombre_crown_destino"),
    ("Categoria", "categoria"), ("Cuantía", "incidencia_horas"), ("Precio", "incidencia_precio"),
    ("Cuantía nocturnidad", "nocturnidad_horas"), ("Precio_nocturnidad", "precio_nocturnidad"),
    ("Horas traslado", "traslados_total"), ("coste_hora", "coste_hora"),
    ("Empresa Origen", "centro_preferente"), ("Código Crown Origen", "codigo_crown_origen"),
    ("Fecha", "fecha"), ("Observaciones", "observaciones"), ("cod_reg_convenio", "cod_reg_convenio"),
    ("porcen_contrato", "porcen_contrato"), ("cod_empresa", "cod_empresa"),
    ("nombre_centro", "nombre_centro"),
)

# Account split columns (column, account code), then the night and total columns.
ACCOUNT_COLUMNS = (("73_plus_sustitucion", "73"), ("72_incentivos", "72"), ("70_71_festivos", "70_71"))
NIGHT_COLUMN = "74_plus_nocturnidad"
TOTAL_COLUMN = "Coste_total"

# Working-view columns (view name, fact field) after "Borrar", in view order.
VIEW_FIELDS = (
    ("Trabajador", "trabajador"), ("Facturable", "facturable"), ("Motivo", "motivo"),
    ("Código Crown Origen", "codigo_crown_origen"), ("Código Crown Destino", "codigo_crown_destino"),
    ("Empresa Destino", "empresa_destino"), ("Incidencia_horas", "incidencia_horas"),
    ("Incidencia_precio", "incidencia_precio"), ("Nocturnidad_horas", "nocturnidad_horas"),
    ("Precio_nocturnidad", "precio_nocturnidad"), ("Traslados_total", "traslados_total"),
    ("Coste hora empresa", "coste_hora"), ("Fecha", "fecha"), ("Observaciones", "observaciones"),
    ("Centro preferente", "centro_preferente"), ("Supervisor de operaciones", "nombre_jefe_ope"),
    ("Categoría", "categoria"), ("Servicio", "servicio"), ("Cod_reg_convenio", "cod_reg_convenio"),
    ("Nombre Crown Destino", "nombre_crown_destino"),
)
# View columns shown as text (null/'nan'/'None' as blank) and as numbers.
VIEW_TEXT = ("Código Crown Origen", "Código Crown Destino", "Centro preferente", "Fecha", "Observaciones")
VIEW_NUMBERS = ("Incidencia_horas", "Incidencia_precio", "Nocturnidad_horas", "Precio_nocturnidad",
                "Traslados_total", "Coste hora empresa")
# View columns hidden in the editable view.
EDIT_HIDDEN = ("Cod_reg_convenio", "Categoría", "Centro preferente", "Coste hora empresa",
               "Supervisor de operaciones", "Servicio", "Nombre Crown Destino")

# ---------------------------------------------------------------------------
# Tunable defaults (parameters, not behaviour)
# ---------------------------------------------------------------------------

# A dimension is broadcast only when its counted size is at most this many
# rows; above it the join shuffles (sort-merge, AQE skew split).
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_ROWS_CONF = "covercost.broadcast.maxRows"

# Rows of a slice when a large group is numbered (some tens of megabytes of
# incidents), how many rows' keys are splitters at most, all groups together
# (a few megabytes), and the branching of the two levels they are looked up in.
SLICE_ROWS = 262_144
MOST_SPLITTERS = 65_536
FANOUT = 128
# Copies of one request that a task makes at a time.
RANGE_ROWS = 10_000
# Bytes of input files behind the incidents that are taken at a time (some ten
# million incidents), ranges whose incidents are staged together, and kept
# incidents of the sessions that are edited together.
DEFAULT_PASS_BYTES = 256 << 20
PASS_BYTES_CONF = "covercost.pass.bytes"
RANGES_STAGED = 3
EDITED_ROWS = 8_000_000
EDITED_ROWS_CONF = "covercost.edited.rows"
