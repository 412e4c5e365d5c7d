"""Scalar cleaning and classification rules as Column expressions.

Each function maps Column -> Column and stays inside whole-stage codegen
(no Python UDF).  Text-to-number parsing follows Python's ``float()``
grammar, which is stricter than Spark's cast (Spark accepts ``5d``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from covercost.constants import (DEFAULT_ACCOUNT, MISSING_TEXT, SERVICE_CATERING,
                                 SERVICE_CLEANING, SERVICE_CLEANING_PATTERN)

# Whitespace removed by Python's str.strip(), as code points.
_WS_POINTS = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WS_CHARS = "".join(map(chr, _WS_POINTS))
_DIGITS = r"\d(?:_?\d)*"
# Python float() literal (used only for text containing underscores).
_PY_FLOAT = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def py_float(c) -> Column:
    """Parse text the way Python's ``float()`` does; null where it raises.

    Spark's cast is used directly, except for forms only Java accepts (hex,
    ``d``/``f`` type suffixes, which Python rejects) and for digit
    underscores (which Python accepts and Spark does not).
    """
    return _stripped_float(strip_ws(col(c).cast("string")))


def _stripped_float(s: Column) -> Column:
    low = F.lower(s)
    java_only = (low.contains("x") | low.endswith("d")
                 | (low.endswith("f") & ~low.isin("inf", "+inf", "-inf")))
    underscored = F.when(s.rlike(_PY_FLOAT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(s.contains("_"), underscored).when(~java_only, s.try_cast("double"))


def py_int_text(c) -> Column:
    """``str(int(float(x)))``: text of the truncated number, null if it raises."""
    return py_float(c).try_cast("bigint").cast("string")


def code_like(c) -> Column:
    """Only digits, dots and minus signs, with at least one digit."""
    c = col(c)
    return (F.translate(c, "0123456789.-", "") == "") & (F.translate(c, ".-", "") != "")


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def centre_code(c) -> Column:
    """Centre code: numeric-looking text becomes the text of its integer part.

    ``101.0`` -> ``101``, ``101.5`` -> ``101``, ``007`` -> ``7``; text that is
    not a number (``X7``, ``9.9E+13``, ``1-2``) is kept; null stays null.
    """
    c = col(c)
    as_int = py_int_text(c)
    return F.when(code_like(c) & as_int.isNotNull(), as_int).otherwise(c)


def agreement_code(c) -> Column:
    """Labour-agreement code: integer text of the number, else trimmed text, null -> ''."""
    return agreement_of(strip_ws(col(c)))


def agreement_of(stripped) -> Column:
    """``agreement_code`` of a text column without whitespace around it, which is used often: best a column of its own."""
    s = col(stripped)
    return F.coalesce(_stripped_float(s.cast("string")).try_cast("bigint").cast("string"), s, F.lit(""))


def rate_category(c) -> Column:
    """Category key on the rate side: text of the value trimmed, upper case; null -> 'NAN'."""
    return F.upper(strip_ws(F.coalesce(col(c), F.lit(MISSING_TEXT))))


def incident_category(c) -> Column:
    """Category key on the incident side: trimmed upper text, one-letter first word dropped.

    Only the first space splits: ``H  ASL`` keeps a leading space.
    """
    x = F.upper(strip_ws(F.coalesce(col(c), F.lit(""))))
    return F.regexp_replace(x, r"(?s)\A. ", "")


def service_for(category) -> Column:
    """Service from the category text (cleaning vs catering)."""
    hit = F.coalesce(col(category).rlike(f"(?i){SERVICE_CLEANING_PATTERN}"), F.lit(False))
    return F.when(hit, F.lit(SERVICE_CLEANING)).otherwise(F.lit(SERVICE_CATERING))


def blank_if_null(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def is_blank(c) -> Column:
    return F.coalesce(col(c), F.lit("")) == ""


def view_text(c) -> Column:
    """Text shown in the working view: null, 'nan' and 'None' become ''."""
    c = col(c)
    return F.when(c.isNull() | c.isin(MISSING_TEXT, "None"), F.lit("")).otherwise(c)


def view_number(c) -> Column:
    """Number shown in the working view (text input): bad, null or NaN become 0."""
    return F.coalesce(nan_to_null(py_float(c)), F.lit(0.0))


def view_double(c) -> Column:
    """Number shown in the working view (double input): null or NaN become 0."""
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def edit_number(c) -> Column:
    """Edited number: null, blank or unparsable -> 0.0 (text 'nan' parses to NaN)."""
    return F.coalesce(py_float(c), F.lit(0.0))


def edit_code(c) -> Column:
    """Edited centre code: null/''/'nan'/'None' -> ''; else every '.0' removed, trimmed."""
    c = col(c).cast("string")
    return (F.when(c.isNull() | c.isin("", MISSING_TEXT, "None"), F.lit(""))
            .otherwise(strip_ws(F.replace(c, F.lit(".0"), F.lit("")))))


def edit_date(c) -> Column:
    """Edited date text: null -> '', else trimmed."""
    return F.coalesce(strip_ws(col(c).cast("string")), F.lit(""))


def edit_text(c) -> Column:
    """Edited text: null or 'nan'/'none'/'' in any case -> ''; else trimmed."""
    c = col(c).cast("string")
    return F.when(c.isNull() | F.lower(c).isin(MISSING_TEXT, "none", ""), F.lit("")).otherwise(strip_ws(c))


def account_code(desc) -> Column:
    """Payroll account from its description; order matters, null when unmapped."""
    d = F.coalesce(col(desc).cast("string"), F.lit(""))
    return (F.when(d.contains("70/71"), F.lit("70_71"))
            .when(d.startswith("73"), F.lit("73"))
            .when(d.startswith("72"), F.lit("72"))
            .when(d.startswith("74"), F.lit("74")))


def account_or_default(code) -> Column:
    return F.coalesce(col(code), F.lit(DEFAULT_ACCOUNT))


def parse_fecha(c) -> Column:
    """Free-text date to DATE: day-first forms, then ISO; unparsable -> null."""
    s = strip_ws(col(c))
    fmts = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in fmts])


def money(c) -> Column:
    """Money text with thousands separators, e.g. ``€1,234.50``.

    The amount is rounded in DECIMAL first so that half-way cases do not
    depend on binary floating point.
    """
    return F.concat(F.lit("€"), F.format_number(col(c).cast("decimal(38,2)"), 2))


def split_label(c):
    """Split ``'code - name'`` at the first ``' - '``; no separator -> ('', text)."""
    parts = F.split(col(c), " - ", 2)
    has = F.size(parts) == 2
    return (F.when(has, parts.getItem(0)).otherwise(F.lit("")),
            F.when(has, parts.getItem(1)).otherwise(col(c)))
