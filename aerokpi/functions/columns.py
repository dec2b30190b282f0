"""Column-level building blocks.

Each function maps Columns to a Column and stays inside whole-stage codegen.
ANSI mode is on in Spark 4, so every division is guarded (``ratio``) and
every parse is a ``try_`` variant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerokpi.params import CHANNEL_SYNONYMS, SEGMENT_ARROW, WEEKDAYS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Fixed value: the ASCII whitespace set stripped from both ends of a text.
WHITESPACE = " \t\n\x0b\x0c\r"


def strip_ws(x) -> Column:
    """Remove leading/trailing whitespace of any kind (not only blanks)."""
    return F.trim(_c(x), F.lit(WHITESPACE))


def booking_id_norm(x) -> Column:
    """Digits of a booking id as a string; empty or null gives null."""
    digits = F.regexp_replace(_c(x).cast("string"), "[^0-9]+", "")
    return F.nullif(digits, F.lit(""))


def has_booking_id(x) -> Column:
    """Whether ``booking_id_norm`` gives an id: there is a digit."""
    return _c(x).cast("string").rlike("[0-9]")


def channel_norm(x, synonyms: dict | None = None) -> Column:
    """Trim, lower-case, then map channel synonyms; unknown values pass through."""
    syn = synonyms if synonyms is not None else CHANNEL_SYNONYMS
    key = F.lower(strip_ws(_c(x)))
    mapping = F.create_map(*[F.lit(v) for kv in syn.items() for v in kv])
    return F.coalesce(F.element_at(mapping, key), key)


def device_norm(x) -> Column:
    return F.lower(strip_ws(_c(x)))


def canon_code(x) -> Column:
    """Airport / O&D code in canonical form: trimmed upper case."""
    return F.upper(strip_ws(_c(x)))


def routing_key(x) -> Column:
    """Upper case with every blank removed (routing consistency check)."""
    return F.replace(F.upper(_c(x)), F.lit(" "), F.lit(""))


def segment_label(origin="origin", destination="destination", sep: str = SEGMENT_ARROW) -> Column:
    return F.concat(_c(origin), F.lit(sep), _c(destination))


def weekday_name(d) -> Column:
    """Full English weekday name of a date or timestamp (Monday ... Sunday).

    ``dayofweek`` counts from Sunday = 1; a lookup in a literal array is
    cheaper than a date formatter and independent of any locale.
    """
    sunday_first = WEEKDAYS[-1:] + WEEKDAYS[:-1]
    k = F.dayofweek(_c(d))
    # guarded: element_at with a null index does not yield null everywhere
    return F.when(k.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in sunday_first]), k))


def whole_days(end, start, dates: bool = False) -> Column:
    """Whole days from ``start`` to ``end``, floored (-2.5 days gives -3).

    With ``dates=True`` (both inputs DATE) this is a plain day difference.
    Otherwise DATE and TIMESTAMP_NTZ inputs are widened to TIMESTAMP_NTZ,
    which carries no time zone, so the result never depends on the
    session zone.
    """
    if dates:
        return F.datediff(_c(end), _c(start)).cast("bigint")
    secs = F.timestamp_diff("SECOND", _c(start).cast("timestamp_ntz"), _c(end).cast("timestamp_ntz"))
    return F.floor(secs / F.lit(86400)).cast("bigint")


def ratio(num, den) -> Column:
    """num / den as DOUBLE, null when den is null or zero (never raises)."""
    return F.try_divide(_c(num).cast("double"), F.nullif(_c(den).cast("double"), F.lit(0.0)))
