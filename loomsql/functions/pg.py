"""The dialect's scalar functions as Column expressions, for use without query text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of EXTRACT and how Spark gives them.
_FIELDS = {
    "isodow": lambda t: F.extract(F.lit("dayofweek_iso"), t), "isoyear": lambda t: F.extract(F.lit("yearofweek"), t), "dow": lambda t: F.dayofweek(t) - 1, "doy": F.dayofyear,
    "microseconds": lambda t: F.extract(F.lit("second"), t) * 1_000_000, "milliseconds": lambda t: F.extract(F.lit("second"), t) * 1000,
    "decade": lambda t: F.floor(F.year(t) / 10), "century": lambda t: F.ceil(F.year(t) / 100), "millennium": lambda t: F.ceil(F.year(t) / 1000),
}


def extract(field: str, t: Column) -> Column:
    """EXTRACT(field FROM t) of a date or timestamp."""
    known = _FIELDS.get(field.lower())
    return known(t) if known else F.extract(F.lit(field.lower()), t)


def substring(s: Column, start: Column | None = None, length: Column | None = None) -> Column:
    """SUBSTRING(s FROM start FOR length): positions below 1 use up length; null if any argument is."""
    start = F.lit(1) if start is None else start
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.when(start.isNotNull(), F.substring(s, first, F.length(s)))
    n = F.greatest(F.least(start + length, F.length(s) + 1) - first, F.lit(0))
    return F.when(start.isNotNull() & length.isNotNull(), F.substring(s, first, n))


def position(what: Column, within: Column) -> Column:
    return F.position(what, within)


def int_div(a: Column, b: Column) -> Column:
    """Division of whole numbers toward zero, as a bigint."""
    return F.call_function("div", a, b).cast("bigint")


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def date_plus_interval(d: Column, interval: Column) -> Column:
    """A timestamp, even for whole days."""
    return d.cast("timestamp_ntz") + interval


def round_cast(x: Column, type_: str) -> Column:
    """CAST to a whole number that rounds instead of cutting off: halves to even for doubles, away from zero for decimals."""
    return F.when(F.typeof(x).startswith("decimal"), F.round(x).cast(type_)).otherwise(F.rint(x).cast(type_))


def default_nulls(c: Column, ascending: bool = True) -> Column:
    """The sort order with nulls as the largest values."""
    return c.asc_nulls_last() if ascending else c.desc_nulls_first()
