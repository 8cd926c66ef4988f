"""Canonical text of a cell: what `int()` accepts becomes integer text, all else its string form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmatch.functions.text import dedupe_names

# Blanks around a number; unlike in names the ASCII separators are not among them.
_NUMBER_SPACE = r"(?U)^\s+|\s+\z"
# Python refuses to read integers of more digits than this.
_MAX_INT_DIGITS = 4300


def _int_text(c: Column) -> Column:
    s = F.regexp_replace(c, _NUMBER_SPACE, "")
    digits = F.regexp_replace(s, "[+_-]", "")
    magnitude = F.regexp_replace(digits, "^0+(?=.)", "")
    signed = F.when(F.startswith(s, F.lit("-")) & (magnitude != "0"), F.concat(F.lit("-"), magnitude)).otherwise(
        magnitude
    )
    is_int = s.rlike("^[+-]?[0-9]+(_[0-9]+)*$") & (F.length(digits) <= _MAX_INT_DIGITS)
    return F.when(is_int, signed).otherwise(c)


def _large_text(c: Column) -> Column:
    """All digits of a finite float of 2**62 or more: an integer of at most 56 bits times a power of two, in limbs of
    nine digits, lowest first."""
    div = lambda a, b: F.call_function("div", a, b)
    base, none = F.lit(10**9).cast("bigint"), F.array().cast("array<bigint>")
    shift = (F.floor(F.log2(F.abs(c))) - 54).cast("int")
    start = F.abs(c) / F.pow(F.lit(2.0), shift)
    start = start.cast("bigint")

    def doubled(limbs: Column, step: Column) -> Column:
        times = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(F.lit(29), shift - 29 * step).cast("int"))
        return F.aggregate(
            limbs,
            F.struct(F.lit(0).cast("bigint").alias("carry"), none.alias("out")),
            lambda s, d: F.struct(
                div(d * times + s["carry"], base).alias("carry"),
                F.concat(s["out"], F.array((d * times + s["carry"]) % base)).alias("out"),
            ),
            lambda s: F.concat(s["out"], F.array(s["carry"])),
        )

    steps = F.sequence(F.lit(0), F.ceil(shift / 29).cast("int") - 1)
    limbs = F.aggregate(steps, F.array(start % base, div(start, base)), doubled)
    digits = F.array_join(F.transform(F.reverse(limbs), lambda d: F.lpad(d.cast("string"), 9, "0")), "")
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.regexp_replace(digits, "^0+", ""))


def _float_text(c: Column) -> Column:
    c = c.cast("double")
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    return (
        F.when(F.isnan(c), F.lit("nan"))
        .when(F.abs(c) < F.lit(9.0e18), whole.cast("string"))
        .when(F.abs(c) == F.lit(float("inf")), F.lit(None).cast("string"))
        .when(F.abs(c) >= F.lit(9.0e18), _large_text(c))
    )


def _time_text(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def normalise_int(c: Column, dtype: T.DataType | None = None, numeric: str = "truncate") -> Column:
    """Canonical text of a cell of type `dtype` (text by default). Floats lose their fraction unless
    `numeric="exact"`; an infinite float has no integer form and gives null (see `bad_number`)."""
    dtype = dtype or T.StringType()
    if isinstance(dtype, T.StringType):
        return _int_text(c)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("string")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("string") if numeric == "exact" else _float_text(c)
    if isinstance(dtype, T.DecimalType):
        whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
        return (c if numeric == "exact" else whole).cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return _time_text(c)
    if isinstance(dtype, T.DateType):
        return _time_text(c.cast("timestamp"))
    return c.cast("string")


def bad_number(c: Column, dtype: T.DataType) -> Column:
    """True where a cell cannot be normalised at all: an infinite float."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.coalesce(F.abs(c.cast("double")) == F.lit(float("inf")), F.lit(False))
    return F.lit(False)


def cell_text(c: Column, dtype: T.DataType, is_name: bool, numeric: str = "truncate") -> Column:
    """Stored text of a cell: name lists are de-duplicated, other cells normalised, nulls become ''."""
    text = dedupe_names(c.cast("string")) if is_name else normalise_int(c, dtype, numeric)
    return F.coalesce(text, F.lit(""))
