"""Text forms used when tables are shown, and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with milliseconds and Z; the session time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def truncate(c: Column, width: int = 50) -> Column:
    """Text over `width` characters is cut there and marked with dots."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def blank_falsy(c: Column, dtype: T.DataType | None = None) -> Column:
    """Null, '', zero, NaN and false show as empty. Canonical text '0' counts as zero."""
    text = c.cast("string")
    empty = c.isNull()
    if isinstance(dtype, T.BooleanType):
        empty = empty | ~c
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        empty = empty | F.isnan(c) | (c == 0)
    elif isinstance(dtype, T.NumericType):
        empty = empty | (c == 0)
    else:
        empty = empty | (text == "0")
    return F.when(empty, F.lit("")).otherwise(text)


def score_text(score: Column, digits: int = 2) -> Column:
    """A score below 1e15 with so many decimals, from its exact binary value: what lies half way goes up, in magnitude.

    The fraction times a power of ten is rounded in floating point; the sign of the exact remainder, from halves of
    the fraction that multiply without loss, tells whether that was one too many or too few."""
    power = float(10**digits)
    size = F.abs(score)
    whole = F.floor(size)
    fraction = size - whole
    scaled = F.floor(fraction * power + 0.5)
    head = F.lit(134217729.0) * fraction
    head = head - (head - fraction)
    left = (head * power - (scaled - 0.5)) + (fraction - head) * power  # exact part above the rounding border
    scaled = scaled + F.when(left < 0, -1).when(left >= 1, 1).otherwise(0)
    number = whole.cast("bigint") + F.when(scaled >= power, 1).otherwise(0)
    rest = F.lpad(F.pmod(scaled.cast("bigint"), F.lit(10**digits)).cast("string"), digits, "0")
    shown = F.concat(number.cast("string"), F.lit("."), rest) if digits else number.cast("string")
    return F.concat(F.when(score < 0, F.lit("-")).otherwise(F.lit("")), shown)


def row_id(*parts: Column) -> Column:
    """Stable identifier: the SHA-256 of its parts. Each part is prefixed with its length, and a null part has a frame of its own,
    so no two lists of parts read alike."""
    framed = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-:")) for p in parts]
    return F.sha2(F.concat_ws("", *framed), 256)
