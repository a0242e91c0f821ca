"""Column helpers. All are built-in Spark expressions, so they stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific number, optionally signed and padded. Text such as
# "nan", "1d" or "N/A" is not a number here (pandas treats it as missing, while a bare
# cast would accept the first two).
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: Column | str) -> Column:
    """Coerce text to DOUBLE; text that is not a plain number (``nan``, ``1d``, ``N/A``) → NULL.

    The pattern admits digits, sign, point and exponent only, so the result is never NaN.
    """
    as_text = _c(c).cast("string")
    return F.when(as_text.rlike(NUMBER_PATTERN), F.trim(as_text).try_cast("double"))


def numeric_from(c: Column | str, dtype) -> Column:
    """Like :func:`numeric` but skips the text round trip for columns that are numeric already."""
    from pyspark.sql import types as T
    col = _c(c)
    if isinstance(dtype, T.NumericType) and not isinstance(dtype, T.DecimalType):
        d = col.cast("double")
        return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)
    if isinstance(dtype, (T.DecimalType, T.BooleanType)):
        return col.cast("double")
    if isinstance(dtype, T.StringType):
        return numeric(col)
    return F.lit(None).cast("double")


def stooq_timestamp(date: Column | str, time: Column | str | None = None) -> Column:
    """``<DATE>`` (YYYYMMDD) joined with ``<TIME>`` zero-filled to six digits.

    Unparsable values give NULL. A time longer than six digits is kept whole (it then
    fails to parse) rather than cut, as zero-filling never shortens text.
    """
    d = F.trim(_c(date).cast("string"))
    if time is None:
        t = F.lit("000000")
    else:
        t_raw = F.trim(_c(time).cast("string"))
        t = F.when(F.length(t_raw) >= 6, t_raw).otherwise(F.lpad(t_raw, 6, "0"))
    text = F.concat(d, t)
    ts = F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))
    return F.when(F.length(text) == 14, ts).cast("timestamp_ntz")


def base_name(path: Column | str) -> Column:
    """Last path element."""
    return F.element_at(F.split(_c(path), "/"), -1)


def parent_dir(path: Column | str) -> Column:
    """Everything before the last ``/``."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def file_stem(path: Column | str) -> Column:
    """Base name up to the first dot (the ticker of a Stooq file)."""
    return F.split(base_name(path), r"\.").getItem(0)


def file_extension(path: Column | str) -> Column:
    """Lower-case extension with its dot, or empty text."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def round6(c: Column | str) -> Column:
    return F.round(_c(c), 6)


NUDGE = 5e-9


def rounded(c: Column | str, places: int = 6) -> Column:
    """Round for comparison with an oracle: ties nudged the same way on both sides."""
    return F.round(_c(c) + F.lit(NUDGE), places) + F.lit(0.0)


def rounded_many(c: Column | str, places: int = 6) -> Column:
    """:func:`rounded` for a plain column of very many rows: the same values, with decimal arithmetic only for the few near a tie, the large and
    those that are no numbers. Off a tie the nearest whole number is the decimal's too, and a whole number over a power of ten is its nearest double."""
    scaled = (_c(c) + F.lit(NUDGE)) * F.lit(10.0 ** places)
    off = (F.abs(scaled) < 1e9) & (F.abs(F.abs(scaled - F.rint(scaled)) - 0.5) > 1e-3)
    return F.when(off, F.rint(scaled) / F.lit(10.0 ** places) + F.lit(0.0)).otherwise(rounded(c, places))
