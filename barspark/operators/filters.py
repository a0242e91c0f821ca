"""Filters and predicates.

A condition is ``{"column": name, "operator": op, "value": v}``; a list of them is
joined with AND into one Column, so Catalyst can push the comparison into the scan.
Column names are checked against the DataFrame, never spliced into SQL text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The supported operator names.
OPERATORS = ["equals", "not_equals", "contains", "not_contains", "greater_than", "less_than",
             "greater_equal", "less_equal", "between", "in", "not_in", "is_null", "is_not_null",
             "in_range"]


def _field(df: DataFrame, column: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == column:
            return f
    raise ValueError(f"unknown column {column!r}")


def _typed(value, dtype: T.DataType) -> Column:
    """A literal of the column's type (F9: coercion follows the column, not the text)."""
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(value, str):
        value = value.strip()
    if isinstance(dtype, T.NumericType):
        return F.lit(float(value)).cast("double")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.to_timestamp(F.lit(str(value))).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.to_date(F.lit(str(value)))
    return F.lit(str(value))


def condition(df: DataFrame, column: str, operator: str, value=None) -> Column:
    """One condition as a Column."""
    f = _field(df, column)
    c = F.col(f"`{column}`")
    dt = f.dataType
    if operator == "equals":
        return c == _typed(value, dt)
    if operator == "not_equals":
        return c != _typed(value, dt)
    if operator in ("contains", "not_contains"):
        # LIKE with the value inside %…%; % and _ in the value stay wildcards.
        # A backslash is an ordinary character.
        like = c.cast("string").like("%" + str(value).replace("\\", "\\\\") + "%")
        return like if operator == "contains" else ~like
    if operator == "greater_than":
        return c > _typed(value, dt)
    if operator == "less_than":
        return c < _typed(value, dt)
    if operator == "greater_equal":
        return c >= _typed(value, dt)
    if operator == "less_equal":
        return c <= _typed(value, dt)
    if operator in ("between", "in_range"):
        lo, hi = _pair(value)
        return c.between(_typed(lo, dt), _typed(hi, dt))
    if operator in ("in", "not_in"):
        vals = [_typed(v, dt) for v in _items(value)]
        inside = c.isin(*vals)
        return inside if operator == "in" else ~inside
    if operator == "is_null":
        return c.isNull()
    if operator == "is_not_null":
        return c.isNotNull()
    raise ValueError(f"unknown operator {operator!r}")


def _pair(value):
    if isinstance(value, str):
        value = value.split(",")
    lo, hi = list(value)[:2]
    return lo, hi


def _items(value) -> list:
    if isinstance(value, str):
        return [v.strip() for v in value.split(",")]
    return list(value)


def conjunction(df: DataFrame, conditions: Iterable[dict]) -> Column:
    """All conditions joined with AND (F8); no condition means every row."""
    parts = [condition(df, c["column"], c["operator"], c.get("value")) for c in conditions]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_conditions(df: DataFrame, conditions: Iterable[dict]) -> DataFrame:
    conditions = list(conditions)
    return df if not conditions else df.filter(conjunction(df, conditions))


#: Operators whose test on a raw number keeps every row that the same test on the conformed one keeps.
PUSHED = ("equals", "greater_than", "less_than", "greater_equal", "less_equal", "between", "in_range", "in", "is_not_null")


def scan_condition(raw: DataFrame, conditions: Iterable[dict]) -> Column:
    """What a scan may drop rows by before they are conformed: the conditions on its numeric columns, as they are stored.

    Conforming turns NaN into NULL, which keeps a comparison from reaching the scan. The raw comparison does reach it, and
    keeps at most NaN rows besides (NaN is above every number); :func:`apply_conditions` on the conformed rows drops those.
    """
    parts = []
    for c in conditions:
        found = [f for f in raw.schema.fields if f.name == c["column"]]
        if found and isinstance(found[0].dataType, T.NumericType) and c["operator"] in PUSHED:
            parts.append(condition(raw, c["column"], c["operator"], c.get("value")))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def conditions_to_json(conditions: Sequence[dict]) -> str:
    """Condition list as JSON text."""
    return json.dumps(list(conditions), indent=2, default=str)


def conditions_from_json(text: str) -> list[dict]:
    data = json.loads(text)
    for c in data:
        if c.get("operator") not in OPERATORS:
            raise ValueError(f"unknown operator {c.get('operator')!r}")
    return data


def date_range(df: DataFrame, start: str | None, end: str | None, column: str = "timestamp") -> DataFrame:
    """Both ends inclusive (F11). An end given as a date means its midnight. NULLs drop."""
    c = F.col(f"`{column}`")
    dt = _field(df, column).dataType
    cond = c.isNotNull()
    if start:
        cond = cond & (c >= _typed(start, dt))
    if end:
        cond = cond & (c <= _typed(end, dt))
    return df.filter(cond)


def column_filter(df: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Per-column literal substring filters, case-insensitive, joined with AND."""
    cond = F.lit(True)
    for col, text in filters.items():
        if not text:
            continue
        _field(df, col)
        cond = cond & F.lower(F.col(f"`{col}`").cast("string")).contains(text.lower())
    return df.filter(cond)


def _row_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])


def search_match(df: DataFrame, text: str, case_sensitive: bool = False) -> Column:
    row = _row_text(df)
    return row.contains(text) if case_sensitive else F.lower(row).contains(text.lower())


def search(df: DataFrame, text: str, case_sensitive: bool = False) -> DataFrame:
    """Rows whose values, joined by a space, contain ``text`` literally."""
    if not text:
        return df
    return df.filter(search_match(df, text, case_sensitive))


def search_count(df: DataFrame, text: str, case_sensitive: bool = False) -> DataFrame:
    """One row ``matched, total`` ("Found m of n"), in one pass."""
    m = search_match(df, text, case_sensitive) if text else F.lit(True)
    return df.agg(F.count_if(m).alias("matched"), F.count(F.lit(1)).alias("total"))
