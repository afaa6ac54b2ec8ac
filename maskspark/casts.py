"""Casts to a column's declared type with the host's rounding and lengths."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .functions.ranges import is_range, range_text

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def strict_cast(sql: str, actual: T.DataType, declared: str | T.DataType) -> str:
    """sql as the declared type: fractions round (decimals half away from zero, floats half to even), text is cut to its
    length, CHAR(n) is padded, ranges become text."""
    target = declared if isinstance(declared, str) else declared.simpleString()
    sized = re.fullmatch(r"\s*(varchar|char)\s*\(\s*(\d+)\s*\)\s*", target, re.I)
    if is_range(actual) and (sized or target == "string"):
        sql = range_text(sql)
    if sized:
        cut = f"left(CAST({sql} AS string), {sized[2]})"
        return cut if sized[1].lower() == "varchar" else f"rpad({cut}, {sized[2]}, ' ')"
    if actual.simpleString() == target:
        return sql
    if target in ("tinyint", "smallint", "int", "bigint"):
        if isinstance(actual, (T.FloatType, T.DoubleType)):
            return f"CAST(rint({sql}) AS {target})"
        if isinstance(actual, T.DecimalType):
            return f"CAST(round({sql}) AS {target})"
    return f"CAST({sql} AS {target})"
