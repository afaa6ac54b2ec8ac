"""Ranges: as arguments (literals or constructor calls) and as results (structs)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import InvalidExpression
from ..sqltext import literal, split_call, tokens, unliteral

#: Constructor or literal type, the bounds' Spark type, and the step of discrete ones.
RANGES = {"int4range": ("int", "1"), "int8range": ("bigint", "1"), "numrange": ("double", None), "daterange": ("date", "1"), "tsrange": ("timestamp_ntz", None), "tstzrange": ("timestamp", None)}


@dataclass(frozen=True)
class Bounds:
    """SQL of the bounds as [lower, upper) for discrete ranges, else as given; None: unbounded."""

    lower: str | None
    upper: str | None
    spark_type: str


def _canonical(lower: str | None, upper: str | None, flags: str, kind: str) -> Bounds:
    spark_type, step = RANGES[kind]
    cast = lambda x: None if x is None else f"CAST({x} AS {spark_type})"
    lower, upper = cast(lower), cast(upper)
    add = (lambda x: f"date_add({x}, 1)") if spark_type == "date" else (lambda x: f"({x} + 1)")
    if step and lower and flags[0] == "(":
        lower = add(lower)
    if step and upper and flags[1] == "]":
        upper = add(upper)
    return Bounds(lower, upper, spark_type)


def parse_range(arg: str, kind: str) -> Bounds:
    """Bounds of a range argument of the given kind: '[1,10)' or int4range(1, 10, '[]')."""
    text = unliteral(arg.split("::")[0])
    if text is not None:
        m = re.fullmatch(r"\s*([\[(])\s*([^,]*?)\s*,\s*([^,]*?)\s*([\])])\s*", text)
        if not m:
            raise InvalidExpression(f"'{text}' is not a valid range")
        number = kind in ("int4range", "int8range", "numrange")
        value = lambda x: None if x in ("", "-infinity", "infinity") else (x if number else literal(x.strip('"')))
        return _canonical(value(m[2]), value(m[3]), m[1] + m[4], kind)
    call = split_call(tokens(arg))
    if call and call[0].path[-1] in RANGES and len(call[0].args) in (2, 3):
        parts = [" ".join(t.text for t in a) for a in call[0].args]
        flags = unliteral(parts[2]) if len(parts) == 3 else "[)"
        value = lambda x: None if x.upper() == "NULL" else x
        return _canonical(value(parts[0]), value(parts[1]), flags or "[)", kind)
    raise InvalidExpression(f"{arg} is not a range")


def range_struct(lower: str, upper: str, spark_type: str, missing: str) -> str:
    """[lower, upper) as a struct; unbounded where missing holds, empty where both bounds are equal."""
    null = f"CAST(NULL AS {spark_type})"
    return (
        f"named_struct('lower', CASE WHEN {missing} THEN {null} WHEN ({lower}) < ({upper}) THEN {lower} END, 'upper', CASE WHEN {missing} THEN {null} WHEN ({lower}) < ({upper}) THEN {upper} END, "
        f"'lower_inc', coalesce(NOT ({missing}) AND ({lower}) < ({upper}), false), 'upper_inc', false, 'empty', coalesce(NOT ({missing}) AND ({lower}) >= ({upper}), false))"
    )


def range_text(value: str) -> str:
    """[lower,upper) as text; (,) without bounds, empty for an empty range."""
    return f"CASE WHEN {value}.empty THEN 'empty' ELSE concat(CASE WHEN {value}.lower_inc THEN '[' ELSE '(' END, coalesce(CAST({value}.lower AS string), ''), ',', coalesce(CAST({value}.upper AS string), ''), CASE WHEN {value}.upper_inc THEN ']' ELSE ')' END) END"


def is_range(data_type) -> bool:
    return getattr(data_type, "fieldNames", lambda: [])() == ["lower", "upper", "lower_inc", "upper_inc", "empty"]
