"""Functions of the host database that rules may use, with the host's semantics."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from ..errors import InvalidExpression
from ..sqltext import literal, unliteral
from .base import Context, mask_function
from .intervals import interval_sql, parse_interval, truncate


def _same(name: str, least: int, most: int, template: str | None = None, *more: str):
    @mask_function(name, *more, args=(least, most))
    def build(ctx: Context, *args: str) -> str:
        return template.format(*args) if template else f"{name}({', '.join(args)})"


_same("lower", 1, 1)
_same("upper", 1, 1)
_same("length", 1, 1, "char_length({0})")
_same("left", 2, 2)
_same("right", 2, 2)
_same("md5", 1, 1, "md5(CAST({0} AS string))")
_same("replace", 3, 3)
_same("repeat", 2, 2)
_same("make_date", 3, 3)
_same("now", 0, 0, "current_timestamp()")
_same("btrim", 1, 2)
_same("ltrim", 1, 1)
_same("rtrim", 1, 1)


@mask_function("concat", args=(1, 64))
def concat(ctx: Context, *args: str) -> str:
    """Nulls count as empty."""
    return f"concat_ws('', {', '.join(args)})"


@mask_function("substr", args=(2, 3))
def substr(ctx: Context, text: str, start: str, size: str | None = None) -> str:
    """Places before the first are there but hold nothing, so a start below 1 shortens the result."""
    if size is None:
        return f"substring({text}, greatest({start}, 1))"
    return f"substring({text}, greatest({start}, 1), greatest({start} + {size} - greatest({start}, 1), 0))"


@mask_function("regexp_replace", args=(3, 4))
def regexp_replace(ctx: Context, text: str, pattern: str, by: str, flags: str = "''") -> str:
    """The first match only, or all with the flag g; i ignores case. \\1 is the first group."""
    options, p, b = unliteral(flags) or "", unliteral(pattern), unliteral(by)
    if p is None or b is None:
        raise InvalidExpression("pattern and replacement must be string constants")
    p = ("(?i)" if "i" in options else "") + p
    b = re.sub(r"\\(\d)", r"$\1", b.replace("$", "\\$"))
    if "g" in options:
        return f"regexp_replace({text}, {literal(p)}, {literal(b)})"
    groups = re.compile(p).groups
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", b)
    return f"regexp_replace({text}, {literal(f'(?s)^(.*?)(?:{p})(.*)$')}, {literal('$1' + shifted + f'${groups + 2}')})"


@mask_function("date_add", args=(2, 2))
def date_add(ctx: Context, value: str, interval: str) -> str:
    return "(" + " + ".join([value, *interval_sql(interval)]) + ")"


@mask_function("date_subtract", args=(2, 2))
def date_subtract(ctx: Context, value: str, interval: str) -> str:
    return "(" + " + ".join([value, *interval_sql(interval, -1)]) + ")"


@mask_function("date_part", args=(2, 2))
def date_part(ctx: Context, part: str, value: str) -> str:
    if re.match(r"\s*interval\b", value, re.I):
        months, micros = parse_interval(value)
        days, rest = divmod(micros, 86400 * 10**6)
        parts = {"year": months // 12, "month": months % 12, "day": days, "hour": rest // (3600 * 10**6), "minute": rest // (60 * 10**6) % 60, "second": rest % (60 * 10**6) / 10**6}
        return f"CAST({parts[(unliteral(part) or '').rstrip('s')]} AS double)"
    return f"CAST(date_part({part}, {value}) AS double)"


@mask_function("date_trunc", args=(2, 2))
def date_trunc(ctx: Context, step: str, value: str) -> str:
    name = unliteral(step)
    if name is None:
        raise InvalidExpression("the unit must be a string constant")
    if re.match(r"\s*interval\b", value, re.I):
        months, micros = parse_interval(value)
        size = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}.get(name)
        return f"make_dt_interval(0, 0, 0, {micros // 10**6 // size * size})" if size else f"make_ym_interval(0, {months // 12 * 12 if name == 'year' else months})"
    kind = ctx.type_of(value)
    return truncate(name, value, "timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp")


@mask_function("age", args=(1, 2))
def age(ctx: Context, end: str, start: str | None = None) -> str:
    """Years, months and days between two dates, as text. With one argument: up to today."""
    if start is None:
        end, start = "current_date()", end
    months = f"CAST(floor(months_between(CAST({end} AS date), CAST({start} AS date), false)) AS int)"
    days = f"datediff(CAST({end} AS date), add_months(CAST({start} AS date), {months}))"
    return f"concat({months} div 12, ' years ', {months} % 12, ' mons ', {days}, ' days')"


@mask_function("make_time", args=(3, 3))
def make_time(ctx: Context, hour: str, minute: str, second: str) -> str:
    return f"date_format(timestamp_seconds({hour} * 3600 + {minute} * 60 + {second}), 'HH:mm:ss')"


#: The host's date patterns and Spark's, longest first.
_DATES = {"HH24": "HH", "HH12": "hh", "YYYY": "yyyy", "Month": "MMMM", "Mon": "MMM", "DDD": "DDD", "Day": "EEEE", "YY": "yy", "MM": "MM", "DD": "dd", "Dy": "EEE", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a"}


def date_pattern(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        for k, v in _DATES.items():
            if text[i : i + len(k)].lower() == k.lower():
                out += v
                i += len(k)
                break
        else:
            out += f"'{text[i]}'" if text[i].isalpha() else text[i]
            i += 1
    return out


def _interval_text(months: int, micros: int, pattern: str) -> str:
    """An interval by a pattern of the host's: years, months, days, hours, minutes, seconds, parts of a second."""
    seconds, rest = divmod(micros, 10**6)
    parts = {
        "YYYY": f"{months // 12:04d}", "MM": f"{months % 12:02d}", "DD": f"{seconds // 86400:02d}", "HH24": f"{seconds % 86400 // 3600:02d}", "HH12": f"{(seconds % 43200 // 3600) or 12:02d}",
        "MI": f"{seconds % 3600 // 60:02d}", "SS": f"{seconds % 60:02d}", "MS": f"{rest // 1000:03d}", "US": f"{rest:06d}",
    }
    return re.sub("|".join(parts), lambda m: parts[m[0].upper()], pattern, flags=re.I)


@mask_function("to_char", args=(2, 2))
def to_char(ctx: Context, value: str, pattern: str) -> str:
    """Dates by pattern; numbers with a leading sign place if the pattern has no sign of its own."""
    text = unliteral(pattern)
    if text is None:
        raise InvalidExpression("the pattern must be a string constant")
    if re.match(r"\s*interval\b", value, re.I):
        return literal(_interval_text(*parse_interval(value), text))
    if isinstance(ctx.type_of(value), T.NumericType):
        signed = any(c in text.upper() for c in ("S", "MI", "PR"))
        if signed:
            return f"to_char({value}, {literal(text)})"
        return f"concat(CASE WHEN {value} < 0 THEN '-' ELSE ' ' END, to_char(abs({value}), {literal(text)}))"
    return f"date_format({value}, {literal(date_pattern(text))})"


@mask_function("to_date", args=(2, 2))
def to_date(ctx: Context, value: str, pattern: str) -> str:
    return f"to_date({value}, {literal(date_pattern(unliteral(pattern) or ''))})"


@mask_function("to_timestamp", args=(2, 2))
def to_timestamp(ctx: Context, value: str, pattern: str) -> str:
    return f"to_timestamp({value}, {literal(date_pattern(unliteral(pattern) or ''))})"


@mask_function("to_number", args=(2, 2))
def to_number(ctx: Context, value: str, pattern: str) -> str:
    return f"to_number({value}, {pattern})"


@mask_function("json_build_array", "jsonb_build_array", args=(0, 64))
def json_build_array(ctx: Context, *args: str) -> str:
    return "concat('[', concat_ws(', ', " + ", ".join(_json(ctx, a) for a in args) + "), ']')" if args else "'[]'"


@mask_function("json_build_object", "jsonb_build_object", args=(0, 64))
def json_build_object(ctx: Context, *args: str) -> str:
    pairs = [f"concat({_json(ctx, f'CAST({k} AS string)')}, ' : ', {_json(ctx, v)})" for k, v in zip(args[::2], args[1::2])]
    return "concat('{', concat_ws(', ', " + ", ".join(pairs) + "), '}')" if pairs else "'{}'"


def _json(ctx: Context, value: str) -> str:
    """JSON text of a value: an array of one without its brackets."""
    text = f"to_json(array({value}))"
    return f"coalesce(substring({text}, 2, length({text}) - 2), 'null')"


@mask_function("to_json", "to_jsonb", "row_to_json", "array_to_json", args=(1, 1))
def to_json(ctx: Context, value: str) -> str:
    """JSON text of rows, arrays, maps and single values; of NULL, NULL."""
    if isinstance(ctx.type_of(value), (T.StructType, T.ArrayType, T.MapType)):
        return f"to_json({value})"
    return f"CASE WHEN {value} IS NOT NULL THEN {_json(ctx, value)} END"


@mask_function("json_object", "jsonb_object", args=(2, 2))
def json_object(ctx: Context, keys: str, values: str) -> str:
    return f"to_json(map_from_arrays({keys}, {values}))"
