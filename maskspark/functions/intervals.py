"""Intervals of months, days and microseconds, and date units that Spark lacks."""

from __future__ import annotations

import re

from ..errors import InvalidExpression
from ..sqltext import unliteral

_UNITS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "sec": 10**6, "minute": 60 * 10**6, "min": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
_MONTHS = {"month": 1, "mon": 1, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}
STEPS = ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "year", "decade", "century", "millennium")


def parse_interval(arg: str) -> tuple[int, int]:
    """(months, microseconds) of '1 year 2 days', INTERVAL '3 hours' or INTERVAL 3 HOURS."""
    text = re.sub(r"^\s*interval\b", "", arg.split("::")[0].strip(), flags=re.I).strip()
    value = unliteral(text)
    text = value if value is not None else text.replace("'", "")
    months = micros = 0
    rest = text
    for m in re.finditer(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)|([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", text, re.I):
        rest = rest.replace(m[0], "", 1)
        if m[4]:
            sign = -1 if m[3] == "-" else 1
            micros += sign * int((int(m[4]) * 3600 + int(m[5]) * 60 + float(m[6] or 0)) * 10**6)
            continue
        unit = m[2].lower()
        unit = {"centuries": "century", "millennia": "millennium", "mons": "mon", "mins": "min", "secs": "sec"}.get(unit, unit.rstrip("s") if unit not in _UNITS else unit)
        if unit in _MONTHS:
            months += int(float(m[1]) * _MONTHS[unit])
        elif unit in _UNITS:
            micros += int(float(m[1]) * _UNITS[unit])
        else:
            raise InvalidExpression(f"'{unit}' is not a unit of time")
    if rest.strip():
        raise InvalidExpression(f"'{text}' is not a valid interval")
    return months, micros


def total_seconds(arg: str) -> float:
    """Seconds of an interval, a month counting 30 days, as a fraction of one is scaled."""
    months, micros = parse_interval(arg)
    return months * 30 * 86400 + micros / 10**6


def interval_sql(arg: str, sign: int = 1) -> list[str]:
    """Spark intervals that add up to the interval."""
    months, micros = parse_interval(arg)
    out = [f"make_ym_interval(0, {sign * months})"] if months else []
    return out + ([f"make_dt_interval(0, 0, 0, {sign * micros / 10**6:.6f})"] if micros or not out else [])


def truncate(step: str, value: str, spark_type: str) -> str:
    """date_trunc with decade, century and millennium, as spark_type."""
    step = step.lower()
    if step in ("decade", "century", "millennium"):
        year = {"decade": f"(year({value}) div 10) * 10", "century": f"((year({value}) - 1) div 100) * 100 + 1", "millennium": f"((year({value}) - 1) div 1000) * 1000 + 1"}[step]
        return f"CAST(make_date({year}, 1, 1) AS {spark_type})"
    unit = {"microseconds": "MICROSECOND", "milliseconds": "MILLISECOND"}.get(step, step)
    return f"CAST(date_trunc('{unit}', CAST({value} AS timestamp)) AS {spark_type})"


def step_interval(step: str) -> str:
    step = step.lower()
    if step in _MONTHS:
        return f"make_ym_interval(0, {_MONTHS[step]})"
    return f"make_dt_interval(0, 0, 0, {_UNITS[step.rstrip('s') if step not in _UNITS else step] / 10**6:.6f})"
