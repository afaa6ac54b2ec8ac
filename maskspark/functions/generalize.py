"""Generalisation of numbers and dates to ranges."""

from __future__ import annotations

from ..sqltext import unliteral
from .base import Context, mask_function
from .intervals import STEPS, step_interval, truncate
from .ranges import range_struct, range_text


def _whole(value: str, step: str, kind: str) -> str:
    low = f"(CAST({value} AS bigint) div {step}) * {step}"
    high = f"((CAST({value} AS bigint) div {step}) + 1) * {step}"
    return range_struct(f"CAST({low} AS {kind})", f"CAST({high} AS {kind})", kind, f"({value}) IS NULL")


@mask_function("generalize_int4range", args=(1, 2))
def generalize_int4range(ctx: Context, value: str, step: str = "10") -> str:
    """[value / step * step, one step more), dividing towards zero."""
    return _whole(value, step, "int")


@mask_function("generalize_int8range", args=(1, 2))
def generalize_int8range(ctx: Context, value: str, step: str = "10") -> str:
    return _whole(value, step, "bigint")


@mask_function("generalize_numrange", args=(1, 2))
def generalize_numrange(ctx: Context, value: str, step: str = "10") -> str:
    """As for whole numbers, of the value rounded half away from zero."""
    return _whole(f"CAST(round(CAST({value} AS decimal(38,10))) AS bigint)", step, "bigint")


def _dates(value: str, step: str, kind: str) -> str:
    name = unliteral(step)
    if name is None:
        if step.strip().upper() == "NULL":
            null = f"CAST(NULL AS {kind})"
            return range_struct(null, null, kind, "true")
        cases = [(k, _dates(value, f"'{k}'", kind)) for k in STEPS]
        return "CASE " + step + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases) + " END"
    work = "timestamp_ntz" if kind == "date" else kind
    low = truncate(name, value, work)
    high = f"({low} + {step_interval(name)})"
    return range_struct(f"CAST({low} AS {kind})", f"CAST({high} AS {kind})", kind, f"({value}) IS NULL")


@mask_function("generalize_tsrange", args=(1, 2))
def generalize_tsrange(ctx: Context, value: str, step: str = "'decade'") -> str:
    """From the value truncated to the step to one step later."""
    return _dates(value, step, "timestamp_ntz")


@mask_function("generalize_tstzrange", args=(1, 2))
def generalize_tstzrange(ctx: Context, value: str, step: str = "'decade'") -> str:
    return _dates(value, step, "timestamp")


@mask_function("generalize_daterange", args=(1, 2))
def generalize_daterange(ctx: Context, value: str, step: str = "'decade'") -> str:
    """As for timestamps, with dates as bounds; steps within a day give an empty range."""
    return _dates(value, step, "date")


@mask_function("range_text", args=(1, 1))
def range_as_text(ctx: Context, value: str) -> str:
    return range_text(value)
