"""Noise on numbers and on dates."""

from __future__ import annotations

from pyspark.sql import types as T

from .base import Context, mask_function
from .intervals import total_seconds

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def noise_sql(ctx: Context, value: str, ratio: str) -> str:
    kind = ctx.type_of(value)
    near = f"(({value}) * (1 - (2 * rand() - 1) * {ratio}))"
    inner = f"(({value}) * (1 - rand() * {ratio}))"  # towards zero: no overflow
    if isinstance(kind, _WHOLE):
        return f"coalesce(try_cast(rint({near}) AS {kind.simpleString()}), try_cast(rint({inner}) AS {kind.simpleString()}))"
    if isinstance(kind, T.DecimalType):
        return f"coalesce(try_cast({near} AS {kind.simpleString()}), try_cast({inner} AS {kind.simpleString()}))"
    return f"CAST({near} AS {kind.simpleString()})"


@mask_function("noise", args=(2, 2), deterministic=False)
def noise(ctx: Context, value: str, ratio: str) -> str:
    """The value, more or less by up to ratio of itself, in its own type."""
    return noise_sql(ctx, value, ratio)


def moved(ctx: Context, value: str, seconds: str) -> str:
    """value plus a number of seconds, in its own type; a time of day (text) wraps around midnight."""
    kind = ctx.type_of(value)
    shift = f"make_dt_interval(0, 0, 0, CAST({seconds} AS decimal(18,6)))"
    if isinstance(kind, T.StringType):
        micros = f"pmod(CAST(unix_micros(CAST(concat('1970-01-01 ', {value}) AS timestamp)) + {seconds} * 1000000 AS bigint), 86400000000)"
        return f"CASE WHEN {value} IS NOT NULL THEN date_format(timestamp_micros({micros}), 'HH:mm:ss.SSSSSS') END"
    if isinstance(kind, T.DateType):
        return f"CAST(CAST({value} AS timestamp_ntz) + {shift} AS date)"
    return f"({value} + {shift})"


@mask_function("dnoise", args=(2, 2), deterministic=False)
def dnoise(ctx: Context, value: str, interval: str) -> str:
    """The date, timestamp or time, earlier or later by up to the interval."""
    return moved(ctx, value, f"((2 * rand() - 1) * {total_seconds(interval)!r})")
