"""Partial scrambling and conditions."""

from __future__ import annotations

from .base import Context, mask_function


@mask_function("partial", args=(4, 4))
def partial(ctx: Context, value: str, prefix: str, padding: str, suffix: str) -> str:
    """The first prefix characters, the padding, the last suffix characters."""
    return f"concat(substring({value}, 1, {prefix}), {padding}, right({value}, {suffix}))"


@mask_function("partial_email", args=(1, 1))
def partial_email(ctx: Context, value: str) -> str:
    """Two characters of the local part and of the domain, and what follows the last dot."""
    local, domain, last = f"regexp_replace({value}, '@.*', '')", f"regexp_replace({value}, '.*@', '')", f"regexp_replace({value}, '.*[.]', '')"
    return f"concat(substring({local}, 1, 2), '******@', substring({domain}, 1, 2), '******.', {last})"


@mask_function("ternary", args=(3, 3))
def ternary(ctx: Context, condition: str, yes: str, no: str) -> str:
    """yes where the condition holds, else no (also where it is null)."""
    return f"CASE WHEN CAST({condition} AS boolean) THEN {yes} ELSE {no} END"
