"""Masks over streams: rules are stateless projections, so the same select runs on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import MaskingError
from ..operators.masking import Compiler
from ..operators.sampling import sample
from ..registry import DEFAULT_POLICY, Table


def mask_stream(engine, stream: DataFrame, like: str, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The stream with the rules of a registered table. Masks that number all rows need a batch and are refused."""
    table = engine.registry.table(like)
    own = Table(table.name, lambda: stream, table.defaults, table.generated, table.types, table.enums, table.row_policies)
    compiler = Compiler(engine, own, policy)
    pairs, _ = compiler.select_list()
    if compiler.context.row_numbers:
        raise MaskingError("consecutive ids need a batch")
    rows = compiler.authentic()
    ratio = engine.registry.sample(table.name, policy)
    if ratio is not None:
        rows = sample(rows, ratio)
    return compiler.regenerated(rows.selectExpr(*(f"{sql} AS `{c}`" for c, sql in pairs)))
