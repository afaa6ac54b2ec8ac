"""The table of masking functions, and what a function may ask about the place it is called from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

from ..conf import EngineConf
from ..errors import InvalidExpression


@dataclass
class Context:
    """spark and the masked table's schema (for argument types), settings, dictionaries and enumerations."""

    spark: SparkSession
    schema: StructType
    conf: EngineConf
    dictionaries: object = None
    enums: dict[str, list[str]] = field(default_factory=dict)
    row_numbers: set[str] = field(default_factory=set)

    @cached_property
    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def type_of(self, sql: str) -> DataType:
        """The type that Spark's analysis gives an expression over the table."""
        return self._empty.selectExpr(f"{sql} AS x").schema[0].dataType


@dataclass(frozen=True)
class MaskFunction:
    name: str
    build: Callable[..., str]
    least: int
    most: int
    deterministic: bool

    def __call__(self, ctx: Context, *args: str) -> str:
        if not self.least <= len(args) <= self.most:
            raise InvalidExpression(f"anon.{self.name} takes {self.least} to {self.most} arguments, not {len(args)}")
        return self.build(ctx, *args)


FUNCTIONS: dict[str, MaskFunction] = {}


def mask_function(*names: str, args: tuple[int, int] = (0, 0), deterministic: bool = True):
    """Registers a builder (ctx, *sql) -> sql under names."""

    def add(build):
        for name in names:
            FUNCTIONS[name] = MaskFunction(name, build, *args, deterministic)
        return build

    return add
