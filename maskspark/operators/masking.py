"""Compiles (table, policy) to projections and applies them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from .. import trust
from ..casts import strict_cast
from ..errors import InvalidExpression
from ..functions import FUNCTIONS, Context
from ..functions.random import ROW_NUMBER
from ..registry import DEFAULT_POLICY, Rule, Table
from ..sqltext import Call, literal, quote, render, tokens
from .sampling import sample


class Compiler:
    """What a rule's text means in Spark SQL, for one table and policy."""

    def __init__(self, engine, table: Table, policy: str = DEFAULT_POLICY, role: str | None = None):
        self.engine, self.table, self.policy, self.role = engine, table, policy, role
        self.source = table.read()
        self.context = Context(engine.spark, self.source.schema, engine.conf, engine.dictionaries, {c.lower(): v for c, v in table.enums.items()})
        self.rules = engine.registry.rules.get(policy, {})

    def _call(self, call: Call) -> str | None:
        schema, name = call.path[-2:] if len(call.path) > 1 else ("", call.path[-1])
        if schema == trust.OWN and name == "hasmask":
            args = [self.text(list(a)) for a in call.args]
            return literal(self.engine.hasmask(args[0].strip("'") if args else self.role, args[1].strip("'") if len(args) > 1 else DEFAULT_POLICY))
        if not schema:
            return None  # Spark's own, or a constructor
        args = [self.text(list(a)) for a in call.args]
        if (builder := self.engine.registry.user_functions.get((schema, name))) is not None:
            return builder(*args)
        if schema in (trust.OWN, trust.HOST) and name in FUNCTIONS:
            return FUNCTIONS[name](self.context, *args)
        raise InvalidExpression(f"function {schema}.{name} does not exist")

    def text(self, ts) -> str:
        return render(ts, self._call)

    def expression(self, sql: str) -> str:
        """Spark SQL of any expression over the table."""
        return self.text(tokens(sql))

    def _cast(self, sql: str, field: StructField) -> str:
        if not self.engine.conf.strict_mode:
            return sql
        if self.context.row_numbers and ROW_NUMBER in sql:
            return f"CAST({sql} AS {field.dataType.simpleString()})"
        return strict_cast(sql, self.context.type_of(sql), self.table.types.get(field.name, field.dataType))

    def column(self, field: StructField) -> tuple[str, bool]:
        """(expression, masked?) of a column: its rule, else its default or NULL if privacy is the default, else itself."""
        rule: Rule | None = self.rules.get((self.table.name, field.name))
        own = quote(field.name)
        if rule is None:
            if not self.engine.conf.privacy_by_default:
                return own, False
            default = self.table.defaults.get(field.name)
            if default is None:
                return f"CAST(NULL AS {field.dataType.simpleString()})", True
            return self._cast(self.expression(default), field), True
        if rule.kind == "not_masked":
            return own, False
        return self._cast(self.expression(rule.text), field), True

    def select_list(self, always_cast: bool = False) -> tuple[list[tuple[str, str]], bool]:
        """(name, expression) of all columns, and whether any is masked."""
        out, any_masked = [], False
        for field in self.source.schema:
            sql, masked = self.column(field)
            if always_cast:
                sql = strict_cast(sql, field.dataType if not masked else self.context.type_of(sql), self.table.types.get(field.name, field.dataType))
            out.append((field.name, sql))
            any_masked |= masked
        return out, any_masked

    def text_of(self, pairs: list[tuple[str, str]]) -> str:
        return ", ".join(f"{sql} AS {quote(name)}" for name, sql in pairs)

    def authentic(self) -> DataFrame:
        """The rows that the role may see, before masks."""
        df = self.source
        for predicate, roles in self.table.row_policies:
            if roles is None or self.role in roles:
                df = df.where(F.expr(self.expression(predicate)))
        return df

    def masked(self) -> DataFrame | None:
        """The masked table; None if nothing is masked, sampled or filtered."""
        pairs, any_masked = self.select_list()
        ratio = self.engine.registry.sample(self.table.name, self.policy)
        rows = self.authentic()
        if not any_masked and ratio is None:
            return None if rows is self.source else rows
        if ratio is not None:
            rows = sample(rows, ratio)
        if self.context.row_numbers:
            rows = numbered(rows)
        df = rows.selectExpr(*(f"{sql} AS {quote(name)}" for name, sql in pairs))
        return self.regenerated(df)

    def regenerated(self, df: DataFrame) -> DataFrame:
        """Generated columns computed anew from the masked ones; df itself if there are none."""
        generated = self.table.generated
        if not generated:
            return df
        out = []
        for field in self.source.schema:
            if field.name in generated:
                sql = self.expression(generated[field.name])
                actual = df.selectExpr(f"{sql} AS x").schema[0].dataType
                out.append(f"{strict_cast(sql, actual, self.table.types.get(field.name, field.dataType))} AS {quote(field.name)}")
            else:
                out.append(quote(field.name))
        return df.selectExpr(*out)


def alias_of(table: Table) -> str:
    """The name of a masking subquery."""
    return "anon_alias_" + hashlib.md5(table.sql_name.encode()).hexdigest()


def numbered(df: DataFrame) -> DataFrame:
    """df with consecutive row numbers from 0 in a hidden column, without moving a row.

    One pass counts the rows of each partition; the rows of the partitions before are a small table, a row for each
    partition, that is joined by broadcast. The source must read the same partitions twice, as files do.
    """
    part = F.spark_partition_id()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.select(part.alias("__part")).groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # a row for each partition
    own = df.withColumn("__part", part).withColumn(ROW_NUMBER, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return own.join(F.broadcast(offsets), "__part").withColumn(ROW_NUMBER, F.col(ROW_NUMBER) + F.col("__before")).drop("__part", "__before")
