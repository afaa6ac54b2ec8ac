"""Static masking: tables rewritten with their masks. Files are immutable, so a new version is written and swapped in."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

from ..errors import FeatureDisabled, MaskingError, UnknownObject
from ..registry import DEFAULT_POLICY, Table
from ..sqltext import quote
from .masking import Compiler, numbered


def _enabled(engine) -> None:
    if not engine.conf.static_masking:
        raise FeatureDisabled("Anon: Static Masking is not enabled: set anon.static_masking to use it")


#: Formats that are written as they are read.
FORMATS = frozenset("parquet orc json csv".split())


def partition_columns(df: DataFrame) -> list[str]:
    """Columns whose values are folders of the files that df reads."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return []
    return list(plan.relation().partitionSchema().fieldNames())


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a swap that was cut off between its two renames: the table is missing, its new files are complete."""
    jvm, p, fs = _files(spark, path)
    if p.getParent() is None or fs.exists(p) or not fs.exists(p.getParent()):
        return
    beside = {f.getPath().getName(): f.getPath() for f in fs.listStatus(p.getParent()) if f.getPath().getName().startswith((f"{p.getName()}.staged-", f"{p.getName()}.old-"))}
    for name, staged in sorted(beside.items()):
        old = beside.get(name.replace(".staged-", ".old-"))
        if ".staged-" in name and old is not None and fs.exists(jvm.Path(staged, "_SUCCESS")) and fs.rename(staged, p):
            fs.delete(old, True)
            return


def replace(engine, table: Table, df: DataFrame) -> None:
    """df becomes the table, in its own format and with its own partition columns.

    The old files stay until the new ones are complete; then two renames swap them, which recover() finishes if they are cut
    off. Where a store has no renames of folders, or readers must never miss the table, register a new path instead.
    """
    if table.path is None:
        table.read = lambda df=df: df
        return
    if table.fmt not in FORMATS:
        raise MaskingError(f"tables of format {table.fmt} can't be rewritten")
    spark = engine.spark
    mark = uuid.uuid4().hex
    staged, old = f"{table.path}.staged-{mark}", f"{table.path}.old-{mark}"
    df.write.format(table.fmt).options(**table.options).partitionBy(*table.partitions).save(staged)
    jvm, path, fs = _files(spark, table.path)
    if not fs.rename(path, jvm.Path(old)):
        raise OSError(f"{table.path} can't be moved")
    if not fs.rename(jvm.Path(staged), path):
        fs.rename(jvm.Path(old), path)
        raise OSError(f"{staged} can't be moved")
    fs.delete(jvm.Path(old), True)
    spark.catalog.refreshByPath(table.path)
    table.read = lambda: spark.read.format(table.fmt).schema(df.schema).options(**table.options).load(table.path)


def anonymize_column(engine, name: str, column: str, policy: str = DEFAULT_POLICY) -> bool:
    """Mask one column in place. False, with a warning, if it has no rule."""
    _enabled(engine)
    table = engine.registry.table(name)
    if engine.registry.sample(table.name, policy):
        warnings.warn("The TABLESAMPLE rule will be ignored. Use anonymize_table() to apply it", stacklevel=2)
    compiler = Compiler(engine, table, policy)
    field = next((f for f in compiler.source.schema if f.name == column), None)
    if field is None:
        raise UnknownObject(f'column "{column}" of relation "{table.sql_name}" does not exist')
    sql, masked = compiler.column(field)
    if not masked:
        warnings.warn(f'There is no masking rule for column "{column}" in table {table.sql_name}', stacklevel=2)
        return False
    rows = numbered(compiler.source) if compiler.context.row_numbers else compiler.source
    df = rows.selectExpr(*(f"{sql if f.name == column else quote(f.name)} AS {quote(f.name)}" for f in compiler.source.schema))
    replace(engine, table, compiler.regenerated(df))
    return True


def anonymize_table(engine, name: str, policy: str = DEFAULT_POLICY) -> bool | None:
    """Mask all columns that have rules, and sample, in one pass. None if the table has neither."""
    _enabled(engine)
    table = engine.registry.table(name)
    compiler = Compiler(engine, table, policy)
    compiler.authentic = lambda: compiler.source  # the owner rewrites all rows
    df = compiler.masked()
    if df is None:
        return None
    replace(engine, table, df)
    return True


def anonymize_database(engine, policy: str = DEFAULT_POLICY) -> bool:
    """anonymize_table() for all tables with a column rule; tables with nothing but a sample rule are not visited."""
    tables = sorted({t for t, _ in engine.registry.rules.get(policy, {})})
    return any([bool(anonymize_table(engine, ".".join(t), policy)) for t in tables])


def check_constraints(df: DataFrame, unique: list[list[str]] = (), not_null: list[str] = (), references: list[tuple[str, DataFrame, str]] = ()) -> list[str]:
    """What a masked table would violate, in words; an empty list if nothing."""
    out = []
    for c in not_null:
        if df.where(f"{quote(c)} IS NULL").limit(1).count():
            out.append(f"{c} has nulls")
    for key in unique:
        if df.groupBy(*key).count().where("count > 1").limit(1).count():
            out.append(f"{', '.join(key)} isn't unique")
    for c, other, target in references:
        if df.where(f"{quote(c)} IS NOT NULL").join(other, df[c] == other[target], "left_anti").limit(1).count():
            out.append(f"{c} has values that {target} lacks")
    return out
