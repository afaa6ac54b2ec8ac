"""Anonymous dumps: one masked write for each table; rules are never written."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, DataFrameWriter

from ..registry import DEFAULT_POLICY
from .masking import Compiler


def write(df: DataFrame, path: str, fmt: str = "csv", columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Masked export of some or all columns."""
    out: DataFrameWriter = (df.select(*columns) if columns else df).write.mode(mode)
    (out.option("header", True) if fmt == "csv" else out).format(fmt).save(path)


def dump(engine, out: str, policy: str = DEFAULT_POLICY, fmt: str = "csv", schemas: list[str] = ("*",), tables: list[str] = ("*",), exclude_schemas: list[str] = (), exclude_tables: list[str] = (), mode: str = "errorifexists") -> dict[str, str]:
    """Write all chosen tables below out, masked; globs choose schemas and tables. Returns each table's path."""
    some = lambda name, globs: any(fnmatchcase(name, g) for g in globs)
    chosen = {}
    for (schema, name), table in sorted(engine.registry.tables.items()):
        full = f"{schema}.{name}"
        listed = some(schema, schemas) and (some(name, tables) or some(full, tables))
        if listed and not some(schema, exclude_schemas) and not (some(name, exclude_tables) or some(full, exclude_tables)) and not table.is_view:
            compiler = Compiler(engine, table, policy)
            df = compiler.masked()
            chosen[full] = (compiler.source if df is None else df, f"{out.rstrip('/')}/{full}")
    for df, path in chosen.values():
        write(df, path, fmt, mode=mode)
    return {k: path for k, (_, path) in chosen.items()}
