"""k-anonymity and the detection of identifiers."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def k_anonymity(df: DataFrame, identifiers: list[str]) -> int | None:
    """The size of the smallest group of equal identifiers; None without rows or identifiers. Nulls are equal."""
    if not identifiers:
        warnings.warn("Anon: there is no identifier declared for this table", stacklevel=2)
        return None
    return df.groupBy(*identifiers).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]


def smallest_groups(df: DataFrame, identifiers: list[str], k: int) -> DataFrame:
    """Groups of equal identifiers with fewer than k rows."""
    return df.groupBy(*identifiers).agg(F.count("*").alias("n")).where(F.col("n") < k)


def detect(engine, lang: str = "en_US") -> DataFrame:
    """(table_name, column_name, identifiers_category, direct) of columns whose names a dictionary of identifiers knows."""
    spark, d = engine.spark, engine.dictionaries
    schema = "table_name string, column_name string, identifiers_category string, direct boolean"
    if not d.identifiers:
        warnings.warn("Anon: the dictionaries of identifiers are empty: call init()", stacklevel=2)
        return spark.createDataFrame([], schema)
    hidden = {"anon", "pg_catalog", engine.conf.maskschema}
    columns = [(t.sql_name, c) for t in engine.registry.tables.values() if t.name[0] not in hidden for c in t.read().columns]
    found = spark.createDataFrame(columns, "table_name string, column_name string") if columns else spark.createDataFrame([], "table_name string, column_name string")
    words = spark.createDataFrame(d.identifiers, "lang string, attname string, identifiers_category string").where(F.col("lang") == lang)
    kinds = spark.createDataFrame([(k, direct) for k, direct, _ in d.categories], "identifiers_category string, direct boolean")
    return found.join(words, F.lower("column_name") == F.col("attname")).join(kinds, "identifiers_category").select("table_name", "column_name", "identifiers_category", "direct")
