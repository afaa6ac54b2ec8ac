"""Operators that change a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import MaskingError
from ..functions import Context
from ..functions.intervals import total_seconds
from ..functions.noise import moved, noise_sql
from ..sqltext import literal, quote


def _known(df: DataFrame, table: str, *columns: str) -> None:
    for c in columns:
        if c not in df.columns:
            raise MaskingError(f'Column "{c}" does not exist in table "{table}".')


def add_noise_on_numeric_column(ctx: Context, df: DataFrame, table: str, column: str, ratio: float) -> DataFrame:
    _known(df, table, column)
    if not 0 <= ratio <= 1:
        raise MaskingError("ratio must be between 0 and 1")
    return df.withColumn(column, F.expr(noise_sql(ctx, quote(column), repr(float(ratio)))))


def add_noise_on_datetime_column(ctx: Context, df: DataFrame, table: str, column: str, interval: str) -> DataFrame:
    _known(df, table, column)
    return df.withColumn(column, F.expr(moved(ctx, quote(column), f"((2 * rand() - 1) * {total_seconds(literal(interval))!r})")))


def _ranked(df: DataFrame, order: str, rank: str) -> DataFrame:
    """df with the rank (from 0) of its evenly spread 64-bit hashes, without a single task that sees all rows.

    The hashes' upper bits are the bucket: a row's rank is its place in the bucket plus the rows of the buckets before.
    These counts, one for each bucket, are a small table that is joined by broadcast.
    """
    bits = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1
    bucketed = df.withColumn("__bucket", F.shiftrightunsigned(F.col(order), 64 - bits))
    sizes = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(order)) - 1
    return bucketed.withColumn(rank, place).join(F.broadcast(sizes), "__bucket").withColumn(rank, F.col(rank) + F.col("__before")).drop("__bucket", "__before")


def shuffle_column(df: DataFrame, table: str, column: str, key: str, seed: int | None = None) -> DataFrame:
    """df with the values of a column dealt out anew among its rows, each value going to one row.

    Rows are ordered once by a hash of the row and once by another; the n-th of one order gets the value of the n-th of the
    other. Both hashes take a seed, drawn at random unless given, and so stay the same when a lost task runs again.
    """
    import random

    _known(df, table, column, key)
    seed = random.getrandbits(31) if seed is None else seed
    plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    order = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *plain)
    rows = _ranked(df.withColumn("__order", order(1)), "__order", "__rank").drop("__order", column)
    values = _ranked(df.select(F.col(column), order(2).alias("__order")), "__order", "__rank").select("__rank", column)
    return rows.join(values, "__rank").select(*df.columns)
