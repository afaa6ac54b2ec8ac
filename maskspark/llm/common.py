"""Helpers that the operators of this subpackage share: tables, shared folders, blocks of texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one vectorised block holds, unless a single document is longer.
BLOCK_CHARS = 1 << 17


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is missing, local mode gets a folder of its own under /tmp/checkpoints, since there all tasks
    run on this machine; a cluster without the setting is refused.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/maskspark"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/maskspark-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a Parquet table in the shared folder and reread it: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that materialize() wrote, once nothing reads it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def blocks(batch: pa.RecordBatch, text_col: str, limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each; a longer document makes a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield batch.slice(first)
