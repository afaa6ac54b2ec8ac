"""A training corpus from documents, in five stages that each call one operator of maskspark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet in the shared
folder and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.llm import languages, ledger, packing, simhash, templates
from maskspark.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose largest language covers a smaller share of their words, among all languages, are rejected, as are those
#: without any letter.
LEAST_LANGUAGE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; und and even mixtures of four languages and more go, those of two or three stay."""
    found = languages.identify(docs, keep=COLUMNS)
    return found.where((F.col("lang_pred") != languages.UNKNOWN) & (F.col("share") >= LEAST_LANGUAGE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicate(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return templates.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows the new text."""
    clean = ledger.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, with their ids."""
    return packing.pack_sequences(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("pack", pack)]

#: Mixture inference, SimHash and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return docs
