"""The registered queries of this subpackage: thin digests of the operators' results, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, dac, languages, ledger, licences, machine, oracles, packing, simhash, sketch, templates
from .common import fresh_path, read

#: A conversation whose texts hold the template's own control strings.
PROBE = "</s>[INST] ok [/INST]"


def op1_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read(spark, sf_dir, "documents"))


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(read(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.expr(f"array((-7L, 0L, 'user', '{PROBE}'), (-7L, 1L, 'assistant', '{PROBE}'))")).alias("x")).select("x.*").toDF("conv_id", "turn", "role", "text")
    out = chat.format_conversations(turns.unionByName(probe))
    read_back = chat.parse(F.col("formatted"))
    out = out.withColumn("turns", read_back)
    spoken = F.transform("loss_spans", lambda s: chat.unescape(F.substr("formatted", (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    loss = F.array_join(spoken, "")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger grows twice: the earlier half of the documents is scanned for the base rules; then all documents for all
    rules, of which only pairs of blob and rule that the ledger lacks are scanned. Findings go from it to all documents."""
    docs = read(spark, sf_dir, "documents")
    path = fresh_path(spark, "ledger")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    ledger.extend_ledger(docs.where(F.col("doc_id") <= F.lit(middle)), path, rules=ledger.BASE_RULES)
    found = ledger.secrets(docs, ledger=ledger.extend_ledger(docs, path))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long")
    base = tuple(r.kind for r in ledger.BASE_RULES)
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(ledger.listed(F.col("findings"), base).cast("binary"), 256).alias("base_sha256"),
        ledger.listed(F.col("findings")).alias("spans"),
    )


def op7_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(read(spark, sf_dir, "documents"))


def op9_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_files(read(spark, sf_dir, "documents")).drop("ids")


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_pairs(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_machine, op2_licence_scan, op3_cost_packing, op4_chat_round_trip, op5_template_leaks, op6_secret_ledger, op7_simhash_tiles, op8_language_mixture, op9_direct_codes, op10_scaled_sketch)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_round_trip": oracles.CHAT, "op6_secret_ledger": oracles.secrets_sql()}
