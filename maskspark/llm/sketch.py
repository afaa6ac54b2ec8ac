"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the hash range, and nothing else.

The rule depends on the hash alone, so merge() of two sketches is the sketch of the union of their sets of shingles, and the
hashes that two sketches share are those that their sets share below the limit, however unequal the documents are. A text of n
shingles keeps n * FRACTION hashes on average and none with probability (1 - FRACTION)^n: 1 % at 35 shingles (39 words), so
estimates for shorter texts aren't reliable. A sketch of an average web text takes about a sixth of the text's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, blocks, partitions
from .words import block_of, shingles

FRACTION, SHINGLE = 1 / 8, 5


def scaled(hashes: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The hashes that a sketch keeps of a set, ascending and distinct."""
    return np.unique(hashes[hashes < np.uint64(int(fraction * (1 << 64)))] if fraction < 1 else hashes)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller set's shingles that the other set has, too (0 to 1). Equal sketches: 1, empty ones
    among them; an empty sketch and another: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def sketches(texts: pa.Array, fraction: float = FRACTION, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text."""
    return [scaled(h, fraction) for h in shingles(block_of(texts), shingle)]


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row, where it lies.

    Null texts count as empty ones: an empty fingerprint, as have texts that keep no hash. Rows of equal text have equal
    fingerprints. Other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                found = [to_text(x) for x in sketches(part.column("text"), fraction, shingle)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_chars"), pa.array(found, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.length(body).cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many of cuts (ascending) are key or more, by bisection: a few steps, however many cuts there are."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*(F.lit(c).cast("long") for c in cuts))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def step(state: Column, _: Column) -> Column:
        middle = F.floor((state.low + state.high) / 2).cast("int")
        less = (state.low < state.high) & (F.get(edges, middle) < key)
        return F.struct(F.when(less, middle + 1).otherwise(state.low).alias("low"), F.when(less | (state.low >= state.high), state.high).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.lit(len(cuts)) - F.aggregate(steps, start, step, lambda state: state.low)


def neighbours(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """Rows (bucket, guest, key, doc_id, text): by descending doc_id, cut into buckets; every row's next row is in its bucket.

    A bucket also gets, as guests that sort last, the rows with the next bucket's largest doc_id (the last bucket: with
    the table's). Bounds come from a sketch of the ids alone; a bucket's largest id is one number for each bucket.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(lowest))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).select(key.alias("key"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(ids.agg(F.percentile_approx("key", shares, max(10000, 20 * buckets))).first()[0] or [])) if shares else []
    tops = {r.bucket: r.top for r in ids.withColumn("bucket", _bucket(F.col("key"), cuts)).groupBy("bucket").agg(F.max("key").alias("top")).collect()}  # a row per bucket
    order = sorted(tops)
    host = {b: order[i - 1] for i, b in enumerate(order)}  # the bucket before; before the first comes the last
    rows = rows.withColumn("key", key).withColumn("bucket", _bucket(F.col("key"), cuts))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    places = F.array(own)
    if host:
        listed = lambda values: F.get(F.array(*(F.lit(values.get(b)).cast("long") for b in range(len(cuts) + 1))), F.col("bucket"))
        twice = F.array(own, F.struct(listed(host).cast("int").alias("bucket"), F.lit(1).alias("guest")))
        places = F.when(F.col("key") == listed(tops), twice).otherwise(places)
    return rows.withColumn("place", F.explode(places)).select("place.bucket", "place.guest", "key", "doc_id", "text")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fraction: float = FRACTION, shingle: int = SHINGLE) -> DataFrame:
    """Every row with the fingerprint of its text and of an edited text, whose last third is the next row's beginning.

    Next is the row with the next smaller doc_id; after the last comes the first. Null doc_ids come last. Rows of equal
    doc_id are ordered by a hash of their text, then the text. Null texts are empty. The only row of a table is its own
    next. An empty table gives no rows. Other columns are not read. near_edited and near_next are containment() of the
    row's fingerprint and that of the edited text, of the next row.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # (bucket, doc_id, text) in order, each one's next behind it; of the last only the text counts
        held = 0

        def take() -> pa.RecordBatch:
            own = sketches(pa.array([t for _, _, t in rows], pa.large_string()), fraction, shingle)
            pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0]]
            edited = []
            for i in pairs:
                t = rows[i][2]
                cut = len(t) // 3
                edited.append(t[: len(t) - cut] + rows[i + 1][2][:cut])
            other = sketches(pa.array(edited, pa.large_string()), fraction, shingle)
            columns = [
                pa.array([rows[i][1] for i in pairs], pa.int64()),
                pa.array([len(rows[i][2]) for i in pairs], pa.int64()),
                pa.array([sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([to_text(own[i]) for i in pairs], pa.string()),
                pa.array([to_text(x) for x in other], pa.string()),
                pa.array([containment(own[i], x) for i, x in zip(pairs, other)], pa.float64()),
                pa.array([containment(own[i], own[i + 1]) for i in pairs], pa.float64()),
            ]
            del rows[:-1]
            return pa.RecordBatch.from_arrays(columns, names)

        closed = None  # the bucket whose first guest has come
        for batch in batches:
            columns = batch.columns
            for bucket, guest, key, body in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].to_pylist(), columns[3]):
                if guest and (bucket == closed or not rows or rows[-1][0] != bucket):
                    continue  # only the first guest follows the bucket's last row
                closed = bucket if guest else None
                rows.append((bucket, key, body.as_py()))
                held += len(rows[-1][2])
                if held >= BLOCK_CHARS and len(rows) > 1:
                    yield take()
                    held = len(rows[-1][2])
        if len(rows) > 1:
            yield take()

    tie = F.xxhash64("text")
    dealt = neighbours(docs, doc_id, text, n).repartitionById(n, "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "guest", F.desc("key"), tie, "text").select("bucket", "guest", "doc_id", "text")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
