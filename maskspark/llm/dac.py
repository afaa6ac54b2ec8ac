"""Directly addressable codes for token ids.

An id is split into bytes, lowest first. Level 0 holds the lowest byte of every id, level k the k-th byte of the ids that
have one. A bitmap beside each level says whose code continues; a rank directory (set bits before every 512th place) finds
the place on the next level. So any token can be read by one look at each level, without decoding a block.

A file image is, little-endian: magic "DACT", version, number of documents, number of tokens, number of levels; the
documents' ids, whether they are null, and their first tokens; then each level's length, bytes, bitmap and directory.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, partitions
from .tokens import crc, default_vocabulary, encoder

MAGIC, VERSION, RANK_BITS = b"DACT", 1, 512
_HEAD = struct.Struct("<4sIQQI")


def encode_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A file image of the documents' ids (four bytes each)."""
    values = np.frombuffer(b"".join(ids), "<u4")
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    levels = []
    while len(values):
        more = values > 255
        bits = np.packbits(more, bitorder="little")
        words = np.add.reduceat(more.astype("<u4"), np.arange(0, len(more), RANK_BITS))
        ranks = (np.cumsum(words) - words).astype("<u4")
        levels.append((len(values), (values & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        values = values[more] >> 8
    out = [
        _HEAD.pack(MAGIC, VERSION, len(ids), int(starts[-1]), len(levels)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        starts.tobytes(),
    ]
    for n, *parts in levels:
        out += [struct.pack("<Q", n), *parts]
    return b"".join(out)


class DacFile:
    """Reads a file image."""

    def __init__(self, image: bytes):
        magic, version, docs, self.n_tokens, levels = _HEAD.unpack_from(image)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of directly addressable codes of this version")
        self._image, self._at = image, _HEAD.size
        ids, null = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [None if gone else int(x) for x, gone in zip(ids, null)]
        self.starts = self._take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<u8", 1)[0])
            self.levels.append((self._take("u1", n), self._take("u1", -(-n // 8)), self._take("<u4", -(-n // RANK_BITS))))
        del self._image

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._image, kind, n, self._at)
        self._at += out.nbytes
        return out

    def token(self, i: int) -> int:
        """The id at place i of the file, by one look at each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for codes, bits, ranks in self.levels:
            value |= int(codes[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            before = bits[block * RANK_BITS // 8 : i >> 3]
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def tokens(self) -> np.ndarray:
        """All ids, level by level from the last."""
        upper = np.zeros(0, np.uint32)
        for codes, bits, _ in reversed(self.levels):
            values = codes.astype(np.uint32)
            more = np.unpackbits(bits, count=len(codes), bitorder="little").astype(bool)
            values[more] |= upper << np.uint32(8)
            upper = values
        return upper

    def document(self, k: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(self.starts[k], self.starts[k + 1])], np.uint32)


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, file_tokens: int = 1 << 18) -> None:
    """Write all documents' ids below path, in ascending doc_id order, as file images of about file_tokens tokens.

    An image is one row of a Parquet table (file_part, file_number, n_docs, n_tokens, part_start, image), so Spark's commit
    protocol covers it: a lost executor's task runs again and leaves one copy. Rows are sorted by file_part, file_number.

    Null and empty texts give the end id alone. Null doc_ids come first. Rows of equal doc_id are ordered by a hash of
    their text. Other columns are not read. An empty table gives no image.
    """
    vocab = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, part = encoder(vocab).encode, int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[bytes] = []
        size = number = start = 0

        def flush() -> pa.RecordBatch:
            image = encode_file(keys, held)
            arrays = [[part], [number], [len(keys)], [size], [start]]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in arrays), pa.array([image], pa.binary())], ["file_part", "file_number", "n_docs", "n_tokens", "part_start", "image"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(t.as_py()) + end
                keys.append(k)
                held.append(ids)
                size += len(ids) // 4
                if size >= file_tokens:
                    yield flush()
                    number, start, size, keys, held = number + 1, start + size, 0, [], []
        if keys:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), tie)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    ordered.mapInArrow(run, "file_part long, file_number long, n_docs long, n_tokens long, part_start long, image binary").write.parquet(path)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """file_part and the tokens before that part; one row for each partition that wrote."""
    parts = spark.read.parquet(path).groupBy("file_part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("file_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("file_part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the files below path: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, ids (four bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                file = DacFile(image.as_py())
                ids, edge = file.tokens().astype("<u4").tobytes(), file.starts
                own = [ids[4 * a : 4 * b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
                columns = [pa.array(file.doc_ids, pa.int64()), pa.array(edge[:-1] + start, pa.int64()), pa.array(np.diff(edge), pa.int64()), pa.array([crc(x) for x in own], pa.int64()), pa.array(own if with_ids else [None] * len(own), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.parquet(path).join(F.broadcast(file_starts(spark, path)), "file_part")  # a row per partition: bounded
    return files.select((F.col("before") + F.col("part_start")).alias("start"), "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def export_files(spark: SparkSession, path: str, folder: str) -> int:
    """Copy the images, one at a time, to files part-number.dac in a folder of the driver."""
    import os

    n = 0
    for row in spark.read.parquet(path).select("file_part", "file_number", "image").toLocalIterator():
        with open(os.path.join(folder, f"{row.file_part:06d}-{row.file_number:06d}.dac"), "wb") as f:
            f.write(row.image)
        n += 1
    return n


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """write_tokens() and then read_tokens(): what the files hold. The files stay below path (by default in the shared folder)."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "dac")
    write_tokens(docs, path, **options)
    return read_tokens(spark, path, with_ids=False)
