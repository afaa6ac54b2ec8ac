"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in time linear
in the features. x holds log counts of hashed distinct words, scaled to length one, and one bin for each statistic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .words import ALNUM, LOWER, Block, block_of, byte_table, hashes, mix, spans

WORDS, RANK = 2048, 8
EDGES = np.array([0.002, 0.01, 0.03, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9])
_STATS = 12
FEATURES = WORDS + _STATS * (len(EDGES) + 1)
_CLASSES = {
    "upper": byte_table(lambda b: 65 <= b <= 90),
    "lower": byte_table(lambda b: 97 <= b <= 122),
    "digit": byte_table(lambda b: 48 <= b <= 57),
    "space": byte_table(lambda b: b in b" \t"),
    "newline": byte_table(lambda b: b in b"\r\n"),
    "high": byte_table(lambda b: b >= 128),
    "plain": byte_table(lambda b: b in b".,;'-"),
    "mark": byte_table(lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in b".,;'-"),
}
_CLASS_OF = np.zeros(256, np.int64)
for _n, _name in enumerate(_CLASSES):
    _CLASS_OF[_CLASSES[_name].astype(bool)] = _n + 1
_INLINE = byte_table(lambda b: b not in b"\r\n").astype(bool)


def _distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash): their owners, hashes and counts."""
    with np.errstate(over="ignore"):
        key = mix(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return owner[first], h[first], counts


def features(block: Block) -> np.ndarray:
    """A row of FEATURES numbers for each text of the block."""
    n = len(block.offsets) - 1
    data = block.data
    sizes = np.diff(block.offsets)
    owner = np.repeat(np.arange(n), sizes)
    classes = np.bincount(owner * 9 + _CLASS_OF[data], minlength=9 * n).reshape(n, 9).astype(float)
    a, z, t = spans(ALNUM[data] if len(data) else np.zeros(0, bool), block.offsets)
    h = hashes(LOWER[data] if len(data) else data, a, z)
    words = np.bincount(t, minlength=n).astype(float)
    who, what, counts = _distinct(h, t)
    distinct = np.bincount(who, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, who, counts)
    x = np.zeros((n, FEATURES), np.float32)
    bucket = (what % np.uint64(WORDS)).astype(np.int64)
    x[:, :WORDS] = np.bincount(who * WORDS + bucket, np.log1p(counts), minlength=n * WORDS).reshape(n, WORDS)
    x[:, :WORDS] /= np.maximum(np.linalg.norm(x[:, :WORDS], axis=1, keepdims=True), 1e-6)
    la, lz, lt = spans(_INLINE[data] if len(data) else np.zeros(0, bool), block.offsets)
    lines = np.bincount(lt, minlength=n)
    line_kinds = np.bincount(_distinct(hashes(data, la, lz), lt)[0], minlength=n)
    per = lambda k, of: k / np.maximum(of, 1)
    by = {name: classes[:, i + 1] for i, name in enumerate(_CLASSES)}
    stats = np.stack([
        np.log1p(sizes) / 15, per(by["upper"], by["upper"] + by["lower"]), per(by["digit"], sizes), per(by["mark"], sizes), per(by["high"], sizes), per(by["newline"], sizes),
        per(by["space"], sizes), per(by["plain"], words), per(distinct, words), per(most, words), per(line_kinds, lines), per(sizes - by["space"], words) / 20,
    ], axis=1)
    bins = np.searchsorted(EDGES, stats) + np.arange(_STATS) * (len(EDGES) + 1) + WORDS
    np.put_along_axis(x, bins, np.float32(1 / np.sqrt(_STATS) * 2), axis=1)
    return x


def raw_score(x: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    s = x @ v
    return w0 + x @ w + 0.5 * ((s * s).sum(axis=1) - (x * x) @ (v * v).sum(axis=1))


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, prior: float, epochs: int = 25, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights by Adam over shuffled batches, both classes weighing the same; then w0 shifts to the prior share of ones."""
    rng = np.random.default_rng(seed)
    f = x.shape[1]
    ones = y.mean()
    if len(y) == 0 or ones in (0.0, 1.0):
        return float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), np.zeros(f, np.float32), np.zeros((f, RANK), np.float32)
    weight = np.where(y > 0, 0.5 / ones, 0.5 / (1 - ones))
    p = np.concatenate([np.zeros((f, 1)), rng.normal(0, 0.05, (f, RANK))], axis=1).astype(np.float32)
    w0, m, u, step = 0.0, np.zeros_like(p), np.zeros_like(p), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = order[at : at + 256]
            b = x[rows]
            s = b @ p[:, 1:]
            b2 = b * b
            out = w0 + b @ p[:, 0] + 0.5 * ((s * s).sum(axis=1) - b2 @ (p[:, 1:] ** 2).sum(axis=1))
            g = ((sigmoid(out) - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grad = np.concatenate([(b.T @ g)[:, None], b.T @ (g[:, None] * s) - p[:, 1:] * (b2.T @ g)[:, None]], axis=1) + decay * p
            step += 1
            m = 0.9 * m + 0.1 * grad
            u = 0.999 * u + 0.001 * grad * grad
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
            w0 -= rate * float(g.sum())
    return w0 + float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), p[:, 0].copy(), p[:, 1:].copy()


def _text_rows(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def held_out(doc_id, folds: int, fold: int):
    """Column: whether crc32 of the id's text falls into the fold. A null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 4000, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights learned from labelled rows outside the held-out fold.

    sample: about so many rows of each label (0 and 1) are learned from, chosen by a hash of the id; that bounds what one
    task and the driver hold. Rows of labels with a null id or label are passed over; a doc_id labelled more than once
    counts by its larger label.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    known = known.where(~held_out(F.col("doc_id"), 5, 0))
    counts = {r.label: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return 0.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32)
    share = F.when(F.col("label") == 1, min(1.0, sample / counts.get(1, 1))).otherwise(min(1.0, sample / counts.get(0, 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = _text_rows(docs, doc_id, text).join(F.broadcast(chosen), "doc_id")  # about 2 * sample ids

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                x = features(block_of(part.column("text"))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((k, y, x) for b in batches for k, y, x in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[2]))
        if got:
            x = np.frombuffer(b"".join(r[2] for r in got), np.float16).reshape(len(got), FEATURES).astype(np.float32)
            w0, w, v = train(x, np.array([r[1] for r in got], float), counts.get(1, 0) / total, seed=seed)
            yield pa.RecordBatch.from_arrays([pa.array([w0]), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["w0", "w", "v"])

    model = rows.select("doc_id", "text", "label").mapInArrow(vectors, "doc_id long, label int, x binary").repartition(1).mapInArrow(fit, "w0 double, w binary, v binary").first()
    if model is None:
        return 0.0, np.zeros(FEATURES, np.float32), np.zeros((FEATURES, RANK), np.float32)
    return model.w0, np.frombuffer(model.w, np.float32), np.frombuffer(model.v, np.float32).reshape(FEATURES, RANK)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, sample: int = 4000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts are scored by their (empty) statistics. Equal texts have equal scores. A null doc_id isn't held
    out. Without any label all scores are 0.5. Other columns are not read. An empty table gives no rows.
    """
    w0, w, v = learn(docs, labels, doc_id, text, label, sample)
    model = docs.sparkSession.sparkContext.broadcast((w0, w, v))  # FEATURES * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                s = sigmoid(raw_score(features(block_of(part.column("text"))), *model.value).astype(float))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    scored = _text_rows(docs, doc_id, text).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
