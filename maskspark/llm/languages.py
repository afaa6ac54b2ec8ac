"""Language identification by mixture inference.

Every word has a likelihood under each language, from the language's character n-grams. Expectation-maximisation estimates
the proportions of the languages in a document. Its largest language, its two largest and so on up to all of them are the
sets to select from: each set's proportions are estimated anew within it, and the set with the highest likelihood less a
penalty for each further language is selected. The prediction is the largest language by the proportions in that set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import blocks, unused
from .machine import held_out
from .words import Block, block_of, byte_table, spans

BUCKETS_LOG2, SMOOTHING, PENALTY = 16, 0.5, 3.0
#: A text's proportions have settled once a step moves none of them by so much.
SETTLED = 1e-3
UNKNOWN = "und"
_LETTER = byte_table(lambda b: 97 <= b <= 122 or 65 <= b <= 90 or b >= 128).astype(bool)


def lowered(texts: pa.Array) -> Block:
    """Lower-case texts; every byte that no letter has is a separator."""
    return block_of(pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.string()))


def word_grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all words, with a space at either end: grams, where each word's begin, the words' texts."""
    data = block.data
    a, z, t = spans(_LETTER[data] if len(data) else np.zeros(0, bool), block.offsets)
    if not len(a):
        return np.zeros(0, np.int64), a, t
    lengths = z - a  # a word of n bytes has n trigrams with its two spaces
    edges = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(edges - a, lengths)
    mid = data[at].astype(np.uint32)
    left, right = np.full(len(mid), 32, np.uint32), np.full(len(mid), 32, np.uint32)
    left[1:], right[:-1] = mid[:-1], mid[1:]
    left[edges] = 32
    right[edges + lengths - 1] = 32
    gram = (left << np.uint32(16)) | (mid << np.uint32(8)) | right
    return ((gram * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)).astype(np.int64), edges, t


def settle(p: np.ndarray, words: np.ndarray, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text by expectation-maximisation, from those in mix on, and the texts' log likelihoods with them.

    p: a row of likelihoods for each word, text after text; words: the number of each text's words. A text leaves the loop
    when its proportions have settled; a language that starts at 0 stays there.
    """
    out, fit = mix.copy(), np.zeros(len(mix))
    live, now = np.arange(len(mix)), mix
    while len(live):
        n = words[live]
        row, first = np.repeat(np.arange(len(live)), n), np.cumsum(n) - n
        r = p * now[row]
        total = r.sum(axis=1)
        after = np.add.reduceat(r / total[:, None], first) / n[:, None]
        out[live], fit[live] = now, np.add.reduceat(np.log(total), first)
        on = np.abs(after - now).max(axis=1) >= SETTLED
        live, now, p = live[on], after[on], p[on[row]]
    return out, fit


def infer(block: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the index of its language (-1: no letter), that language's share of the words among all languages (0
    to 1), and the proportions of the languages in the selected set (0 for the others; all 0 without a letter).

    table: log likelihoods of grams by language, a row per bucket.
    """
    n, languages = len(block.offsets) - 1, table.shape[1]
    best, share, selected = np.full(n, -1), np.zeros(n), np.zeros((n, languages))
    grams, edges, owner = word_grams(block)
    if not len(grams):
        return best, share, selected
    like = np.add.reduceat(table[grams], edges, axis=0).astype(np.float64)
    like -= like.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(like, -60))
    texts, words = np.unique(owner, return_counts=True)
    row = np.repeat(np.arange(len(texts)), words)
    whole, most = settle(p, words, np.full((len(texts), languages), 1 / languages))
    place = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
    value, chosen = np.full(len(texts), -np.inf), np.zeros_like(whole)
    for k in range(1, languages + 1):
        penalty = PENALTY * (k - 1) * np.log(words + 1)
        # no set is likelier than all languages together, so texts that can't gain by it any more drop out
        live = np.flatnonzero(most + 1e-6 * words - penalty > value)
        start = np.where(place[live] < k, np.maximum(whole[live], 1e-9), 0)
        mix, fit = settle(p[np.isin(row, live)], words[live], start / start.sum(axis=1, keepdims=True))
        fit -= penalty[live]
        better = fit > value[live]
        value[live[better]], chosen[live[better]] = fit[better], mix[better]
    top = chosen.argmax(axis=1)
    best[texts], share[texts], selected[texts] = top, whole[np.arange(len(texts)), top], chosen
    return best, share, selected


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1500) -> tuple[list[str], np.ndarray]:
    """Languages and their table for infer(), from rows with a language outside the held-out fold.

    sample: about so many rows of each language are learned from, chosen by a hash of the id and the text.
    """
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    known = known.where(~held_out(F.col("doc_id"), 4, 2))
    counts = {r.lang: r["n"] for r in docs.where(F.col(lang).isNotNull()).where(~held_out(F.col(doc_id), 4, 2)).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return [], np.zeros((1 << BUCKETS_LOG2, 0), np.float32)
    share = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / n)))), F.col("lang"))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    names = sorted(counts)
    number = {k: i for i, k in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 1 << BUCKETS_LOG2), np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                grams, edges, owner = word_grams(lowered(part.column("text")))
                if len(grams):
                    lengths = np.diff(np.concatenate([edges, [len(grams)]]))
                    language = np.array([number[x] for x in part.column("lang").to_pylist()])[np.repeat(owner, lengths)]
                    total += np.bincount(language * (1 << BUCKETS_LOG2) + grams, minlength=total.size).reshape(total.shape)
        at, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(gram, pa.int32()), pa.array(total[at, gram])], ["lang", "gram", "n"])

    table = np.full((1 << BUCKETS_LOG2, len(names)), SMOOTHING)
    summed = chosen.mapInArrow(count, "lang int, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # at most languages * buckets
    table[summed["gram"].to_numpy(), summed["lang"].to_numpy()] += summed["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1500, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, share, languages, proportions) of every row, after the columns of keep.

    lang_pred is a learned language, or und where the text is null or has no letter; score is the language's share in the
    selected set, share the one among all languages (both 0 for und). languages is the selected set, the largest first,
    and proportions are its languages' shares in it; both are empty for und. A null doc_id isn't held out. Equal texts have
    equal results, repeated rows count once each in learning. Without any row to learn from all are und. keep must not name
    columns like the results'. Columns other than those named are not read. An empty table gives no rows.
    """
    names, table = learn(docs, doc_id, text, lang, sample)
    model = docs.sparkSession.sparkContext.broadcast(table)  # buckets * languages
    key, body = unused(docs, "id"), unused(docs, "body")
    if text in keep and dict(docs.dtypes)[text] == "string":
        body = text  # a kept text goes to Python once
    rows = docs.select(F.col(doc_id).cast("long").alias(key), *([] if body == text else [F.col(text).cast("string").alias(body)]), *(F.col(c) for c in keep))
    added = [unused(docs, c) for c in ("lang_pred", "score", "share", "languages", "proportions")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, body):
                texts = part.column(body)
                best, share, selected = infer(lowered(texts), model.value) if names else (np.full(len(part), -1), np.zeros(len(part)), np.zeros((len(part), 0)))
                for i in np.flatnonzero(best >= 0).tolist():  # bytes beyond ASCII may be other signs
                    signs = texts[i].as_py()
                    if not any(c.isalpha() for c in signs[:200]) and not any(map(str.isalpha, signs)):
                        best[i], share[i], selected[i] = -1, 0.0, 0.0
                order = np.argsort(-selected, axis=1, kind="stable")
                sets = [[k for k in ks if x[k] > 0] for ks, x in zip(order.tolist(), selected.tolist())]
                found = pa.array([names[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string())
                score = pa.array([selected[i, k] if k >= 0 else 0.0 for i, k in enumerate(best.tolist())], pa.float64())
                lists = [pa.array([[names[k] for k in ks] for ks in sets], pa.list_(pa.string())), pa.array([selected[i, ks].tolist() if ks else [] for i, ks in enumerate(sets)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, found, score, pa.array(share), *lists], [*part.schema.names, *added])

    kinds = [StringType(), DoubleType(), DoubleType(), ArrayType(StringType()), ArrayType(DoubleType())]
    extended = StructType([*rows.schema.fields, *(StructField(c, kind) for c, kind in zip(added, kinds))])
    out = rows.mapInArrow(run, extended)
    results = (F.col(c).alias(name) for c, name in zip(added, ("lang_pred", "score", "share", "languages", "proportions")))
    return out.select(*(F.col(c) for c in keep), *([] if doc_id in keep else [F.col(key).alias("doc_id")]), held_out(F.col(key), 4, 2).alias("held_out"), *results)
