"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders (neighbours of one type become one), so that a question with other
numbers or names has the same template. Windows of template tokens are hashed; documents' windows meet the benchmark's in
a join by hash. Windows of a document and an item that lie at the same distance form an alignment, whose slots must be
consistent: each of the item's values stands for one value of the document, and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, unused
from .words import LOWER, Block, block_of, byte_table, hash_of, hashes, lookup, mix, spans

#: Words that count as units of measure.
UNITS = tuple(
    "mm cm m km inch inches foot feet yard yards mile miles mg g gram grams kg kilograms ton tons lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons "
    "ms s sec second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees".split()
)
WORD, NUMBER, NAME, UNIT = range(4)
_ALPHA = byte_table(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128).astype(bool)
_DIGIT = byte_table(lambda b: 48 <= b <= 57).astype(bool)
_UPPER = byte_table(lambda b: 65 <= b <= 90).astype(bool)
_STOP = byte_table(lambda b: b in b".!?:\n\r|").astype(bool)
_UNITS = np.sort(np.array([hash_of(u) for u in UNITS], np.uint64))
_HOLDERS = np.array([hash_of(x) for x in ("", "<number>", "<name>", "<unit>")[1:]], np.uint64)
BITMAP_BITS = 1 << 22
#: Items of fewer template tokens only match whole texts.
SHORTEST = 3


@dataclass
class Template:
    """Template tokens of a block: codes (value: codes of what placeholders stand for), types, texts they belong to, the
    bytes that each stands for, the number of its first word in the text, and whether it holds a capitalised opener."""

    code: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    opens: np.ndarray


def canonical(block: Block) -> tuple[Template, Template]:
    """Letters and digits form words of their own; a word is a name if it begins with a capital A-Z and goes on in other
    letters that aren't capitals. Whether such a word is one where it opens its text or a sentence can't be told: in the
    first of the two results it is none, in the second it is."""
    data, offsets = block.data, block.offsets
    low = LOWER[data] if len(data) else data
    a, z, t = spans(_ALPHA[data] if len(data) else np.zeros(0, bool), offsets)
    d, e, u = spans(_DIGIT[data] if len(data) else np.zeros(0, bool), offsets)
    kind, opener = np.zeros(len(a), np.int8), np.zeros(len(a), bool)
    code = hashes(low, a, z)
    capital = _UPPER[data[a]] if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(capital)
    if len(at):
        uppers = np.concatenate([[0], np.cumsum(_UPPER[data])])
        one = (uppers[z[at]] - uppers[a[at]] == 1) & (z[at] - a[at] > 1)
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        before = np.where(at > 0, z[np.maximum(at - 1, 0)], 0)
        inner = (at > 0) & (t[np.maximum(at - 1, 0)] == t[at]) & (stops[a[at]] == stops[np.minimum(before, a[at])])
        kind[at[one & inner]] = NAME
        opener[at[one & ~inner]] = True
    units = lookup(_UNITS, code) >= 0
    kind[units], opener[units] = UNIT, False
    order = np.argsort(np.concatenate([a, d]), kind="stable")
    value = np.concatenate([code, hashes(low, d, e)])[order]
    kind = np.concatenate([kind, np.full(len(d), NUMBER, np.int8)])[order]
    opener = np.concatenate([opener, np.zeros(len(d), bool)])[order]
    start, end, text = np.concatenate([a, d])[order], np.concatenate([z, e])[order], np.concatenate([t, u])[order]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    return tuple(_merged(value, k, text, start, end, number, opener) for k in (kind, np.where(opener, NAME, kind)))


def _merged(value, kind, text, start, end, number, opener) -> Template:
    """Neighbours of one type become one token, but for a name that opens a sentence after one that ends the last."""
    held = kind > 0
    code = value.copy()
    code[held] = _HOLDERS[kind[held] - 1]
    same = np.zeros(len(kind), bool)
    same[1:] = (kind[1:] == kind[:-1]) & held[1:] & (text[1:] == text[:-1]) & ~opener[1:]
    first = np.flatnonzero(~same)
    if len(first):
        end = end[np.concatenate([first[1:], [len(kind)]]) - 1]
        group = np.cumsum(~same) - 1
        with np.errstate(over="ignore"):
            value = np.where(held, mix(value + (np.arange(len(kind)) - first[group]).astype(np.uint64)), value)
            value = np.add.reduceat(value, first)
        opener = np.logical_or.reduceat(opener, first)
    return Template(code[first], value, kind[first], text[first], start[first], end, number[first], opener)


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(codes) - size + 1, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - size + 1 + j]
    return h


def windows(t: Template, size: int, n_texts: int, opened: bool, lengths: tuple[int, ...] | None) -> tuple[np.ndarray, ...]:
    """(first token, place in its text, tokens, length, hash, plain) of all windows of size tokens, and of shorter texts.

    plain: words are at least half of size; the hash of any other window has the values of its placeholders, too.
    lengths: shorter windows of these lengths in all texts as well; None: those that are a whole text of SHORTEST tokens
    and more. A text of fewer tokens than size also is a window that only equals texts of the same template (length < 0).
    opened: only windows of size tokens that hold a capitalised opener.
    """
    n = len(t.code)
    none = np.zeros(0, np.int64)
    counts = np.bincount(t.text, minlength=n_texts) if n else np.zeros(n_texts, np.int64)
    begins = np.cumsum(counts) - counts
    out = [(none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool))]
    literal = np.concatenate([[0], np.cumsum(t.kind == WORD)])
    openers = np.concatenate([[0], np.cumsum(t.opens)])
    sizes = [size] if opened else [size, *(range(min(SHORTEST, size), size) if lengths is None else lengths)]
    with np.errstate(over="ignore"):
        for k in sizes:
            if n < k:
                continue
            good = t.text[: n - k + 1] == t.text[k - 1 :]
            if opened:
                good &= openers[k:] > openers[: n - k + 1]
            if k < size and lengths is None:
                good &= counts[t.text[: n - k + 1]] == k
            first = np.flatnonzero(good)
            if not len(first):
                continue
            plain = 2 * (literal[first + k] - literal[first]) >= size
            h = np.where(plain, _rolling(t.code, k)[first], mix(_rolling(t.value, k)[first]))
            out.append((first, first - begins[t.text[first]], np.full(len(first), k), np.full(len(first), k), mix(h + np.uint64(k)), plain))
        for k in [] if opened else np.flatnonzero((counts > 0) & (counts < size)).tolist():
            h = np.uint64(0)
            for c in t.code[begins[k] : begins[k] + counts[k]]:
                h = h * np.uint64(0x9E3779B97F4A7C15) + c
            out.append((begins[k : k + 1], np.zeros(1, np.int64), counts[k : k + 1], -counts[k : k + 1], mix(np.array([h + np.uint64(counts[k])])), np.ones(1, bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


_ROWS = "id long, place long, at long, size long, hash long, plain boolean, n_plain long, n_windows long, slots array<string>"


def window_rows(table: DataFrame, key: str, text: str, size: int, bitmap=None, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """Windows of all texts (see windows()): id, place, number of its first word, length, hash, plain, the text's numbers
    of plain windows and of all, and its slots as type:value. Windows with a capitalised opener come in both forms.

    bitmap: a broadcast array of BITMAP_BITS bits; only windows whose hash has its bit set are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                block = block_of(part.column(1))
                totals = None
                for opened, t in enumerate(canonical(block)):
                    first, place, tokens, length, h, plain = windows(t, size, len(part), bool(opened), lengths)
                    if totals is None:  # a short text's two windows are one place
                        full = length == size
                        short = np.bincount(t.text[first[length < 0]], minlength=len(part))
                        totals = [np.bincount(t.text[first[x]], minlength=len(part)) + short for x in (full & plain, full)]
                    if bitmap is not None:
                        bit = (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
                        hit = np.flatnonzero(bitmap.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                        first, place, tokens, length, h, plain = (x[hit] for x in (first, place, tokens, length, h, plain))
                    if not len(first):
                        continue
                    slots = []
                    for i, n in zip(first.tolist(), tokens.tolist()):
                        held = np.flatnonzero(t.kind[i : i + n]) + i
                        slots.append([f"{t.kind[j]}:{block.text(t.start[j], t.end[j]).lower()}" for j in held.tolist()])
                    owner = t.text[first]
                    numbers = [pa.array(x, pa.int64()) for x in (place, t.at[first], length, h.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(owner)), *numbers, pa.array(plain), *(pa.array(x[owner], pa.int64()) for x in totals), pa.array(slots, pa.list_(pa.string()))],
                        ["id", "place", "at", "size", "hash", "plain", "n_plain", "n_windows", "slots"],
                    )

    return table.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _ROWS)


def _bitmap(hashes_: DataFrame) -> np.ndarray:
    """The bits of all hashes; a fixed BITMAP_BITS / 8 bytes whatever the number of rows."""
    words = hashes_.select((F.col("hash").bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("bit")).select(F.expr("bit div 32").alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int)) as mask"))
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    for r in words.groupBy("word").agg(F.bit_or("mask").alias("mask")).collect():  # at most BITMAP_BITS / 32 rows
        out[r.word] = r.mask
    return out.view(np.uint8)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 8, coverage: float = 0.5, consistency: float = 0.75) -> DataFrame:
    """Pairs (doc_id, item_id) of documents that hold a benchmark item or a re-parameterised form of it.

    A pair counts if consistent alignments cover at least that share of the item's windows, or of those of them in which
    words are at least half of the tokens; other windows must have equal values. Columns: windows (covered), item_windows,
    coverage (the larger share), slots (different pairs of values), consistency (1: one to one), reparameterised (a value
    differs).

    Null and empty texts, on either side, match nothing. An item of fewer than size template tokens, but SHORTEST at least,
    matches a document's window of its own length, with equal values if it has fewer than size / 2 words; shorter ones
    match only whole texts of the same template. In all items below size tokens a capitalised first word stays a word.
    Rows of equal doc_id count as one document's, rows of equal item_id as one item's. Null ids match nothing. Other
    columns are not read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = window_rows(benchmark.where(F.col(item_id).isNotNull()), item_id, item_text, size)
    items = items.select(F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("at").alias("item_at"), "size", "hash", "plain", "n_plain", F.col("n_windows").alias("item_windows"), F.col("slots").alias("item_slots"))
    lengths = tuple(sorted(r["size"] for r in items.where((F.col("size") > 0) & (F.col("size") < size)).select("size").distinct().collect()))  # below size
    bitmap = spark.sparkContext.broadcast(_bitmap(items))
    found = window_rows(docs.where(F.col(doc_id).isNotNull()), doc_id, text, size, bitmap, lengths).drop("n_windows", "n_plain", "at")
    pairs = found.join(items, ["hash", "size", "plain"])
    pairs = pairs.select(F.col("id").alias("doc_id"), "item_id", F.struct("item_at", "plain").alias("item_place"), "n_plain", "item_windows", (F.col("place") - F.col("item_place")).alias("shift"), F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("own")).alias("slots"))
    # a row for each place of an alignment, before slots are compared: repeated rows add nothing
    aligned = pairs.groupBy("doc_id", "item_id", "shift").agg(F.max("n_plain").alias("n_plain"), F.max("item_windows").alias("item_windows"), F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    n = F.size("slots")
    own, item = F.size(F.array_distinct(F.transform("slots", lambda x: x.own))), F.size(F.array_distinct(F.transform("slots", lambda x: x.item)))
    aligned = aligned.withColumn("consistency", F.when(n == 0, 1.0).otherwise(F.least(own, item) / n)).where(F.col("consistency") >= consistency)
    covered = F.flatten(F.collect_list("places"))
    count = lambda places: F.size(F.array_distinct(F.transform(places, lambda x: x.item_at))).cast("long")
    whole = aligned.groupBy("doc_id", "item_id").agg(
        F.max("n_plain").alias("n_plain"),
        F.max("item_windows").alias("item_windows"),
        count(covered).alias("windows"),
        count(F.filter(covered, lambda x: x.plain)).alias("plain"),
        F.sum(F.size("slots")).cast("long").alias("slots"),
        F.min("consistency").alias("consistency"),
        F.bool_or(F.exists("slots", lambda x: x.own != x.item)).alias("reparameterised"),
    )
    share = F.greatest(F.col("windows") / F.col("item_windows"), F.when(F.col("n_plain") > 0, F.least(F.lit(1.0), F.col("plain") / F.col("n_plain")))).alias("coverage")
    return whole.select("doc_id", "item_id", "windows", "item_windows", share, "slots", "consistency", "reparameterised").where(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the documents that leaks() finds; rows without a doc_id stay. Columns stay as they are."""
    gone = unused(docs, "leaked")
    found = leaks(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(doc_id).cast("long") == F.col(gone), "left_anti")
