"""SimHash near-duplicates by tiled exact comparison.

Every distinct fingerprint goes to some cells, and only cells are compared: sorted by population count and cut into tiles,
each pair of tiles by exclusive-or and bit counts, but for pairs whose population counts differ beyond the radius. A cell
with more than CELL fingerprints is dealt out as pairs of parts, each pair a unit of work of its own.

64-bit fingerprints within a small radius: of m bit blocks, those that differ in at most radius bits agree in at least one
choice of m - radius. There is a cell for each choice, keyed by the bits of its blocks, so no link is lost. m grows with the
number of fingerprints, so that cells stay small.

Sets of distinct shingles, for a similarity: here the bits are parities, of which a pair's can't differ in more bits than the
sets do in shingles, so that no similar pair is lost as SimHash bits would lose it. Cells are the shingles of the sets' prefixes,
the rarest in an order that all sets share, one of which no similar pair can avoid. Tiles are compared by exclusive-or and bit
counts as above, with a radius by the sets' sizes, and the exact Jaccard similarity of the pairs within it decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, discard, materialize, partitions, unused
from .components import components
from .words import LOWER, block_of, lookup, shingles

TILE, CELL = 512, 8192
_LOWER = LOWER.tobytes()


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash (unsigned) of a text's word shingles, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits = np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null texts count as empty ones: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def scheme(n: int, radius: int) -> tuple[int, int]:
    """Number m of blocks, and how many low bits of a key count, so that cells of n evenly spread fingerprints hold some 1000."""
    want = max(0, int(np.ceil(np.log2(max(n, 1) / 1024))))
    for m in range(radius + 1, radius + 5):
        if want <= (m - radius) * (64 // m):
            return m, want
    return m, (m - radius) * (64 // m)


def cell_keys(fp, n: int, radius: int) -> list:
    """Columns: the cell of a fingerprint for each choice of blocks. The number of the choice is part of the key."""
    m, bits = scheme(n, radius)
    edges = [64 * i // m for i in range(m + 1)]
    per = -(-bits // (m - radius))
    keys = []
    for k, chosen in enumerate(combinations(range(m), m - radius)):
        key = F.lit(k).cast("long")
        left = bits
        for block in chosen:
            take = min(per, left, edges[block + 1] - edges[block])
            left -= take
            key = F.shiftleft(key, take).bitwiseOR(F.shiftrightunsigned(fp, edges[block]).bitwiseAND(F.lit((1 << take) - 1).cast("long")))
        keys.append(key)
    return keys


def tile_links(ids: np.ndarray, bits: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what the fingerprints within the radius connect (a spanning forest of each pair of tiles).

    bits: a uint64 for each id. side: 0 for all if every pair counts, else 0 and 1, and only pairs across count.
    """
    pop = np.bitwise_count(bits).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    ids, bits, side, pop = ids[order], bits[order], side[order], pop[order]
    within = not side.any()
    groups = [np.arange(len(ids))] * 2 if within else [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
    tiles = [[g[i : i + TILE] for i in range(0, len(g), TILE)] for g in groups]
    out: list[tuple[int, int]] = []
    for i, one in enumerate(tiles[0]):
        for two in tiles[1][i:] if within else tiles[1]:
            if pop[two[0]] - pop[one[-1]] > radius:
                break  # later tiles have larger counts still
            if pop[one[0]] - pop[two[-1]] > radius:
                continue
            near = np.bitwise_count(bits[one][:, None] ^ bits[two][None, :]) <= radius
            if within and one is two:
                np.fill_diagonal(near, False)
            out += [(int(ids[one[a]]), int(ids[two[b]])) for a, b in _forest(near)]
    return out


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Cells of a boolean matrix that connect the same rows and columns as all its cells."""
    rows = np.flatnonzero(near.any(axis=1))
    out, todo = [], set(rows.tolist())
    unseen = np.ones(near.shape[1], bool)
    while todo:
        front = [todo.pop()]
        while front:
            row = front.pop()
            cols = np.flatnonzero(near[row] & unseen)
            unseen[cols] = False
            out += [(row, int(c)) for c in cols]
            for c in cols:
                for r in np.flatnonzero(near[:, c]).tolist():
                    if r in todo:
                        todo.discard(r)
                        front.append(r)
                        out.append((r, int(c)))
    return out


def cell_links(cells: DataFrame, columns: list[str], compare: Callable[[np.ndarray, np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """Pairs (a, b) that compare finds among rows (cell, fp, *columns) of equal cell; all columns are longs.

    compare: rows (cell, i, j, side, fp, *columns) and the bounds of units of work in them, runs of equal (cell, i, j). In a
    unit with i < j only pairs across sides 0 and 1 count.
    """
    spark = cells.sparkSession
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    sizes, _ = materialize(sizes, "cells")  # at most rows / CELL
    cells = cells.join(sizes, "cell", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(0)) / CELL).cast("int"))
    part = F.pmod(F.xxhash64("fp", "cell"), F.greatest("parts", F.lit(1))).cast("int")
    dealt = cells.withColumn("part", part).withColumn("other", F.explode(F.expr("sequence(0, greatest(parts, 1) - 1)")))
    units = dealt.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "fp", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (cell, i, j); a unit has about 2 * CELL rows at most."""
        rest: list[np.ndarray] = []

        def table(rows: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
            if found := compare(rows, bounds):
                pairs = np.array(found, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([*rest, rows]) if rest else rows
            bounds = np.concatenate([[0], np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1])
            rest = [rows[bounds[-1] :]]
            if len(bounds) > 1:
                yield from table(rows[: bounds[-1]], bounds)
        if rest:
            yield from table(rest[0], np.array([0, len(rest[0])]))

    return units.repartition(partitions(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect all of n distinct 64-bit fingerprints (fp) within the radius."""

    def compare(rows: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a > 1:
                out += tile_links(rows[a:b, 4], np.ascontiguousarray(rows[a:b, 4]).view(np.uint64), rows[a:b, 3], radius)
        return out

    cells = fps.select("fp", F.explode(F.array(*cell_keys(F.col("fp"), n, radius))).alias("cell"))
    return cell_links(cells.select("cell", "fp"), [], compare)


def classes(own: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """own's rows with component_id, the smallest doc_id that links between fingerprints lead to.

    own: rows with doc_id and fp; distinct: (fp, least), its fingerprints with their smallest doc_ids.
    """
    roots, _ = materialize(components(links), "roots")
    grouped = distinct.join(roots, distinct.fp == roots.vertex, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    grouped, path = materialize(grouped, "grouped")
    # a table of its own, so that both sides of the join are plain exchanges, which Spark splits where one root has many rows
    least, least_path = materialize(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named, _ = materialize(grouped.join(least, "root").select("fp", "component_id"), "named")
    for done in (path, least_path):
        discard(own.sparkSession, done)
    return own.join(named, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """Every row's doc_id, fingerprint (16 hexadecimal digits) and component_id.

    component_id is the smallest doc_id that links (fingerprints at radius or fewer differing bits) lead to.
    Null and empty texts have fingerprint zero and link like any other. Equal texts and repeated rows share a component;
    they are compared once, as one fingerprint. Rows with a null doc_id get a component, too, null if no doc_id is in it.
    Other columns are not read. An empty table gives no rows.
    """
    own, _ = materialize(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    distinct, _ = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links, path = materialize(near_links(distinct.select("fp"), distinct.count(), radius), "near")
    out = classes(own, distinct, links)
    discard(docs.sparkSession, path)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: About so many texts are read for the order of shingles, and so many of their most frequent shingles are kept.
ORDER_TEXTS, ORDER_SHINGLES = 8000, 1 << 18


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(mark, text) of every row; equal texts have equal marks."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(body).alias("mark"), body.alias("text"))


def _set_id(h: np.ndarray) -> int:
    """A signed number for a set of hashes, ascending."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 11)).view(np.int64))


def frequent(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes, ascending, and counts of the most frequent shingles in about ORDER_TEXTS texts, chosen by a hash."""
    n = max(docs.count(), 1)
    rows = _texts(docs, text).where(F.pmod(F.xxhash64(F.lit(5), "mark"), F.lit(1 << 20)) < min(1.0, ORDER_TEXTS / n) * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                h = np.concatenate(shingles(block_of(part.column("text")), shingle))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["token"])

    tokens = rows.groupBy("mark").agg(F.first("text").alias("text")).select("text").mapInArrow(run, "token long")
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(ORDER_SHINGLES).toArrow()  # at most ORDER_SHINGLES
    token, count = counts["token"].to_numpy().view(np.uint64), counts["n"].to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def prefix(h: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first hashes of a set (ascending), the rare ones before the frequent, that one of any similar set's first must equal."""
    if not len(h):
        return h
    at = lookup(order[0], h)
    by = h[np.argsort(np.where(at >= 0, order[1][at], 0), kind="stable")] if len(order[0]) else h
    return by[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]


def parity(h: np.ndarray) -> bytes:
    """Bit i: whether an odd number of hashes have i as their low bits; at least 256 bits and as many as hashes, a power of two."""
    size = 1 << max(8, int(len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """At most the number of hashes that one of two sets has and the other hasn't, from their parities."""
    x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


#: 64-bit words of a parity that tiles compare.
FOLDED = 4


def folded(x: bytes) -> np.ndarray:
    """FOLDED words of a parity: the parity by fewer bits."""
    return np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, FOLDED), axis=0)


def close(pairs: DataFrame, distinct: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) but for those whose sets' parities differ too much for the similarity: no similar pair goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = (1 - similarity) / (1 + similarity)
        for batch in batches:
            good = [apart(x.as_py(), y.as_py()) <= most * n + 1e-6 for x, y, n in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    end = lambda k, x: distinct.select(F.col("fp").alias(k), F.col("parity").alias(x), F.col("size").alias(f"n{x}"))
    joined = pairs.join(end("a", "x"), "a").join(end("b", "y"), "b").where(F.least("nx", "ny") >= F.lit(similarity) * F.greatest("nx", "ny") - 1e-6)
    return joined.select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("n")).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, distinct: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose sets of shingles have that Jaccard similarity or more, and the path of their table; sets are made
    from the texts again."""
    spark = docs.sparkSession
    pairs, pairs_path = materialize(close(pairs, distinct, similarity), "close")
    ends = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select(F.col("b").alias("fp"))).distinct()
    marks, marks_path = materialize(distinct.select("fp", "mark").join(ends, "fp", "left_semi").select("mark").distinct(), "marks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                found = shingles(block_of(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([pa.array([_set_id(h) for h in found], pa.int64()), pa.array([h.tobytes() for h in found], pa.binary())], ["fp", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both / max(1, len(x) + len(y) - both) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    own = _texts(docs, text).join(marks, "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))
    known, path = materialize(own.select("text").mapInArrow(sets, "fp long, hashes binary").dropDuplicates(["fp"]), "sets")
    joined = pairs.join(known.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), "a").join(known.select(F.col("fp").alias("b"), F.col("hashes").alias("y")), "b")
    out, out_path = materialize(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")
    for done in (path, pairs_path, marks_path):
        discard(spark, done)
    return out, out_path


def may(near: Column, far: Column, similarity: float) -> Column:
    """Whether two sets (size, pos) of which a common shingle is the first can reach the similarity: what follows suffices."""
    need = F.lit(similarity / (1 + similarity)) * (near.size + far.size) - 1e-6
    return F.least(near.size - near.pos, far.size - far.pos) >= need


def candidates(rows: np.ndarray, bounds: np.ndarray, similarity: float, nearest: bool = False, small: int = 32) -> list[tuple[int, int]]:
    """compare for cell_links(): all pairs that may reach the similarity and whose roots differ.

    Columns after fp: root, size of the set, place of the common shingle in it, FOLDED words of its parity. Two parities differ
    in at most as many bits as the sets have shingles apart. Units of up to small rows are compared together, row by row's
    distance; larger ones by tiles, whose pairs are skipped if their population counts lie farther apart than any pair may.
    nearest: only the pair of fewest differing bits for each root in each unit.
    """
    most = (1 - similarity) / (1 + similarity)
    fp, root, size, pos = (rows[:, k] for k in range(4, 8))
    bits = np.ascontiguousarray(rows[:, 8:]).view(np.uint64)
    lengths = np.diff(bounds)
    unit = np.repeat(np.arange(len(lengths)), lengths)
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)]  # both rows, differing bits

    def good(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = size[x] + size[y]
        ok = (root[x] != root[y]) & (np.minimum(size[x] - pos[x], size[y] - pos[y]) >= similarity / (1 + similarity) * both - 1e-6)
        ok &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-6
        differ = np.zeros(ok.shape, np.int64)
        for k in range(bits.shape[1]):
            differ += np.bitwise_count(bits[x, k] ^ bits[y, k])
        return ok & (differ <= most * both + 1e-6), differ

    def least(x: np.ndarray, y: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pair of fewest differing bits for each unit and root."""
        owner, pair = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2)
        order = np.lexsort((pair, differ[pair], root[owner], unit[owner]))
        u, r = unit[owner[order]], root[owner[order]]
        first = np.concatenate([[True], (u[1:] != u[:-1]) | (r[1:] != r[:-1])]) if len(order) else np.zeros(0, bool)
        chosen = np.unique(pair[order[first]])
        return x[chosen], y[chosen], differ[chosen]

    def keep(x: np.ndarray, y: np.ndarray, differ: np.ndarray) -> None:
        found.append(least(x, y, differ) if nearest else (x, y, differ))

    whole = rows[bounds[:-1], 1] == rows[bounds[:-1], 2]
    few = whole & (lengths <= small)
    at = np.flatnonzero(few[unit])
    for d in range(1, small):
        x = at[at + d < len(rows)]
        x = x[unit[x] == unit[x + d]]
        if not len(x):
            break
        ok, differ = good(x, x + d)
        keep(x[ok], x[ok] + d, differ[ok])
    pop = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for u in np.flatnonzero(~few).tolist():
        own = np.arange(bounds[u], bounds[u + 1])
        own = own[np.argsort(pop[own], kind="stable")]
        sides = [own, own] if whole[u] else [own[rows[own, 3] == 0], own[rows[own, 3] == 1]]
        tiles = [[g[i : i + TILE] for i in range(0, len(g), TILE)] for g in sides]
        for i, one in enumerate(tiles[0]):
            for two in tiles[1][i:] if whole[u] else tiles[1]:
                if max(pop[two[0]] - pop[one[-1]], pop[one[0]] - pop[two[-1]]) > most * (size[one].max() + size[two].max()):
                    continue
                ok, differ = good(one[:, None], two[None, :])
                if whole[u] and one is two:
                    ok = np.triu(ok, 1)
                a, b = np.nonzero(ok)
                keep(one[a], two[b], differ[a, b])
    x, y, differ = (np.concatenate(c) for c in zip(*found))
    if nearest:
        x, y, _ = least(x, y, differ)
    return list(zip(np.minimum(fp[x], fp[y]).tolist(), np.maximum(fp[x], fp[y]).tolist()))


def similar_links(own: DataFrame, distinct: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all sets of own (fp, size, tokens) with that Jaccard similarity or more.

    distinct: own's sets once, with mark, size, parity and bits. Sets that are similar share one of their prefixes' shingles.
    First every set is held against the two smallest of those it shares most shingles with. Then, twice, in the cell of every
    shingle that the links don't connect yet, every component against its nearest other; so groups of very many copies are
    one component before, last, all pairs of different components in a cell are.
    """
    spark = docs.sparkSession
    once = own.groupBy("fp").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"))
    rows = once.select("fp", "size", F.posexplode("tokens").alias("pos", "token"))
    # by aggregation and a join rather than a window, so that a shingle of very many sets isn't one task's
    leads = rows.groupBy("token").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead < last").select("token", "lead")
    leads, leads_path = materialize(leads, "leads")
    shared, shared_path = materialize(rows.join(leads, "token"), "shared")
    led = shared.where("fp <> lead").groupBy(F.col("fp").alias("a"), F.col("lead").alias("b")).agg(F.count("*").alias("n"), F.first("size").alias("size"))
    led = led.where(F.col("n") >= F.lit((1 - similarity) / 4) * F.col("size"))  # pairs with less in common are left to the second step
    most = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    led, led_path = materialize(led.withColumn("rank", most).where("rank <= 2").select("a", "b"), "led")
    links, links_path = verified(led, distinct, docs, text, shingle, similarity)
    shared = shared.where("size > 1").select("token", "fp", "size", "pos")
    bits = [f"bits{k}" for k in range(FOLDED)]
    for nearest in (True, True, False):
        roots, roots_path = materialize(components(links), "roots")
        rooted = shared.join(roots, shared.fp == roots.vertex, "left").select("token", "fp", "size", "pos", F.coalesce("root", "fp").alias("root"))
        rooted, rooted_path = materialize(rooted, "rooted")
        mixed, mixed_path = materialize(rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token"), "mixed")
        cells = rooted.join(mixed, "token").join(distinct.select("fp", *bits), "fp").withColumnRenamed("token", "cell")
        found = cell_links(cells.select("cell", "fp", "root", "size", "pos", *bits), ["root", "size", "pos", *bits], partial(candidates, similarity=similarity, nearest=nearest))
        found, found_path = materialize(found.distinct(), "candidates")
        more, more_path = verified(found, distinct, docs, text, shingle, similarity)
        now, now_path = materialize(links.unionAll(more), "links")
        for done in (roots_path, rooted_path, mixed_path, found_path, more_path, links_path):
            discard(spark, done)
        links, links_path = now, now_path
    for done in (leads_path, shared_path, led_path):
        discard(spark, done)
    return links


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Every row's doc_id and component_id, linking texts whose sets of shingles have that Jaccard similarity or more.

    Links are decided exactly, and none is lost (see similar_links). Texts without a word are all alike, as are texts of
    fewer words than a shingle that are equal; nulls and repeats are as in near_duplicates().
    """
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent(docs, text, shingle))  # at most ORDER_SHINGLES
    bits = [f"bits{k}" for k in range(FOLDED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                sets = shingles(block_of(part.column("text")), shingle)
                tokens = [prefix(h, order.value, similarity).view(np.int64) for h in sets]
                parities = [parity(h) for h in sets]
                folds = np.array([folded(x) for x in parities], np.uint64).view(np.int64).reshape(len(sets), FOLDED)
                columns = [part.column(0), part.column(1), pa.array([_set_id(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(parities, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(folds[:, k]) for k in range(FOLDED))], ["doc_id", "mark", "fp", "size", "tokens", "parity", *bits])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    own, own_path = materialize(rows.mapInArrow(run, "doc_id long, mark long, fp long, size long, tokens array<long>, parity binary, " + ", ".join(f"{c} long" for c in bits)), "fingerprints")
    sets = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("mark").alias("mark"), F.first("size").alias("size"), F.first("parity").alias("parity"), *(F.first(c).alias(c) for c in bits))
    distinct, distinct_path = materialize(sets, "distinct")
    out = classes(own.select("doc_id", "fp"), distinct.select("fp", "least"), similar_links(own, distinct, docs, text, shingle, similarity))
    out, _ = materialize(out.select("doc_id", "component_id"), "classes")
    for done in (own_path, distinct_path):
        discard(spark, done)
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar_documents(): the one with the smallest doc_id.

    Of repeated rows with that doc_id the first by a hash of the text, then by the text, stays. Rows without a doc_id all
    stay, since nothing tells them apart. All columns of the input stay as they are.
    """
    found = similar_documents(docs, doc_id, text, shingle, similarity)
    own, rank = unused(docs, "kept"), unused(docs, "rank")
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(keep, F.col(doc_id).cast("long") == F.col(own), "left_semi")
    first = Window.partitionBy(doc_id).orderBy(F.xxhash64(text), text)
    once = kept.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return once.unionByName(docs.where(F.col(doc_id).isNull()))
