"""Vectorised words: finds and hashes all words of a block of texts with numpy, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers = np.ones(1, dtype=np.uint64)


def byte_table(rule) -> np.ndarray:
    """256 entries: rule(byte)."""
    return np.array([rule(b) for b in range(256)])


#: A-Z become a-z, all other bytes stay.
LOWER = byte_table(lambda b: b + 32 if 65 <= b <= 90 else b).astype(np.uint8)
#: Letters, digits and all bytes of characters beyond ASCII.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128).astype(bool)


@dataclass
class Block:
    """Bytes of some texts one after another; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].tobytes().decode("utf-8", "replace")


def block_of(texts: pa.Array) -> Block:
    """The buffers of an Arrow string array as numpy arrays; null texts are empty."""
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or data is None:
        return Block(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    at = np.frombuffer(offsets, dtype=width)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return Block(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0])


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of members that don't cross texts: starts, ends, and the text that each belongs to."""
    n = len(member)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = member.copy()
    first[1:] &= ~member[:-1]
    last = member.copy()
    last[:-1] &= ~member[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = member[inner]
    last[inner - 1] = member[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]).astype(np.uint64)
            np.multiply.accumulate(_powers, out=_powers)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; spans are ascending, disjoint and not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    edges = np.cumsum(lengths) - lengths
    within = np.arange(total, dtype=np.int64) - np.repeat(edges, lengths)
    chars = data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        chars *= _power(int(lengths.max()))[within]
        return mix(np.add.reduceat(chars, edges) + lengths.astype(np.uint64))


def hash_of(word: str) -> np.uint64:
    """hashes() for one word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return hashes(data, np.array([0]), np.array([len(data)]))[0]


#: Everything but ASCII white space.
INK = byte_table(lambda b: b not in b" \t\n\v\f\r").astype(bool)


def shingles(block: Block, size: int) -> list[np.ndarray]:
    """For each text the hashes of its distinct shingles of size words, ascending; A-Z count as a-z. A text of fewer words has
    one shingle, one without words none."""
    n = len(block.offsets) - 1
    low = LOWER[block.data] if len(block.data) else block.data
    a, z, t = spans(INK[low] if len(low) else np.zeros(0, bool), block.offsets)
    h = hashes(low, a, z)
    counts = np.bincount(t, minlength=n) if len(t) else np.zeros(n, np.int64)
    begins = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for j in range(size):
            whole = whole * np.uint64(_BASE) + h[j : j + len(whole)]
        whole = mix(whole + np.uint64(size))
        out = []
        for first, k in zip(begins.tolist(), counts.tolist()):
            if k >= size:
                out.append(np.unique(whole[first : first + k - size + 1]))
            elif k:
                one = np.uint64(0)
                for word in h[first : first + k]:
                    one = one * np.uint64(_BASE) + word
                out.append(mix(np.array([one + np.uint64(k)])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
