"""Token ids by the tokenizers library, memoised by chunk between white space.

The word vocabulary drops white space and merges within words only, so a text's ids are the ids of its chunks one after
another. Rare chunks go to the library; frequent ones cost a dictionary lookup. Any tokenizer whose specification is not
known to allow that, patterns and added tokens included, gets whole texts.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from functools import lru_cache

from tokenizers import Tokenizer

#: The only normaliser and pre-tokeniser whose ids are known to be a function of each chunk, as the file has them.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}
#: Chunks whose parts can be told without the library: letters that NFC and lower case treat one by one, digits, ASCII signs.
_PLAIN = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ!-&(-/:;=?-@\[-`{}~]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
#: Entries of a generation, of chunks and of parts, and the length of each at most. An encoder keeps two generations of each.
#: Most chunks never come again, so only what is met a second time is kept, by a byte for each of SEEN hashes, which starts anew
#: with a generation. What isn't kept costs time only.
CACHE, CACHE_LENGTH, SEEN = 1 << 17, 64, 1 << 21


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: printable Latin-1 as it is, the others from U+0100 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(kept))}


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def by_chunks(spec: dict) -> bool:
    """Whether a tokenizer file's ids are those of a text's chunks one after another.

    Added tokens must lie within a chunk, and none may consist of characters alone that are told apart without the library.
    """
    model = spec["model"]
    same = (spec.get("normalizer"), spec.get("pre_tokenizer")) == (_NORMALIZER, _PRE_TOKENIZER)
    plain = not any((spec.get("post_processor"), spec.get("truncation"), spec.get("padding"), model.get("dropout"), model.get("continuing_subword_prefix")))
    added = all(
        t["content"] and not re.search(r"\s", t["content"]) and not _PLAIN.fullmatch(t["content"]) and not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        for t in spec.get("added_tokens", [])
    )
    return same and plain and model["type"] == "BPE" and added


class Encoder:
    """Text to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = by_chunks(spec)
        self.model = self.tokenizer.model
        if self.chunked:
            self.model._resize_cache(0)
        self.letters = str.maketrans(_byte_letters())
        self.chunks: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_chunks: dict[bytes, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        self.seen_chunks, self.seen_parts = bytearray(SEEN), bytearray(SEEN)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        """What _chunk() didn't find among the newer parts."""
        got = self.older_parts.get(part)
        if got is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = packed([t.id for t in self.model.tokenize(spelled)])
        at = hash(part) & (SEEN - 1)
        if not self.seen_parts[at]:
            self.seen_parts[at] = 1
        elif len(part) <= CACHE_LENGTH:
            if len(self.parts) >= CACHE:
                self.older_parts, self.parts, self.seen_parts = self.parts, {}, bytearray(SEEN)
            self.parts[part] = got
        return got

    def _chunk(self, chunk: bytes) -> bytes:
        """What encode() didn't find among the newer chunks."""
        got = self.older_chunks.get(chunk)
        if got is None:
            text = chunk.decode()
            if _PLAIN.fullmatch(text):
                got = b"".join([self.parts.get(p) or self._part(p) for p in _PARTS.findall(text.lower())])
            else:
                got = self.whole(text)
        at = hash(chunk) & (SEEN - 1)
        if not self.seen_chunks[at]:
            self.seen_chunks[at] = 1
        elif len(chunk) <= CACHE_LENGTH:
            if len(self.chunks) >= CACHE:
                self.older_chunks, self.seen_chunks = dict(self.chunks), bytearray(SEEN)
                self.chunks.clear()  # encode() has its method
            self.chunks[chunk] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.chunked:
            return self.whole(text)
        chunks, get = text.encode().split(), self.chunks.get
        return b"".join([get(c) or self._chunk(c) for c in chunks])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary. It stays while the worker serves other stages, so it has to be small."""
    return Encoder(path)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
