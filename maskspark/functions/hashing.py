"""Hashes, and pseudonyms drawn from dictionaries by a hash of a seed."""

from __future__ import annotations

from ..sqltext import literal, unliteral
from .base import Context, mask_function

#: Algorithms; any other gives NULL.
ALGORITHMS = {"md5": "md5({0})", "sha224": "sha2({0}, 224)", "sha256": "sha2({0}, 256)", "sha384": "sha2({0}, 384)", "sha512": "sha2({0}, 512)"}


def digest_sql(value: str, salt: str, algorithm: str) -> str:
    text = f"concat(CAST({value} AS string), CAST({salt} AS string))"
    name = unliteral(algorithm)
    if name is not None:
        return ALGORITHMS[name].format(text) if name in ALGORITHMS else "CAST(NULL AS string)"
    return "CASE " + algorithm + " " + " ".join(f"WHEN '{k}' THEN {v.format(text)}" for k, v in ALGORITHMS.items()) + " END"


@mask_function("digest", args=(3, 3))
def digest(ctx: Context, value: str, salt: str, algorithm: str) -> str:
    """Hexadecimal hash of the value's and the salt's UTF-8 bytes."""
    return digest_sql(value, salt, algorithm)


@mask_function("hash", args=(1, 1))
def hashed(ctx: Context, value: str) -> str:
    """digest() with the engine's salt and algorithm."""
    return digest_sql(value, literal(ctx.conf.salt), literal(ctx.conf.algorithm))


@mask_function("random_hash", args=(1, 1), deterministic=False)
def random_hash(ctx: Context, seed: str) -> str:
    """digest() with a random salt of six characters."""
    return digest_sql(seed, "randstr(6)", literal(ctx.conf.algorithm))


@mask_function("hex_to_int", args=(1, 1))
def hex_to_int(ctx: Context, text: str) -> str:
    return f"CAST(CAST(conv({text}, 16, 10) AS bigint) AS int)"


def projection_sql(seed: str, salt: str, last: str) -> str:
    """round(last * p / (2^24 - 1)) for p the first six hexadecimal digits of the MD5, in whole numbers alone."""
    part = f"CAST(conv(left(md5(concat(CAST({seed} AS string), {salt})), 6), 16, 10) AS bigint)"
    return f"CAST((2 * CAST({last} AS bigint) * {part} + 16777215) div 33554430 AS int)"


@mask_function("projection_to_oid", args=(3, 3))
def projection_to_oid(ctx: Context, seed: str, salt: str, last: str) -> str:
    """A number from 0 to last by the first 24 bits of the MD5 of seed and salt."""
    return projection_sql(seed, salt, last)


def _pseudo(kind: str):
    @mask_function(f"pseudo_{kind}", args=(1, 2))
    def pseudo(ctx: Context, seed: str, salt: str | None = None) -> str:
        values = ctx.dictionaries.values(kind)
        if values is None:
            return ctx.dictionaries.notice()
        return f"element_at({ctx.dictionaries.array(kind)}, {projection_sql(seed, salt or literal(ctx.conf.salt), str(len(values) - 1))} + 1)"


for _kind in ("first_name", "last_name", "email", "city", "country", "company", "iban", "siret"):
    _pseudo(_kind)
