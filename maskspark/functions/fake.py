"""Fake values, drawn at random from dictionaries."""

from __future__ import annotations

from .base import Context, mask_function


def _fake(kind: str):
    @mask_function(f"fake_{kind}", deterministic=False)
    def fake(ctx: Context) -> str:
        values = ctx.dictionaries.values(kind)
        if values is None:
            return ctx.dictionaries.notice()
        return f"element_at({ctx.dictionaries.array(kind)}, CAST(floor(rand() * {len(values)}) AS int) + 1)"


for _kind in ("first_name", "last_name", "email", "address", "city", "company", "country", "iban", "postcode", "siret"):
    _fake(_kind)


def _named(args: tuple[str, ...]) -> dict[str, str]:
    """Arguments by position or name := value."""
    out = {}
    for name, arg in zip(("paragraphs", "words", "characters"), args):
        key, sep, value = arg.partition("=>") if "=>" in arg else arg.partition(": =") if ": =" in arg else ("", "", arg)
        out[key.strip() if sep else name] = value.strip()
    return out


@mask_function("lorem_ipsum", args=(0, 3), deterministic=False)
def lorem_ipsum(ctx: Context, *args: str) -> str:
    """So many characters, or words, or else paragraphs (5) of shuffled text."""
    if ctx.dictionaries.values("lorem_ipsum") is None:
        return ctx.dictionaries.notice()
    given = _named(args)
    text = f"shuffle({ctx.dictionaries.array('lorem_ipsum')})"
    if given.get("characters", "0") != "0":
        n = given["characters"]
        return f"substring(array_join({text}, '\\n'), 1, {n})"
    if given.get("words", "0") != "0":
        return f"array_join(slice(split(array_join({text}, ' '), ' '), 1, {given['words']}), ' ')"
    return f"array_join(slice({text}, 1, {given.get('paragraphs', '5')}), '\\n')"
