"""Random values. rand() is drawn once for each row and call; nothing here depends on the masked value but random_hash."""

from __future__ import annotations

from ..errors import InvalidExpression
from ..sqltext import literal, unliteral
from .base import Context, mask_function
from .ranges import Bounds, parse_range


def integer(low: str, high: str) -> str:
    """Uniform from low to high, both included."""
    return f"(CAST({low} AS bigint) + CAST(floor(rand() * (CAST({high} AS bigint) - CAST({low} AS bigint) + 1)) AS bigint))"


def pick(values: list[str]) -> str:
    """One of the values."""
    return f"element_at(array({', '.join(map(literal, values))}), CAST(floor(rand() * {len(values)}) AS int) + 1)" if len(values) > 1 else literal(values[0])


def digits(template: str) -> str:
    """The template with each # as a digit and each ^ as a digit from 1."""
    parts, text = [], ""
    for c in template:
        if c in "#^":
            if text:
                parts.append(literal(text))
                text = ""
            parts.append("CAST(CAST(floor(rand() * 10) AS int) AS string)" if c == "#" else "CAST(CAST(1 + floor(rand() * 9) AS int) AS string)")
        else:
            text += c
    if text or not parts:
        parts.append(literal(text))
    return f"concat({', '.join(parts)})"


@mask_function("random", deterministic=False)
def random(ctx: Context) -> str:
    return "rand()"


@mask_function("random_time", deterministic=False)
def random_time(ctx: Context) -> str:
    return "date_format(timestamp_seconds(CAST(floor(rand() * 86400) AS bigint)), 'HH:mm:ss')"


@mask_function("random_date", deterministic=False)
def random_date(ctx: Context) -> str:
    """A moment from 1900 to now."""
    return "timestamp_seconds(-2208988800 + CAST(floor(rand() * (unix_timestamp(current_timestamp()) + 2208988800)) AS bigint))"


@mask_function("random_date_between", args=(2, 2), deterministic=False)
def random_date_between(ctx: Context, low: str, high: str) -> str:
    low, high = f"unix_micros(CAST({low} AS timestamp))", f"unix_micros(CAST({high} AS timestamp))"
    return f"timestamp_micros({low} + CAST(floor(rand() * ({high} - {low})) AS bigint))"


def _within(kind: str):
    @mask_function(f"random_in_{kind}", args=(1, 1), deterministic=False)
    def draw(ctx: Context, arg: str) -> str:
        """Uniform in the range; NULL if it is empty or unbounded."""
        b: Bounds = parse_range(arg, kind)
        if b.lower is None or b.upper is None:
            return f"CAST(NULL AS {b.spark_type})"
        if b.spark_type in ("int", "bigint"):
            drawn = f"CAST({b.lower} + CAST(floor(rand() * (CAST({b.upper} AS double) - {b.lower})) AS bigint) AS {b.spark_type})"
        elif b.spark_type == "double":
            drawn = f"({b.lower} + rand() * ({b.upper} - {b.lower}))"
        elif b.spark_type == "date":
            drawn = f"date_add({b.lower}, CAST(floor(rand() * datediff({b.upper}, {b.lower})) AS int))"
        else:
            low, high = f"unix_micros(CAST({b.lower} AS timestamp))", f"unix_micros(CAST({b.upper} AS timestamp))"
            drawn = f"CAST(timestamp_micros({low} + CAST(floor(rand() * ({high} - {low})) AS bigint)) AS {b.spark_type})"
        return f"CASE WHEN {b.lower} < {b.upper} THEN {drawn} END"


for _kind in ("int4range", "int8range", "numrange", "daterange", "tsrange", "tstzrange"):
    _within(_kind)


@mask_function("random_int_between", args=(2, 2), deterministic=False)
def random_int_between(ctx: Context, low: str, high: str) -> str:
    return f"CAST({integer(low, high)} AS int)"


@mask_function("random_bigint_between", args=(2, 2), deterministic=False)
def random_bigint_between(ctx: Context, low: str, high: str) -> str:
    return integer(low, high)


@mask_function("random_double_precision", args=(2, 2), deterministic=False)
def random_double_precision(ctx: Context, low: str, high: str) -> str:
    return f"(CAST({low} AS double) + rand() * (CAST({high} AS double) - CAST({low} AS double)))"


@mask_function("random_real", args=(2, 2), deterministic=False)
def random_real(ctx: Context, low: str, high: str) -> str:
    return f"CAST({random_double_precision(ctx, low, high)} AS float)"


@mask_function("random_number_with_format", "random_phone_with_format", args=(1, 1), deterministic=False)
def random_number_with_format(ctx: Context, template: str) -> str:
    text = unliteral(template)
    if text is None:
        raise InvalidExpression("the format must be a string constant")
    return digits(text)


@mask_function("random_phone", "plop", args=(0, 1), deterministic=False)
def random_phone(ctx: Context, prefix: str = "'0'") -> str:
    """The prefix and nine digits."""
    return f"concat({prefix}, {digits('#########')})"


@mask_function("random_zip", deterministic=False)
def random_zip(ctx: Context) -> str:
    return digits("#####")


@mask_function("random_string", args=(1, 1), deterministic=False)
def random_string(ctx: Context, length: str) -> str:
    """Letters and digits: so many, or as many as a range draws."""
    if length.strip().isdigit():
        return f"randstr({int(length)})" if int(length) else "''"
    b = parse_range(length, "int4range")
    if b.lower is None or b.upper is None:
        raise InvalidExpression("the range of lengths must have bounds")
    return f"substring(randstr(CAST({b.upper} - 1 AS int)), 1, CAST({b.lower} + CAST(floor(rand() * ({b.upper} - {b.lower})) AS int) AS int))"


@mask_function("random_id", deterministic=False)
def random_id(ctx: Context) -> str:
    """Unique in a table, from a random start."""
    import random as chance

    return f"({chance.randrange(1 << 40)}L + monotonically_increasing_id())"


#: The hidden column of consecutive row numbers that bounded ids are made of.
ROW_NUMBER = "__row_number"


def _bounded(name: str, most: int, kind: str):
    @mask_function(*name.split(), deterministic=False)
    def draw(ctx: Context) -> str:
        """Unique among so many rows as the type has positive values."""
        import random as chance

        ctx.row_numbers.add(ROW_NUMBER)
        return f"CAST(pmod({chance.randrange(most)}L + {ROW_NUMBER}, {most}L) AS {kind})"


_bounded("random_id_int", 2147483647, "int")
_bounded("random_id_smallint random_id_small_int", 32767, "smallint")


@mask_function("random_in", args=(1, 1), deterministic=False)
def random_in(ctx: Context, array: str) -> str:
    if array.upper().startswith("ARRAY") and "[" in array[:7]:  # ARRAY['a', 'b']
        array = "array(" + array[array.index("[") + 1 : array.rindex("]")] + ")"
    return f"element_at({array}, CAST(floor(rand() * size({array})) AS int) + 1)"


@mask_function("random_in_enum", args=(1, 1), deterministic=False)
def random_in_enum(ctx: Context, value: str) -> str:
    """Any value of the enumeration declared for the column."""
    name = value.strip("`").lower()
    if name not in ctx.enums:
        raise InvalidExpression(f"no enumeration is declared for {value}")
    return pick(ctx.enums[name])
