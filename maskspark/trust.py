"""Which functions masking rules may call."""

from __future__ import annotations

from .errors import InvalidExpression
from .functions import FUNCTIONS
from .registry import DEFAULT_POLICY, Registry
from .sqltext import Token, calls, split_call, tokens

#: Host functions that are trusted one by one.
TRUSTED_BUILTINS = frozenset(
    "array_to_json age btrim concat date_part date_trunc json_build_array jsonb_build_array json_build_object jsonb_build_object json_object jsonb_object left length lower ltrim "
    "make_date make_time md5 now random regexp_replace repeat replace right row_to_json rtrim substr to_char to_date to_json to_jsonb to_number to_timestamp upper".split()
)
#: Constructors that are values rather than functions.
CONSTRUCTORS = frozenset("int4range int8range numrange daterange tsrange tstzrange cast array coalesce nullif".split())
HOST, OWN = "pg_catalog", "anon"


def reason(registry: Registry, path: tuple[str, ...], restrict: bool) -> str | None:
    """Why a rule may not call a function; None if it may."""
    shown = ".".join(path)
    if len(path) == 1:
        return None if path[0] in CONSTRUCTORS else f"{shown} is not qualified"
    schema, name = path[-2:]
    declared = registry.functions.get(DEFAULT_POLICY, {}).get((schema, name))
    if declared is False:
        return f"{shown} is UNTRUSTED"
    if declared or schema in registry.schemas.get(DEFAULT_POLICY, ()):
        return None
    if schema == OWN:
        return None if name in FUNCTIONS else f"{shown} is UNTRUSTED"
    if schema == HOST and name in TRUSTED_BUILTINS:
        return None
    return f"{shown} does not belong in a TRUSTED schema" if restrict else None


def check_call(registry: Registry, text: str, restrict: bool) -> None:
    """text must be one call, with every call in it trusted."""
    ts = tokens(text)
    if not ts:
        raise InvalidExpression("Expression is empty")
    found = split_call(ts)
    if not found or found[1] != len(ts):
        raise InvalidExpression(f"{text} is not a valid function call" if found else f"{text} is not a function")
    for call in calls(ts):
        why = reason(registry, call.path, restrict)
        if why and (restrict or "UNTRUSTED" in why or "qualified" in why):
            raise InvalidExpression(why)


def check_value(spark, text: str) -> None:
    """text must be a constant or a column."""
    ts = tokens(text)
    bad = InvalidExpression(f"{text.strip()} is not a valid expression for a masking value")
    if not ts or any(True for _ in calls(ts)) or ";" in [t.text for t in ts]:
        raise bad
    node = parsed(spark, " ".join(t.text for t in ts))
    if node not in ("Literal", "UnresolvedAttribute", "UnaryMinus"):
        raise bad


def parsed(spark, text: str) -> str:
    """The kind of expression that Spark's parser sees."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parseExpression(text).getClass().getSimpleName()
    except Exception as e:
        raise InvalidExpression(f"{text} is not a valid expression") from e


def function_schema(text: str) -> str:
    """The schema of a call, or '' if it isn't qualified."""
    ts: list[Token] = tokens(text)
    if not ts:
        raise InvalidExpression("function call is empty")
    found = split_call(ts)
    if not found or found[1] != len(ts):
        raise InvalidExpression(f"'{text}' is not a valid function call")
    return found[0].path[-2] if len(found[0].path) > 1 else ""
