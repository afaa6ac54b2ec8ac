"""A tokenizer for SQL expressions: finds calls and their arguments, and brings foreign spellings into Spark's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .errors import InvalidExpression

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$(?P<body>.*?)\$(?P=tag)\$)
    |(?P<string>[eE]?'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?:[bB][dD]|[lLsSyYdDfF])?\b)
    |(?P<word>[A-Za-z_][A-Za-z0-9_$]*)
    |(?P<sign>::|->>|->|<=|>=|<>|!=|\|\||=>|.)""",
    re.X | re.S,
)

#: Type names of other databases and Spark's.
TYPES = {
    "text": "string", "bpchar": "string", "name": "string", "citext": "string", "uuid": "string", "inet": "string", "json": "string", "jsonb": "string", "xml": "string",
    "int2": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "float4": "float", "real": "float", "float8": "double", "numeric": "decimal(38,10)",
    "bool": "boolean", "bytea": "binary", "timestamptz": "timestamp", "regclass": "string", "oid": "bigint",
}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str


def literal(value) -> str:
    """A Python value as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def unliteral(text: str) -> str | None:
    """The value of a Spark SQL string literal, or None if text is anything else."""
    text = text.strip()
    if len(text) < 2 or text[0] != "'" or text[-1] != "'":
        return None
    body, out, i = text[1:-1], [], 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            i += 1
        elif body[i] == "'":
            return None
        out.append(body[i])
        i += 1
    return "".join(out)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tokens(text: str) -> list[Token]:
    """Tokens without white space and comments; strings as Spark literals, quoted names in backticks."""
    out = []
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("tag", "body") else "dollar"
        value = m[0]
        if kind == "space":
            continue
        if kind == "dollar":
            kind, value = "string", literal(m["body"])
        elif kind == "string":
            raw = value[value.index("'") + 1 : -1].replace("''", "'")
            value = literal(raw.encode().decode("unicode_escape") if value[0] in "eE" else raw)
        elif kind == "quoted" and value[0] == '"':
            value = quote(value[1:-1].replace('""', '"'))
        out.append(Token(kind, value))
    return out


def names(text: str) -> list[str]:
    """The parts of a qualified name; parts without quotes are lower-cased."""
    parts, expect = [], True
    for t in tokens(text):
        if t.text == "." and not expect:
            expect = True
        elif expect and t.kind in ("word", "quoted"):
            parts.append(t.text.lower() if t.kind == "word" else t.text[1:-1].replace("``", "`"))
            expect = False
        else:
            raise InvalidExpression(f"'{text}' is not a valid name")
    if expect:
        raise InvalidExpression(f"'{text}' is not a valid name")
    return parts


@dataclass(frozen=True)
class Call:
    path: tuple[str, ...]
    args: tuple[tuple[Token, ...], ...]


def split_call(ts: list[Token]) -> tuple[Call, int] | None:
    """The call that begins with the first token, and how many tokens it takes; None if there is none."""
    path, i = [], 0
    while i < len(ts) and ts[i].kind in ("word", "quoted"):
        path.append(ts[i].text.lower() if ts[i].kind == "word" else ts[i].text[1:-1])
        i += 1
        if i < len(ts) and ts[i].text == ".":
            i += 1
            continue
        break
    if not path or i >= len(ts) or ts[i].text != "(" or ts[i - 1].text == ".":
        return None
    depth, args, now = 0, [], []
    for j in range(i, len(ts)):
        t = ts[j]
        if t.text in "([" and t.kind == "sign":
            depth += 1
            if depth == 1:
                continue
        elif t.text in ")]" and t.kind == "sign":
            depth -= 1
            if depth == 0:
                if now or args:
                    args.append(tuple(now))
                return Call(tuple(path), tuple(args)), j + 1
        elif t.text == "," and depth == 1:
            args.append(tuple(now))
            now = []
            continue
        now.append(t)
    raise InvalidExpression("a parenthesis isn't closed")


#: Words that look like calls but are grammar.
_GRAMMAR = {"in", "and", "or", "not", "case", "when", "then", "else", "over", "values", "exists", "any", "all", "interval", "as", "using", "between", "like", "is"}


def calls(ts: list[Token]) -> Iterator[Call]:
    """All calls in the tokens, outer ones first."""
    i = 0
    while i < len(ts):
        after_dot = i and ts[i - 1].text == "."
        found = split_call(ts[i:]) if ts[i].kind in ("word", "quoted") and not after_dot else None
        if found and not (len(found[0].path) == 1 and found[0].path[0] in _GRAMMAR) and not _typed(ts, i):
            yield found[0]
            for arg in found[0].args:
                yield from calls(list(arg))
            i += found[1]
        else:
            i += 1


def _typed(ts: list[Token], i: int) -> bool:
    """Whether the word at i names a type: it stands after :: or, in a cast, after AS."""
    return i > 0 and (ts[i - 1].text == "::" or ts[i - 1].text.lower() == "as")


def render(ts: list[Token], build: Callable[[Call], str | None]) -> str:
    """Spark SQL of the tokens; build gives the SQL of a call, or None to keep it as it is."""
    out: list[str] = []
    i = 0
    while i < len(ts):
        t = ts[i]
        after_dot = i and ts[i - 1].text == "."
        if t.kind in ("word", "quoted") and not after_dot:
            if t.kind == "word" and _typed(ts, i) and t.text.lower() in TYPES:
                sized = i + 1 < len(ts) and ts[i + 1].text == "("
                out.append("decimal" if sized and t.text.lower() == "numeric" else TYPES[t.text.lower()])
                i += 1
                continue
            found = split_call(ts[i:])
            if found and not (len(found[0].path) == 1 and found[0].path[0] in _GRAMMAR) and not _typed(ts, i):
                call, used = found
                text = build(call)
                if text is None:
                    inner = [render(list(a), build) for a in call.args]
                    text = ".".join(quote(p) if not re.fullmatch(r"\w+", p) else p for p in call.path) + "(" + ", ".join(inner) + ")"
                if out and out[-1] not in (".", "::", "("):
                    out.append(" ")
                out.append(text)
                i += used
                continue
        glue = t.text in (".", "::", ")", ",") or (out and out[-1] in (".", "::", "("))
        if out and not glue:
            out.append(" ")
        out.append(t.text)
        i += 1
    return "".join(out)
