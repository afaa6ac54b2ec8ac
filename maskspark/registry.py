"""The rule catalogue: tables, policies, rules, roles, trust."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .errors import InsufficientPrivilege, InvalidLabel, LabelNotSupported, UnknownObject
from .sqltext import names

DEFAULT_POLICY, DEFAULT_SCHEMA = "anon", "public"
#: The grammar of labels.
GRAMMAR = {
    "function": re.compile(r"\s*MASKED\s+WITH\s+FUNCTION\s+(.*\S)\s*", re.I | re.S),
    "value": re.compile(r"\s*MASKED\s+WITH\s+VALUE\s+(.*)", re.I | re.S),
    "not_masked": re.compile(r"\s*NOT\s+MASKED\s*", re.I),
    "masked": re.compile(r"\s*MASKED\s*", re.I),
    "trusted": re.compile(r"\s*TRUSTED\s*", re.I),
    "untrusted": re.compile(r"\s*UNTRUSTED\s*", re.I),
    "sample": re.compile(r"\s*TABLESAMPLE\s+(.*\S)\s*", re.I | re.S),
    "identifier": re.compile(r"\s*(QUASI|INDIRECT)\s+IDENTIFIER\s*", re.I),
}
SAMPLE = re.compile(r"(BERNOULLI|SYSTEM)\s*\(\s*(\d+(?:\.\d+)?)\s*\)(?:\s*REPEATABLE\s*\(\s*(\d+)\s*\))?", re.I)


@dataclass(frozen=True)
class Rule:
    """kind: function, value or not_masked; text: the call or the value."""

    kind: str
    text: str = ""


@dataclass(frozen=True)
class Sample:
    """A share of the rows (0 to 1) and a seed."""

    method: str
    share: float
    seed: int | None = None


@dataclass
class Table:
    """Where a relation's rows come from, and what Parquet can't say about its columns."""

    name: tuple[str, str]
    read: Callable[[], DataFrame]
    defaults: dict[str, str] = field(default_factory=dict)
    generated: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    enums: dict[str, list[str]] = field(default_factory=dict)
    row_policies: list[tuple[str, frozenset[str] | None]] = field(default_factory=list)
    is_view: bool = False
    path: str | None = None
    fmt: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)
    partitions: list[str] = field(default_factory=list)

    @property
    def sql_name(self) -> str:
        return ".".join(self.name)


def table_name(text: str) -> tuple[str, str]:
    parts = names(text)
    if len(parts) > 2:
        parts = parts[-2:]
    return (DEFAULT_SCHEMA, parts[0]) if len(parts) == 1 else (parts[0], parts[1])


class Registry:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[tuple[str, str], Table] = {}
        self.rules: dict[str, dict[tuple[tuple[str, str], str], Rule]] = {}
        self.samples: dict[str, dict[tuple[str, str] | None, Sample]] = {}
        self.roles: dict[str, set[str]] = {}
        self.masked_roles: dict[str, dict[str, bool]] = {}
        self.functions: dict[str, dict[tuple[str, str], bool]] = {}
        self.schemas: dict[str, set[str]] = {}
        self.identifiers: dict[str, dict[tuple[tuple[str, str], str], str]] = {}
        self.user_functions: dict[tuple[str, str], Callable[..., str]] = {}

    def table(self, text: str | tuple[str, str]) -> Table:
        key = text if isinstance(text, tuple) else table_name(text)
        if key not in self.tables:
            raise UnknownObject(f'relation "{".".join(key)}" does not exist')
        return self.tables[key]

    def column(self, text: str) -> tuple[Table, str]:
        parts = names(text)
        if len(parts) < 2:
            raise UnknownObject(f"{text} doesn't name a table and a column")
        table = self.table(tuple(parts[-3:-1]) if len(parts) > 2 else (DEFAULT_SCHEMA, parts[0]))
        for c in table.read().columns:
            if c == parts[-1] or c.lower() == parts[-1]:
                return table, c
        raise UnknownObject(f'column "{parts[-1]}" of relation "{table.sql_name}" does not exist')

    def clear_object(self, policy: str, kind: str, name: str) -> None:
        if kind == "COLUMN":
            table, column = self.column(name)
            self.rules.get(policy, {}).pop((table.name, column), None)
            self.identifiers.get(policy, {}).pop((table.name, column), None)
        elif kind == "TABLE":
            self.samples.get(policy, {}).pop(table_name(name), None)
        elif kind == "DATABASE":
            self.samples.get(policy, {}).pop(None, None)
        elif kind == "ROLE":
            self.masked_roles.get(policy, {}).pop(name, None)
        elif kind == "FUNCTION":
            self.functions.get(policy, {}).pop(tuple(names(name)[-2:]), None)
        elif kind == "SCHEMA":
            self.schemas.get(policy, set()).discard(names(name)[-1])

    def put(self, policy: str, kind: str, name: str, text: str | None, superuser: bool, check) -> None:
        """Store a label; text None removes it. check: validates a rule's expression, given its kind and text."""
        kind = kind.upper()
        if text is None:
            self.clear_object(policy, kind, name)
            return
        match = lambda k: GRAMMAR[k].fullmatch(text)
        if kind == "COLUMN":
            table, column = self.column(name)
            if m := match("function"):
                rule = Rule("function", m[1])
            elif m := match("value"):
                rule = Rule("value", m[1])
            elif match("not_masked"):
                rule = Rule("not_masked")
            else:
                raise InvalidLabel(text, "column")
            check(rule, table)
            self.rules.setdefault(policy, {})[table.name, column] = rule
        elif kind in ("TABLE", "DATABASE"):
            m = match("sample")
            s = SAMPLE.fullmatch(m[1]) if m else None
            if not s or not 0 <= float(s[2]) <= 100:
                raise InvalidLabel(text, kind.lower())
            key = self.table(name).name if kind == "TABLE" else None
            self.samples.setdefault(policy, {})[key] = Sample(s[1].upper(), float(s[2]) / 100, int(s[3]) if s[3] else None)
        elif kind == "ROLE":
            if not match("masked"):
                raise InvalidLabel(text, "role")
            self.roles.setdefault(name, set())
            self.masked_roles.setdefault(policy, {})[name] = True
        elif kind in ("FUNCTION", "SCHEMA"):
            if not superuser:
                raise InsufficientPrivilege(f"only a superuser can set an anon label for a {kind.lower()}")
            trusted, untrusted = match("trusted"), match("untrusted")
            if not trusted and not (untrusted and kind == "FUNCTION"):
                raise InvalidLabel(text, kind.lower())
            if kind == "FUNCTION":
                self.functions.setdefault(policy, {})[tuple(names(name.split("(")[0])[-2:])] = bool(trusted)
            else:
                self.schemas.setdefault(policy, set()).add(names(name)[-1])
        else:
            raise LabelNotSupported("Anon: Labeling this object is not supported")

    def put_identifier(self, provider: str, kind: str, name: str, text: str | None) -> None:
        if kind.upper() != "COLUMN":
            raise LabelNotSupported("Placing a k_anonymity label on this object is not supported")
        if text is None:
            self.clear_object(provider, "COLUMN", name)
            return
        m = GRAMMAR["identifier"].fullmatch(text)
        if not m:
            raise InvalidLabel(text, "column")
        table, column = self.column(name)
        self.identifiers.setdefault(provider, {})[table.name, column] = m[1].upper()

    def sample(self, table: tuple[str, str], policy: str) -> Sample | None:
        """The table's ratio, else the database's."""
        own = self.samples.get(policy, {})
        return own.get(table) or own.get(None)

    def rename_table(self, old: str, new: str) -> None:
        a, b = self.table(old).name, table_name(new)
        self.tables[b] = self.tables.pop(a)
        self.tables[b].name = b
        for by in (*self.rules.values(), *self.identifiers.values()):
            for t, c in [k for k in by if k[0] == a]:
                by[b, c] = by.pop((t, c))
        for own in self.samples.values():
            if a in own:
                own[b] = own.pop(a)

    def drop_table(self, name: str) -> None:
        key = self.table(name).name
        del self.tables[key]
        for by in (*self.rules.values(), *self.identifiers.values()):
            for k in [k for k in by if k[0] == key]:
                del by[k]
        for own in self.samples.values():
            own.pop(key, None)
