"""Rewrites a masked role's SQL: every table becomes its masked form before Spark analyses the text.

Spark's parser gives the unresolved plan; every relation in it knows its place in the text. Walking the plan with the
scopes of common table expressions tells tables from such names. What isn't a query over known tables is refused. So are
variables, which the parser would substitute before it counts places. The rewritten text is parsed and walked once more, and
runs only if every relation left in it is one of the masked views made for it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from ..errors import InsufficientPrivilege
from ..sqltext import quote

#: Roots and inner nodes of plans that only read.
READS = frozenset(
    "Project Sort GlobalLimit LocalLimit Limit Offset Aggregate UnresolvedHaving Distinct Union Except Intersect UnresolvedWith SubqueryAlias UnresolvedSubqueryColumnAliases Filter Join "
    "WithWindowDefinition UnresolvedInlineTable InlineTable LocalRelation OneRowRelation Pivot Unpivot Generate LateralJoin Sample UnresolvedRelation UnresolvedTableValuedFunction Expand "
    "Window SetOperation Deduplicate UnresolvedTVFAliases".split()
)
#: Functions that reach beyond the tables.
DENIED = frozenset("reflect java_method try_reflect read_files input_file_name input_file_block_start input_file_block_length current_catalog sql_keywords".split())
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple".split())


#: The keyword of TABLE name, with white space and comments up to the name.
_TABLE = re.compile(r"\bTABLE(?:\s|/\*(?:(?!\*/).)*\*/|--[^\n]*\n)+\Z", re.I | re.S)


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


class Finder:
    """Relations of a parsed plan: (start, stop, name parts, whether an alias follows), and columns and stars that are written
    with a schema: (start, stop, name parts)."""

    def __init__(self, spark):
        loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
        self.subquery = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression", True, loader)
        self.found: list[tuple[int, int, list[str], bool]] = []
        self.columns: list[tuple[int, int, list[str]]] = []

    def plan(self, node, scope: frozenset[str], named: bool = False) -> None:
        kind = _kind(node)
        if kind not in READS:
            raise InsufficientPrivilege("Anon: role is masked")
        if kind == "UnresolvedRelation":
            parts = _list(node.multipartIdentifier())
            if not (len(parts) == 1 and parts[0].lower() in scope):
                origin = node.origin()
                self.found.append((origin.startIndex().get(), origin.stopIndex().get(), parts, named))
            return
        if kind == "UnresolvedTableValuedFunction" and _list(node.name())[-1].lower() not in TABLE_FUNCTIONS:
            raise InsufficientPrivilege("Anon: role is masked")
        if kind == "UnresolvedWith":
            for pair in _list(node.cteRelations()):
                name = pair._1().lower()
                self.plan(pair._2(), scope | {name} if self._recursive(node) else scope)
                scope |= {name}
            self.plan(node.child(), scope)
            return
        for e in _list(node.expressions()):
            self.expression(e, scope)
        if kind == "WithWindowDefinition":  # its windows aren't among its expressions
            windows = node.windowDefinitions().valuesIterator()
            while windows.hasNext():
                self.expression(windows.next(), scope)
        for child in _list(node.children()):
            self.plan(child, scope, named=kind in ("SubqueryAlias", "Sample"))

    @staticmethod
    def _recursive(node) -> bool:
        try:
            return bool(node.allowRecursion())
        except Exception:  # py4j: this version's node doesn't say
            return False

    def expression(self, e, scope: frozenset[str]) -> None:
        if _kind(e) == "UnresolvedFunction" and _list(e.nameParts())[-1].lower() in DENIED:
            raise InsufficientPrivilege("Anon: role is masked")
        if self.subquery.isInstance(e):
            self.plan(e.plan(), scope)
        if "Identifier" in _kind(e) and "Unresolved" in _kind(e):
            raise InsufficientPrivilege("Anon: role is masked")
        parts = []
        if _kind(e) == "UnresolvedAttribute":
            parts = _list(e.nameParts())
        elif _kind(e) == "UnresolvedStar" and e.target().isDefined():
            parts = [*_list(e.target().get()), "*"]
        if len(parts) > 2 and e.origin().startIndex().isDefined():
            self.columns.append((e.origin().startIndex().get(), e.origin().stopIndex().get(), parts))
        for child in _list(e.children()):
            self.expression(child, scope)


def _alias(key: tuple[str, str], keys: set[tuple[str, str]]) -> str:
    """The alias of a table that has none in the text: its name, with its schema if a table of another schema is named alike."""
    alike = {k for k in keys if k[1].lower() == key[1].lower()}
    return key[1] if len(alike) == 1 else ".".join(key)


def masked_sql(session, text: str, args=None) -> DataFrame:
    """text with every table masked for the session's role; args: values of its parameters."""
    spark = session.engine.spark
    if "${" in text:
        raise InsufficientPrivilege("Anon: variables are not available to masked roles")
    parser = spark._jsparkSession.sessionState().sqlParser()
    finder = Finder(spark)
    finder.plan(parser.parsePlan(text), frozenset())
    plain = {session.resolve(parts) for _, _, parts, named in finder.found if not named}
    views: dict[tuple[str, str], str] = {}
    edits: list[tuple[int, int, str]] = []
    try:
        for start, stop, parts, named in finder.found:
            key = session.resolve(parts)
            if key not in views:
                views[key] = f"masked_{uuid.uuid4().hex}"
                session.table(key).createOrReplaceTempView(views[key])
            new = quote(views[key]) + ("" if named else f" AS {quote(_alias(key, plain))}")
            if (keyword := _TABLE.search(text[:start])) is not None:  # TABLE name is a query of its own
                start, new = keyword.start(), f"SELECT * FROM {new}"
            edits.append((start, stop, new))
        for start, stop, parts in finder.columns:
            key = next((k for k in plain if [x.lower() for x in k] == [x.lower() for x in parts[:2]]), None)
            if key is not None:
                edits.append((start, stop, ".".join([quote(_alias(key, plain)), *(x if x == "*" else quote(x) for x in parts[2:])])))
        out = text
        for start, stop, new in sorted(set(edits), reverse=True):
            out = out[:start] + new + out[stop + 1 :]
        again = Finder(spark)
        again.plan(parser.parsePlan(out), frozenset())
        if len(again.found) != len(finder.found) or any(len(parts) != 1 or parts[0] not in views.values() for _, _, parts, _ in again.found):
            raise InsufficientPrivilege("Anon: role is masked")
        return spark.sql(out, args=args)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
