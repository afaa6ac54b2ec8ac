"""Legacy dynamic masking by shadow views, and generalised masking views."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import MaskingError
from ..registry import DEFAULT_POLICY
from .masking import Compiler
from .sampling import sample


def mask_columns(engine, name: str, policy: str = DEFAULT_POLICY) -> DataFrame:
    """(attname, masking_filter, format_type) of a table's columns, in order."""
    table = engine.registry.table(name)
    rules = engine.registry.rules.get(policy, {})
    rows = []
    for f in table.read().schema:
        rule = rules.get((table.name, f.name))
        rows.append((f.name, rule.text if rule and rule.kind != "not_masked" else None, table.types.get(f.name, f.dataType.simpleString())))
    return engine.spark.createDataFrame(rows, "attname string, masking_filter string, format_type string")


def mask_filters(engine, name: str, policy: str = DEFAULT_POLICY) -> str:
    """The select list of a table; every column is cast, whatever strict mode says."""
    compiler = Compiler(engine, engine.registry.table(name), policy)
    return compiler.text_of(compiler.select_list(always_cast=True)[0])


def mask_select(engine, name: str, policy: str = DEFAULT_POLICY) -> DataFrame:
    table = engine.registry.table(name)
    compiler = Compiler(engine, table, policy)
    pairs, _ = compiler.select_list(always_cast=True)
    ratio = engine.registry.sample(table.name, policy)
    rows = sample(compiler.source, ratio) if ratio else compiler.source
    return rows.selectExpr(*(f"{sql} AS `{c}`" for c, sql in pairs))


class LegacyMasking:
    """A temporary view for each table of the source schema, named as the table in the mask schema: mask_table."""

    def __init__(self, engine):
        self.engine, self.views = engine, {}

    def view_name(self, name: tuple[str, str]) -> str:
        return f"{self.engine.conf.maskschema}_{name[1]}"

    def create_view(self, name: str) -> None:
        table = self.engine.registry.table(name)
        if table.is_view:
            raise MaskingError("Masking a view is not supported.")
        view = self.view_name(table.name)
        mask_select(self.engine, table.sql_name).createOrReplaceTempView(view)
        self.views[table.name] = view

    def drop_view(self, name: str) -> bool:
        view = self.views.pop(self.engine.registry.table(name).name, None)
        return bool(view) and self.engine.spark.catalog.dropTempView(view)

    def update(self) -> bool:
        for table in self.engine.registry.tables.values():
            if table.name[0] == self.engine.conf.sourceschema:
                if table.is_view and any(t == table.name for t, _ in self.engine.registry.rules.get(DEFAULT_POLICY, {})):
                    raise MaskingError("Masking a view is not supported.")
                if not table.is_view:
                    self.create_view(table.sql_name)
        return True

    def start(self, autoload: bool = True) -> bool:
        if autoload and not self.engine.dictionaries.is_initialized():
            self.engine.dictionaries.init()
        return self.update()

    def mask_role(self, role: str) -> bool:
        """From now on table() gives the role the shadow views."""
        self.engine.label("ROLE", role, "MASKED")
        return self.update()

    def unmask_role(self, role: str) -> bool:
        self.engine.label("ROLE", role, None)
        return True

    def table(self, role: str, name: str) -> DataFrame:
        """What a role reads by a table's plain name: its view if the role is masked, else the table."""
        table = self.engine.registry.table(name)
        if self.engine.hasmask(role) and table.name in self.views:
            return self.engine.spark.table(self.views[table.name])
        return table.read()

    def stop(self) -> bool:
        for view in self.views.values():
            self.engine.spark.catalog.dropTempView(view)
        self.views = {}
        self.engine.remove_masks_for_all_roles()
        return True


def masking_view(engine, name: str, columns: dict[str, str], view: str) -> DataFrame:
    """A view over a table with columns of any types: {column: expression}, as generalisation needs."""
    compiler = Compiler(engine, engine.registry.table(name))
    df = compiler.source.selectExpr(*(f"{compiler.expression(sql)} AS `{c}`" for c, sql in columns.items()))
    df.createOrReplaceTempView(view)
    return df
