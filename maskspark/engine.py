"""The engine (what an administrator holds) and masked sessions (what a masked role gets)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trust
from .conf import EngineConf
from .errors import InsufficientPrivilege, InvalidExpression, InvalidLabel, MaskingError, UnknownObject
from .functions import Context
from .operators import columns, dump, masking, privacy, static, views
from .plans.rewrite import masked_sql
from .registry import DEFAULT_POLICY, DEFAULT_SCHEMA, Registry, Rule, Table, table_name
from .sources.dictionaries import Dictionaries
from .sqltext import names

VERSION = "1.0.0"


class Engine:
    def __init__(self, spark: SparkSession, conf: EngineConf | None = None):
        self.spark, self.conf = spark, conf or EngineConf()
        self.registry, self.dictionaries = Registry(spark), Dictionaries(spark)
        self.legacy = views.LegacyMasking(self)

    # tables

    def register(self, name: str, source: DataFrame | Callable[[], DataFrame] | str, fmt: str = "parquet", options: dict | None = None, **metadata) -> Table:
        """A table by name: a DataFrame, a function that gives one, or a path in a format. metadata: see Table.

        A function is called once, when the table is first needed; register the table anew if its schema changes.
        """
        if isinstance(source, DataFrame):
            read = lambda: source
        elif isinstance(source, str):
            static.recover(self.spark, source)
            loaded = self.spark.read.format(fmt).options(**(options or {})).load(source)
            metadata |= {"path": source, "fmt": fmt, "options": options or {}, "partitions": static.partition_columns(loaded)}
            read = lambda: loaded
        else:
            read = cache(source)
        table = Table(table_name(name), read, **metadata)
        self.registry.tables[table.name] = table
        return table

    def table(self, name: str) -> DataFrame:
        """Authentic rows."""
        return self.registry.table(name).read()

    # rules

    def policies(self) -> list[str]:
        return [DEFAULT_POLICY, *(p for p in self.conf.masking_policies if p != DEFAULT_POLICY)]

    def label(self, kind: str, name: str, text: str | None, policy: str = DEFAULT_POLICY, superuser: bool = True) -> None:
        """SECURITY LABEL FOR policy ON kind name IS text; None removes the label."""
        if policy == self.conf.k_anonymity_provider:
            self.registry.put_identifier(policy, kind, name, text)
            return
        if policy not in self.policies():
            raise UnknownObject(f'security label provider "{policy}" is not loaded')
        self.registry.put(policy, kind, name, text, superuser, self._check_rule)

    def _check_rule(self, rule: Rule, table: Table) -> None:
        try:
            if rule.kind == "function":
                trust.check_call(self.registry, rule.text, self.conf.restrict_to_trusted_schemas)
            elif rule.kind == "value":
                trust.check_value(self.spark, rule.text)
        except InvalidExpression as e:
            raise InvalidLabel(rule.text, "column", str(e)) from e

    def register_function(self, name: str, builder: Callable[..., str], trusted: bool = False) -> None:
        """A masking function of one's own: builder gives Spark SQL from the SQL of its arguments."""
        parts = names(name)
        key = (parts[-2] if len(parts) > 1 else DEFAULT_SCHEMA, parts[-1])
        self.registry.user_functions[key] = builder
        if trusted:
            self.label("FUNCTION", ".".join(key), "TRUSTED")

    def remove_masks_for_all_columns(self, policy: str = DEFAULT_POLICY) -> bool:
        self.registry.rules.pop(policy, None)
        return True

    def remove_masks_for_all_roles(self, policy: str = DEFAULT_POLICY) -> bool:
        self.registry.masked_roles.pop(policy, None)
        return True

    def masking_rules(self, policy: str = DEFAULT_POLICY) -> DataFrame:
        """One row for each masked column: its rule, or its default where privacy is the default."""
        rows = {}
        if self.conf.privacy_by_default:
            for t in self.registry.tables.values():
                rows |= {(t.name, c): (*t.name, c, None, t.defaults.get(c), 0) for c in t.read().columns}
        for (t, c), rule in self.registry.rules.get(policy, {}).items():
            function = rule.text if rule.kind == "function" else None
            value = rule.text if rule.kind == "value" else None
            if rule.kind == "not_masked":
                rows.pop((t, c), None)
            else:
                rows[t, c] = (*t, c, function, value, 100)
        schema = "relnamespace string, relname string, attname string, masking_function string, masking_value string, priority int"
        df = self.spark.createDataFrame(sorted(rows.values(), key=lambda r: r[:3]), schema)
        trusted = F.when(F.col("masking_function").isNotNull(), F.regexp_extract("masking_function", r"^\s*([^.(]+)\.", 1))
        return df.withColumn("masking_filter", F.coalesce("masking_function", "masking_value")).withColumn("trusted_schema", trusted)

    def masked_roles(self) -> DataFrame:
        rows = [(r, self.hasmask(r)) for r in sorted(self.registry.roles)]
        return self.spark.createDataFrame(rows, "rolname string, hasmask boolean")

    def trusted_functions(self) -> DataFrame:
        rows = sorted(k for k, v in self.registry.functions.get(DEFAULT_POLICY, {}).items() if v)
        return self.spark.createDataFrame(rows + sorted((trust.HOST, f) for f in trust.TRUSTED_BUILTINS), "schema string, function string")

    # roles

    def create_role(self, name: str, groups: set[str] = frozenset()) -> None:
        self.registry.roles[name] = set(groups)

    def hasmask(self, role: str | None, policy: str = DEFAULT_POLICY) -> bool:
        if role is None:
            return False
        if role not in self.registry.roles:
            raise UnknownObject(f'role "{role}" does not exist')
        return bool(self.registry.masked_roles.get(policy, {}).get(role))

    def masking_policy(self, role: str) -> str | None:
        """The first policy in which the role is masked; membership in a masked role doesn't count."""
        return next((p for p in self.policies() if self.registry.masked_roles.get(p, {}).get(role)), None)

    def session(self, role: str) -> MaskedSession | Session:
        if role not in self.registry.roles:
            raise UnknownObject(f'role "{role}" does not exist')
        policy = self.masking_policy(role)
        return MaskedSession(self, role, policy) if policy and self.conf.transparent_dynamic_masking else Session(self, role)

    # compiled rules

    def compiler(self, name: str, policy: str = DEFAULT_POLICY, role: str | None = None) -> masking.Compiler:
        return masking.Compiler(self, self.registry.table(name), policy, role)

    def masked(self, name: str, policy: str = DEFAULT_POLICY, role: str | None = None) -> DataFrame:
        """The table as the policy masks it, whoever asks."""
        compiler = self.compiler(name, policy, role)
        df = compiler.masked()
        return compiler.source if df is None else df

    def masking_expressions(self, name: str, policy: str = DEFAULT_POLICY) -> str:
        compiler = self.compiler(name, policy)
        return compiler.text_of(compiler.select_list()[0])

    def masking_value(self, name: str, column: str, policy: str = DEFAULT_POLICY) -> str | None:
        compiler = self.compiler(name, policy)
        field = next((f for f in compiler.source.schema if f.name == column), None)
        return None if field is None else compiler.column(field)[0]

    def masking_subquery(self, name: str, policy: str = DEFAULT_POLICY) -> str | None:
        """SQL text of the masking subquery, for reading; None if nothing is masked or sampled."""
        compiler = self.compiler(name, policy)
        pairs, any_masked = compiler.select_list()
        ratio = self.registry.sample(compiler.table.name, policy)
        if not any_masked and ratio is None:
            return None
        part = f" TABLESAMPLE ({ratio.share * 100:g} PERCENT)" if ratio else ""
        outer = ", ".join(f"{compiler.table.generated.get(c, c)} AS {c}" for c in compiler.source.columns) if compiler.table.generated else "*"
        return f"SELECT {outer} FROM (SELECT {compiler.text_of(pairs)} FROM {compiler.table.sql_name}{part}) AS {masking.alias_of(compiler.table)}"

    def expression(self, call: str, df: DataFrame) -> F.Column:
        """A masking call as a Column for df."""
        table = Table(("", ""), lambda: df)
        return F.expr(masking.Compiler(self, table).expression(call))

    # whole tables

    def anonymize_column(self, name: str, column: str, policy: str = DEFAULT_POLICY) -> bool:
        return static.anonymize_column(self, name, column, policy)

    def anonymize_table(self, name: str, policy: str = DEFAULT_POLICY) -> bool | None:
        return static.anonymize_table(self, name, policy)

    def anonymize_database(self, policy: str = DEFAULT_POLICY) -> bool:
        return static.anonymize_database(self, policy)

    def _change(self, name: str, change: Callable[[DataFrame], DataFrame]) -> bool:
        table = self.registry.table(name)
        static.replace(self, table, change(table.read()))
        return True

    def _context(self, df: DataFrame) -> Context:
        return Context(self.spark, df.schema, self.conf, self.dictionaries)

    def shuffle_column(self, name: str, column: str, key: str, seed: int | None = None) -> bool:
        return self._change(name, lambda df: columns.shuffle_column(df, name, column, key, seed))

    def add_noise_on_numeric_column(self, name: str, column: str, ratio: float) -> bool:
        return self._change(name, lambda df: columns.add_noise_on_numeric_column(self._context(df), df, name, column, ratio))

    def add_noise_on_datetime_column(self, name: str, column: str, interval: str) -> bool:
        return self._change(name, lambda df: columns.add_noise_on_datetime_column(self._context(df), df, name, column, interval))

    def dump(self, out: str, policy: str = DEFAULT_POLICY, **options) -> dict[str, str]:
        return dump.dump(self, out, policy, **options)

    def masking_view(self, name: str, expressions: dict[str, str], view: str) -> DataFrame:
        return views.masking_view(self, name, expressions, view)

    # analytics and small things

    def identifiers(self) -> DataFrame:
        rows = [(*t, c, f"{kind} IDENTIFIER") for (t, c), kind in sorted(self.registry.identifiers.get(self.conf.k_anonymity_provider, {}).items())]
        return self.spark.createDataFrame(rows, "relnamespace string, relname string, attname string, indirect_identifier string")

    def k_anonymity(self, name: str) -> int | None:
        table = self.registry.table(name)
        own = [c for t, c in self.registry.identifiers.get(self.conf.k_anonymity_provider, {}) if t == table.name]
        return privacy.k_anonymity(table.read(), own)

    def detect(self, lang: str = "en_US") -> DataFrame:
        return privacy.detect(self, lang)

    def init(self, path: str | None = "") -> bool | None:
        return self.dictionaries.init(path)

    def column_exists(self, name: str, column: str) -> bool:
        return column in self.table(name).columns

    def default_of(self, name: str, column: str) -> str | None:
        return self.registry.table(name).defaults.get(column)

    @staticmethod
    def get_schema(name: str) -> str:
        return table_name(name)[0]

    @staticmethod
    def get_relname(name: str) -> str:
        return table_name(name)[1]

    @staticmethod
    def get_function_schema(call: str) -> str:
        return trust.function_schema(call)

    @staticmethod
    def version() -> str:
        return VERSION


class Session:
    """A role that isn't masked: authentic tables, with row policies."""

    def __init__(self, engine: Engine, role: str):
        self.engine, self.role, self.cursors = engine, role, {}

    def resolve(self, parts: list[str]) -> tuple[str, str]:
        key = (DEFAULT_SCHEMA, parts[0]) if len(parts) == 1 else tuple(parts[-2:])
        for known in self.engine.registry.tables:
            if known == key or tuple(x.lower() for x in known) == tuple(x.lower() for x in key):
                return known
        raise InsufficientPrivilege(f"permission denied for relation {'.'.join(parts)}")

    def table(self, name: str | tuple[str, str]) -> DataFrame:
        table = self.engine.registry.table(name)
        return masking.Compiler(self.engine, table, role=self.role).authentic()

    def sql(self, text: str, args=None) -> DataFrame:
        return masked_sql(self, text, args)

    def declare_cursor(self, name: str, text: str, args=None) -> None:
        """DECLARE name CURSOR FOR text: rows come to the driver partition by partition, as they are fetched."""
        if name in self.cursors:
            raise MaskingError(f'cursor "{name}" already exists')
        self.cursors[name] = self.sql(text, args).toLocalIterator()

    def fetch(self, name: str, n: int = 1) -> list:
        """FETCH n FROM name: up to n further rows."""
        if name not in self.cursors:
            raise UnknownObject(f'cursor "{name}" does not exist')
        return list(islice(self.cursors[name], n))

    def close_cursor(self, name: str) -> None:
        if self.cursors.pop(name, None) is None:
            raise UnknownObject(f'cursor "{name}" does not exist')


class MaskedSession(Session):
    """A masked role: may read masked tables, and nothing else."""

    def __init__(self, engine: Engine, role: str, policy: str):
        super().__init__(engine, role)
        self.policy = policy

    def table(self, name: str | tuple[str, str]) -> DataFrame:
        table = self.engine.registry.table(name)
        compiler = masking.Compiler(self.engine, table, self.policy, self.role)
        df = compiler.masked()
        return compiler.source if df is None else df

    def write(self, name: str, path: str, columns: list[str] | None = None, fmt: str = "csv") -> None:
        """COPY name (columns) TO path."""
        dump.write(self.table(name), path, fmt, columns)

    def settings(self) -> dict:
        return self.engine.conf.visible(masked=True)

    def _refuse(self, *_, **__):
        raise InsufficientPrivilege("Anon: role is masked")

    explain = truncate = insert = update = delete = label = anonymize_table = _refuse
