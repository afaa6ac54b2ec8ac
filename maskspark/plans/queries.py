"""The registered queries of the masking engine, each with SQL that says the same where results aren't random.

Random masks are registered as invariants: one row for each function, with the rows seen and whether all of them hold.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..engine import Engine
from ..errors import InsufficientPrivilege, MaskingError
from ..functions.dummy import FRENCH, GENERATORS, LOCALES, PLAIN
from ..sources.dictionaries import own_values
from ..streaming import mask_stream

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def engine_for(spark: SparkSession, sf_dir: str, **conf) -> Engine:
    """An engine over the tables of a folder, with dictionaries loaded."""
    engine = Engine(spark, EngineConf(**conf))
    for name in TABLES:
        engine.register(name, lambda name=name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    engine.init()
    return engine


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode without one, a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='maskspark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def masked(name: str, table: str, rules: dict[str, str], columns: str, sql: str, **conf) -> None:
    """Registers: the table with rules {column: label}, some of its columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_for(spark, sf_dir, **conf)
        for column, label in rules.items():
            engine.label("COLUMN", f"{table}.{column}", label)
        return engine.masked(table).selectExpr(*columns.split(", "))

    query(sql, name)(run)


def called(name: str, table: str, calls: dict[str, str], sql: str, where: str = "true", keys: str = "", **conf) -> None:
    """Registers: {column: call} as columns of a table, beside its keys."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_for(spark, sf_dir, **conf)
        df = engine.table(table).where(where)
        return df.select(*[k for k in keys.split() if k], *(engine.expression(call, df).alias(c) for c, call in calls.items()))

    query(sql, name)(run)


def f(call: str) -> str:
    return f"MASKED WITH FUNCTION {call}"


# constants, partial values, conditions

masked("mask_value", "customer", {"c_mktsegment": "MASKED WITH VALUE 'CONFIDENTIAL'"}, "c_custkey, c_mktsegment", "SELECT c_custkey, 'CONFIDENTIAL' AS c_mktsegment FROM customer")
masked("mask_null", "customer", {"c_acctbal": "MASKED WITH VALUE NULL"}, "c_custkey, c_acctbal", "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer")
masked("mask_column_value", "nation", {"n_name": "MASKED WITH VALUE n_regionkey"}, "n_nationkey, n_name", "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_name FROM nation")
masked("mask_partial", "customer", {"c_name": f("anon.partial(c_name, 2, $$******$$, 3)")}, "c_custkey, c_name", "SELECT c_custkey, substring(c_name, 1, 2) || '******' || right(c_name, 3) AS c_name FROM customer")
masked("mask_ternary", "customer", {"c_mktsegment": f("anon.ternary(c_acctbal > 0, 'positive', NULL)")}, "c_custkey, c_mktsegment", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'positive' END AS c_mktsegment FROM customer")
masked("mask_nested", "customer", {"c_name": f("anon.upper(anon.left(anon.md5(c_name), 8))")}, "c_custkey, c_name", "SELECT c_custkey, upper(left(md5(c_name), 8)) AS c_name FROM customer")
called("mask_partial_email", "customer", {"email": "anon.partial_email(concat(c_name, '@mail.example.co.uk'))"}, "SELECT c_custkey, substring(c_name, 1, 2) || '******@ma******.uk' AS email FROM customer", keys="c_custkey")

# hashes and pseudonyms

_OID = "CAST(round({n}::BIGINT * ('0x' || substr(md5({seed} || '{salt}'), 1, 6))::INT / 16777215.0) AS INT)"
masked("hash_md5", "customer", {"c_name": f("anon.digest(c_name, 'pepper', 'md5')")}, "c_custkey, c_name", "SELECT c_custkey, md5(c_name || 'pepper') AS c_name FROM customer")
masked("hash_sha256", "customer", {"c_name": f("anon.hash(c_name)")}, "c_custkey, c_name", "SELECT c_custkey, sha256(c_name || 'xyz') AS c_name FROM customer", salt="xyz")
masked("hash_unknown_algorithm", "nation", {"n_name": f("anon.digest(n_name, 'x', 'sha1')")}, "n_nationkey, n_name", "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS n_name FROM nation")
called("hash_lengths", "nation", {k: f"anon.length(anon.digest(n_name, '', '{k}'))" for k in ("sha224", "sha384", "sha512")}, "SELECT n_nationkey, 56 AS sha224, 96 AS sha384, 128 AS sha512 FROM nation", keys="n_nationkey")
called("pseudo_oid", "customer", {"oid": "anon.projection_to_oid(c_custkey, 'salt', 10000)"}, "SELECT c_custkey, " + _OID.format(n=10000, seed="c_custkey::VARCHAR", salt="salt") + " AS oid FROM customer", keys="c_custkey")
called("hex_to_int", "customer", {"n": "anon.hex_to_int(anon.left(anon.md5(c_name), 6))"}, "SELECT c_custkey, ('0x' || left(md5(c_name), 6))::INT AS n FROM customer", keys="c_custkey")
for _kind in ("first_name", "last_name", "email", "city", "country", "company", "iban", "siret"):
    _values = own_values(_kind)
    _list = ", ".join("({}, '{}')".format(i, v.replace("'", "''")) for i, v in enumerate(_values))
    masked(f"pseudo_{_kind}", "customer", {"c_name": f(f"anon.pseudo_{_kind}(c_custkey, 'k')")}, "c_custkey, c_name", f"SELECT c_custkey, d.val AS c_name FROM customer LEFT JOIN (VALUES {_list}) d(oid, val) ON d.oid = " + _OID.format(n=len(_values) - 1, seed="c_custkey::VARCHAR", salt="k"))

# generalisation

_RANGE = "'[' || {low} || ',' || {high} || ')'"
called("gen_int4", "part", {"r": "anon.range_text(anon.generalize_int4range(p_size))"}, "SELECT p_partkey, " + _RANGE.format(low="(p_size // 10) * 10", high="((p_size // 10) + 1) * 10") + " AS r FROM part", keys="p_partkey")
called("gen_int4_step", "part", {"r": "anon.range_text(anon.generalize_int4range(p_size - 25, 3))"}, "SELECT p_partkey, " + _RANGE.format(low="((p_size - 25) // 3) * 3", high="(((p_size - 25) // 3) + 1) * 3") + " AS r FROM part", keys="p_partkey")
called("gen_int8", "orders", {"r": "anon.range_text(anon.generalize_int8range(o_orderkey, 1000))"}, "SELECT o_orderkey, " + _RANGE.format(low="(o_orderkey // 1000) * 1000", high="((o_orderkey // 1000) + 1) * 1000") + " AS r FROM orders", keys="o_orderkey")
called("gen_num", "orders", {"r": "anon.range_text(anon.generalize_numrange(o_totalprice, 500))"}, "SELECT o_orderkey, " + _RANGE.format(low="(round(o_totalprice::DECIMAL(38,10))::BIGINT // 500) * 500", high="((round(o_totalprice::DECIMAL(38,10))::BIGINT // 500) + 1) * 500") + " AS r FROM orders", keys="o_orderkey")
called("gen_null", "nation", {"r": "anon.range_text(anon.generalize_int4range(CAST(NULL AS int)))", "d": "anon.range_text(anon.generalize_daterange(CAST(NULL AS date)))"}, "SELECT n_nationkey, '(,)' AS r, '(,)' AS d FROM nation", keys="n_nationkey")
_Y = "year(o_orderdate)"
_LOWS = {
    "decade": ("make_date(({y} // 10) * 10, 1, 1)", 10), "century": ("make_date((({y} - 1) // 100) * 100 + 1, 1, 1)", 100), "millennium": ("make_date((({y} - 1) // 1000) * 1000 + 1, 1, 1)", 1000),
    "year": ("date_trunc('year', o_orderdate)::DATE", 1),
}
for _step in ("day", "week", "month", "year", "decade", "century", "millennium"):
    if _step in _LOWS:
        _low = _LOWS[_step][0].format(y=_Y)
        _high = f"({_low} + INTERVAL {_LOWS[_step][1]} YEAR)"
    else:
        _low = f"date_trunc('{_step}', o_orderdate)::DATE"
        _high = f"({_low} + INTERVAL 1 {_step})"
    _stamp = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
    called(f"gen_ts_{_step}", "orders", {"r": f"anon.range_text(anon.generalize_tsrange(o_orderdate, '{_step}'))"}, "SELECT o_orderkey, " + _RANGE.format(low=_stamp(_low), high=_stamp(_high)) + " AS r FROM orders", keys="o_orderkey")
    called(f"gen_date_{_step}", "orders", {"r": f"anon.range_text(anon.generalize_daterange(CAST(o_orderdate AS date), '{_step}'))"}, "SELECT o_orderkey, " + _RANGE.format(low=f"strftime({_low}, '%Y-%m-%d')", high=f"strftime({_high}, '%Y-%m-%d')") + " AS r FROM orders", keys="o_orderkey")
called("gen_tstz_month", "orders", {"r": "anon.range_text(anon.generalize_tstzrange(o_orderdate, 'month'))"}, "SELECT o_orderkey, " + _RANGE.format(low=_stamp("date_trunc('month', o_orderdate)"), high=_stamp("(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)")) + " AS r FROM orders", keys="o_orderkey")
called("gen_date_hour", "orders", {"r": "anon.range_text(anon.generalize_daterange(CAST(o_orderdate AS date), 'hour'))"}, "SELECT o_orderkey, 'empty' AS r FROM orders", keys="o_orderkey")

# trusted built-ins

called(
    "builtins_text", "customer",
    {
        "a": "anon.lower(c_name)", "b": "anon.upper(c_mktsegment)", "c": "anon.left(c_name, 3)", "d": "anon.right(c_name, 3)", "e": "anon.substr(c_name, 2, 4)", "f": "anon.substr(c_name, 0, 3)",
        "g": "anon.concat(c_name, NULL)", "h": "anon.replace(c_name, 'Customer', 'C')", "i": "anon.regexp_replace(c_name, '0', 'x')", "j": "anon.regexp_replace(c_name, '(0+)', '<\\1>', 'g')", "k": "anon.length(c_name)", "l": "pg_catalog.repeat('ab', 2)",
    },
    "SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, left(c_name, 3) AS c, right(c_name, 3) AS d, substring(c_name, 2, 4) AS e, left(c_name, 2) AS f, c_name AS g, replace(c_name, 'Customer', 'C') AS h, "
    "regexp_replace(c_name, '0', 'x') AS i, regexp_replace(c_name, '(0+)', '<\\1>', 'g') AS j, length(c_name)::INT AS k, 'abab' AS l FROM customer",
    keys="c_custkey",
)
called(
    "builtins_dates", "orders",
    {
        "a": "anon.date_part('year', o_orderdate)", "b": "anon.to_char(o_orderdate, 'YYYY-MM-DD HH24:MI:SS')", "c": "anon.to_char(anon.date_trunc('month', o_orderdate), 'YYYY-MM-DD')", "d": "anon.to_char(anon.date_add(o_orderdate, INTERVAL '1 day'), 'YYYY/MM/DD')",
        "e": "anon.to_char(anon.date_subtract(o_orderdate, INTERVAL '1 month'), 'YYYY/MM/DD')", "f": "CAST(anon.make_date(anon.date_part('year', o_orderdate)::int, 1, 1) AS string)", "g": "CAST(anon.to_date('05 Dec 2000', 'DD Mon YYYY') AS string)", "h": "anon.date_part('day', INTERVAL '3 days')",
    },
    "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS a, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS b, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS c, strftime(o_orderdate + INTERVAL 1 DAY, '%Y/%m/%d') AS d, "
    "strftime(o_orderdate - INTERVAL 1 MONTH, '%Y/%m/%d') AS e, year(o_orderdate)::VARCHAR || '-01-01' AS f, '2000-12-05' AS g, 3.0::DOUBLE AS h FROM orders",
    keys="o_orderkey",
)
called(
    "builtins_numbers", "nation",
    {"a": "anon.to_char(125.8, '999D9')", "b": "CAST(anon.to_number('12,454.8-', '99G999D9S') AS double)", "c": "anon.json_build_object('k', n_nationkey)", "d": "anon.json_build_array(n_nationkey, 'x')", "e": "anon.make_time(8, 15, 23)", "f": "anon.age(DATE '2001-04-10', DATE '1957-06-13')"},
    "SELECT n_nationkey, ' 125.8' AS a, -12454.8::DOUBLE AS b, '{\"k\" : ' || n_nationkey || '}' AS c, '[' || n_nationkey || ', \"x\"]' AS d, '08:15:23' AS e, '43 years 9 mons 28 days' AS f FROM nation",
    keys="n_nationkey",
)

called(
    "builtins_json", "nation",
    {
        "a": "anon.to_json(n_name)", "b": "anon.to_jsonb(array(n_nationkey, 1))", "c": "anon.row_to_json(struct(n_nationkey, n_name))", "d": "anon.array_to_json(array(n_regionkey))", "e": "anon.jsonb_build_array(n_nationkey, 'x')", "f": "anon.jsonb_build_object('k', n_nationkey)",
        "g": "anon.json_object(array('a', 'b'), array('1', n_name))", "h": "anon.jsonb_object(array('a'), array(n_name))", "i": "anon.ltrim(concat('  ', n_name, ' '))", "j": "anon.rtrim(concat(' ', n_name, '  '))", "k": "anon.btrim(concat('  ', n_name, ' '))", "l": "anon.to_json(n_nationkey)",
    },
    "SELECT n_nationkey, '\"' || n_name || '\"' AS a, '[' || n_nationkey || ',1]' AS b, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS c, '[' || n_regionkey || ']' AS d, '[' || n_nationkey || ', \"x\"]' AS e, '{\"k\" : ' || n_nationkey || '}' AS f, "
    "'{\"a\":\"1\",\"b\":\"' || n_name || '\"}' AS g, '{\"a\":\"' || n_name || '\"}' AS h, n_name || ' ' AS i, ' ' || n_name AS j, n_name AS k, n_nationkey::VARCHAR AS l FROM nation",
    keys="n_nationkey",
)
called("builtins_to_timestamp", "nation", {"a": "CAST(anon.to_timestamp('05 Dec 2000 12:34', 'DD Mon YYYY HH24:MI') AS string)", "b": "CAST(anon.now() IS NOT NULL AS boolean)"}, "SELECT n_nationkey, '2000-12-05 12:34:00' AS a, TRUE AS b FROM nation", keys="n_nationkey")

# rules, defaults, generated columns, casts

masked("not_masked", "orders", {"o_orderstatus": "NOT MASKED", "o_orderkey": "NOT MASKED"}, "o_orderkey, o_orderstatus, o_orderpriority, o_totalprice", "SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS o_orderpriority, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders", privacy_by_default=True)


@query("SELECT CAST(NULL AS BIGINT) AS o_orderkey, 'unknown' AS o_orderpriority, CAST(NULL AS DOUBLE) AS o_totalprice FROM orders")
def privacy_by_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir, privacy_by_default=True)
    engine.register("orders", engine.table("orders"), defaults={"o_orderpriority": "'unknown'"})
    return engine.masked("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, 188.0::DOUBLE AS l_quantity, 94.0::DOUBLE AS half FROM lineitem")
def generated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.register("lines", engine.table("lineitem").withColumn("half", F.col("l_quantity") / 2), generated={"half": "l_quantity / 2"})
    engine.label("COLUMN", "lines.l_quantity", "MASKED WITH VALUE 188")
    return engine.masked("lines").select("l_orderkey", "l_linenumber", "l_quantity", "half")


@query("SELECT o_orderkey, left(o_orderpriority, 3) AS o_orderpriority, rpad(left(o_orderstatus || 'x', 4), 4, ' ') AS o_orderstatus, round(o_totalprice::DECIMAL(20,4))::INT AS rounded FROM orders")
def strict_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.register("orders", engine.table("orders").withColumn("rounded", F.lit(0)), types={"o_orderpriority": "varchar(3)", "o_orderstatus": "char(4)"})
    engine.label("COLUMN", "orders.o_orderpriority", f("anon.concat(o_orderpriority, 'abc')"))
    engine.label("COLUMN", "orders.o_orderstatus", f("anon.concat(o_orderstatus, 'x')"))
    engine.label("COLUMN", "orders.rounded", f("anon.ternary(true, CAST(o_totalprice AS decimal(20,4)), NULL)"))
    return engine.masked("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "rounded")


@query("SELECT * FROM (VALUES ('public', 'customer', 'c_acctbal', NULL, 'NULL', 'NULL'), ('public', 'customer', 'c_name', 'anon.partial(c_name,1,''x'',1)', NULL, 'anon.partial(c_name,1,''x'',1)')) t(relnamespace, relname, attname, masking_function, masking_value, masking_filter)")
def rules_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.label("COLUMN", "customer.c_name", f("anon.partial(c_name,1,'x',1)"))
    engine.label("COLUMN", "customer.c_acctbal", "MASKED WITH VALUE NULL")
    engine.label("COLUMN", "customer.c_custkey", "NOT MASKED")
    return engine.masking_rules().select("relnamespace", "relname", "attname", "masking_function", "masking_value", "masking_filter")


# k-anonymity, detection


@query("SELECT min(n)::BIGINT AS k FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)")
def k_anonymity_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    for c in ("o_orderstatus", "o_orderpriority"):
        engine.label("COLUMN", f"orders.{c}", "QUASI IDENTIFIER", policy="k_anonymity")
    return spark.sql(f"SELECT CAST({engine.k_anonymity('orders')} AS bigint) AS k")


@query("SELECT min(n)::BIGINT AS k FROM (SELECT count(*) AS n FROM orders GROUP BY year(o_orderdate) // 10, o_orderstatus)")
def k_anonymity_generalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    view = engine.masking_view("orders", {"o_orderdate": "anon.generalize_tsrange(o_orderdate, 'decade')", "o_orderstatus": "o_orderstatus"}, "generalized_orders")
    engine.register("generalized_orders", view, is_view=True)
    for c in ("o_orderdate", "o_orderstatus"):
        engine.label("COLUMN", f"generalized_orders.{c}", "INDIRECT IDENTIFIER", policy="k_anonymity")
    return spark.sql(f"SELECT CAST({engine.k_anonymity('generalized_orders')} AS bigint) AS k")


@query("SELECT * FROM (VALUES ('public.customer', 'c_name', 'name', TRUE), ('public.supplier', 's_name', 'name', TRUE), ('public.events', 'user_id', 'account_id', FALSE)) t(table_name, column_name, identifiers_category, direct)")
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_for(spark, sf_dir).detect("en_US")


# masked roles' queries

_HANDMADE = "WITH customer AS (SELECT c_custkey, md5(c_name) AS c_name, c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, 'CONFIDENTIAL' AS c_mktsegment FROM main.customer), orders AS (SELECT o_orderkey, o_custkey, o_orderstatus, 0.0::DOUBLE AS o_totalprice, o_orderdate, o_orderpriority FROM main.orders) "


def role_engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = engine_for(spark, sf_dir, transparent_dynamic_masking=True, masking_policies=["second"])
    engine.label("COLUMN", "customer.c_name", f("anon.md5(c_name)"))
    engine.label("COLUMN", "customer.c_acctbal", "MASKED WITH VALUE NULL")
    engine.label("COLUMN", "customer.c_mktsegment", "MASKED WITH VALUE 'CONFIDENTIAL'")
    engine.label("COLUMN", "orders.o_totalprice", "MASKED WITH VALUE 0")
    engine.label("COLUMN", "customer.c_name", f("anon.upper(c_name)"), policy="second")
    for role in ("analyst", "auditor", "owner"):
        engine.create_role(role)
    engine.label("ROLE", "analyst", "MASKED")
    engine.label("ROLE", "auditor", "MASKED", policy="second")
    return engine


_DYNAMIC = {
    "dyn_filter": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey < 50 AND c_mktsegment = 'CONFIDENTIAL'",
    "dyn_join_masked_keys": "SELECT a.c_name AS c_name, count(*) AS n FROM customer a JOIN public.customer b ON a.c_name = b.c_name GROUP BY a.c_name",
    "dyn_join": "SELECT c_name, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name",
    "dyn_cte": "WITH c AS (SELECT c_nationkey, c_mktsegment FROM customer) SELECT c_nationkey, c_mktsegment, count(*) AS n FROM c GROUP BY c_nationkey, c_mktsegment",
    "dyn_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal IS NULL AND c_nationkey = 3)",
    "dyn_scalar_subquery": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'CONFIDENTIAL') AS n FROM nation",
    "dyn_union": "SELECT c_mktsegment AS x FROM customer UNION SELECT o_orderstatus FROM orders",
    "dyn_window": "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS rn FROM customer",
    "dyn_rollup": "SELECT coalesce(c_nationkey, -1) AS c_nationkey, coalesce(c_mktsegment, 'all') AS c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)",
    "dyn_table": "SELECT c_custkey, c_mktsegment FROM (TABLE customer) t",
    "dyn_qualified": "SELECT public.customer.c_custkey, public.customer.c_name AS c_name FROM public.customer",
    "dyn_unmasked_table": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey",
}


def _public(sql: str) -> str:
    sql = sql.replace("public.customer.", "customer.")
    return _HANDMADE + (", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else sql).replace("public.", "")


for _name, _sql in _DYNAMIC.items():
    query(_public(_sql), _name)(lambda spark, sf_dir, sql=_sql: role_engine(spark, sf_dir).session("analyst").sql(sql))


@query("SELECT TRUE AS refused, count(*) AS n, count(DISTINCT c_mktsegment) AS kinds FROM (SELECT 'CONFIDENTIAL' AS c_mktsegment FROM customer)")
def dyn_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables, which would shift the rewriting, are refused; so are files and unknown tables."""
    session = role_engine(spark, sf_dir).session("analyst")
    refused = 0
    for sql in ("SELECT '${spark.sql.shuffle.partitions}', c_name /*            */ FROM customer", f"SELECT * FROM parquet.`{sf_dir}/customer.parquet`", "TABLE missing"):
        try:
            session.sql(sql)
        except InsufficientPrivilege:
            refused += 1
    return session.sql("SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS kinds FROM customer").withColumn("refused", F.lit(refused == 3))


@query("SELECT c_custkey, c_name FROM (SELECT c_custkey, md5(c_name) AS c_name FROM customer) ORDER BY c_custkey LIMIT 7")
def dyn_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven rows that a masked role fetches from a cursor."""
    session = role_engine(spark, sf_dir).session("analyst")
    session.declare_cursor("c", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey")
    rows = session.fetch("c", 4) + session.fetch("c", 3)
    session.close_cursor("c")
    return spark.createDataFrame(rows, "c_custkey long, c_name string")


@query("SELECT c_custkey, upper(c_name) AS c_name, c_mktsegment FROM customer")
def dyn_second_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_engine(spark, sf_dir).session("auditor").sql("SELECT c_custkey, c_name, c_mktsegment FROM customer")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def dyn_unmasked_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_engine(spark, sf_dir).session("owner").sql("SELECT c_custkey, c_name, c_acctbal FROM customer")


@query("SELECT upper(n_name) AS n_name, n_regionkey FROM nation WHERE n_regionkey < 2")
def dyn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view has rules of its own; its table's don't count."""
    engine = role_engine(spark, sf_dir)
    engine.label("COLUMN", "nation.n_name", "MASKED WITH VALUE 'hidden'")
    engine.register("near", engine.table("nation").where("n_regionkey < 2"), is_view=True)
    engine.label("COLUMN", "near.n_name", f("anon.upper(n_name)"))
    return engine.session("analyst").sql("SELECT n_name, n_regionkey FROM near")


@query("SELECT o_orderkey, '2000-01-01' AS o_orderday FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def rls_before_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row policies see authentic values."""
    engine = role_engine(spark, sf_dir)
    days = engine.table("orders").withColumn("o_orderday", F.col("o_orderdate").cast("date"))
    engine.register("days", days, row_policies=[("NOT anon.hasmask('analyst') OR o_orderday >= DATE '1996-01-01'", None)])
    engine.label("COLUMN", "days.o_orderday", f("anon.ternary(true, DATE '2000-01-01', NULL)"))
    return engine.session("analyst").sql("SELECT o_orderkey, CAST(o_orderday AS string) AS o_orderday FROM days")


@query("SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS text FROM documents")
def text_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masking function of one's own."""
    engine = engine_for(spark, sf_dir)
    engine.register_function("own.redact", lambda x: f"regexp_replace({x}, '[0-9]+', '#')", trusted=True)
    engine.label("COLUMN", "documents.text", f("own.redact(text)"))
    return engine.masked("documents").select("doc_id", "text")


# whole tables


@query("SELECT c_custkey, md5(c_name) AS c_name, c_nationkey FROM customer")
def static_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anonymize_table() on a registered table."""
    engine = engine_for(spark, sf_dir)
    engine.label("COLUMN", "customer.c_name", f("anon.md5(c_name)"))
    assert engine.anonymize_database()
    return engine.table("customer").select("c_custkey", "c_name", "c_nationkey")


def rewritten(fmt: str) -> None:
    """Registers: anonymize_table() on files of a format, partitioned by nation, read back from the files."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, path = engine_for(spark, sf_dir), shared_path(spark, "static")
        options = {"header": "true"} if fmt == "csv" else {}
        engine.table("customer").select("c_custkey", "c_name", "c_nationkey").write.partitionBy("c_nationkey").format(fmt).options(**options).save(path)
        engine.register("copy", path, fmt=fmt, options=options)
        engine.label("COLUMN", "copy.c_name", f("anon.md5(c_name)"))
        assert engine.anonymize_table("copy")
        return spark.read.format(fmt).options(**options).load(path).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))

    query("SELECT c_custkey, md5(c_name) AS c_name, c_nationkey FROM customer", f"static_{fmt}")(run)


for _fmt in ("csv", "json", "orc", "parquet"):
    rewritten(_fmt)


def masked_files(fmt: str) -> None:
    """Registers: a masked role's query over files of a format."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, path = role_engine(spark, sf_dir), shared_path(spark, "files")
        options = {"header": "true", "inferSchema": "true"} if fmt == "csv" else {}
        engine.table("supplier").write.format(fmt).options(**options).save(path)
        engine.register("log", path, fmt=fmt, options=options)
        engine.label("COLUMN", "log.s_name", f("anon.partial(s_name, 1, '*', 2)"))
        return engine.session("analyst").sql("SELECT CAST(s_suppkey AS bigint) AS s_suppkey, s_name FROM log")

    query("SELECT s_suppkey, left(s_name, 1) || '*' || right(s_name, 2) AS s_name FROM supplier", f"masked_{fmt}")(run)


for _fmt in ("csv", "json"):
    masked_files(_fmt)


@query("SELECT c_custkey, substring(c_name, 1, 1) || '**' AS c_name FROM customer")
def legacy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.label("COLUMN", "customer.c_name", f("anon.partial(c_name, 1, '**', 0)"))
    engine.legacy.start()
    out = spark.table("mask_customer").select("c_custkey", "c_name")
    engine.legacy.stop()
    return out


@query("SELECT count(*) AS n, sum(l_partkey)::BIGINT AS total, count(DISTINCT l_partkey) AS kinds, sum(l_orderkey)::BIGINT AS orders, TRUE AS moved FROM lineitem")
def shuffle_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    before = engine.table("lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)"))).first()[0]
    engine.shuffle_column("lineitem", "l_partkey", "l_orderkey", seed=7)
    after = engine.table("lineitem").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("total"), F.countDistinct("l_partkey").alias("kinds"), F.sum("l_orderkey").alias("orders"), F.sum(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").cast("decimal(38,0)")).alias("t"))
    return after.select("n", "total", "kinds", "orders", (F.col("t") != F.lit(before)).alias("moved"))


def holds(df: DataFrame, checks: dict[str, tuple]) -> DataFrame:
    """(function, n, ok): checks maps a name to (Column, predicate in SQL over x)."""
    names = list(checks)
    drawn = df.select(*(c.alias(f"x{i}") for i, (c, _) in enumerate(checks.values())))
    agg = drawn.agg(F.count("*").alias("n"), *(F.expr(f"bool_and(coalesce({p.replace('{x}', f'x{i}')}, false))").alias(f"ok{i}") for i, (_, p) in enumerate(checks.values())))
    pairs = F.array(*(F.struct(F.lit(k).alias("function"), F.col(f"ok{i}").alias("ok")) for i, k in enumerate(names)))
    return agg.select("n", F.explode(pairs).alias("p")).select("p.function", "n", "p.ok")


def invariant(name: str, table: str, checks: dict[str, str], **conf) -> None:
    """Registers: every call of checks {call: predicate over {x}} holds for every row of the table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_for(spark, sf_dir, **conf)
        df = engine.table(table)
        return holds(df, {call: (engine.expression(call, df), predicate) for call, predicate in checks.items()})

    rows = ", ".join("('{}')".format(k.replace("'", "''")) for k in checks)
    query(f"SELECT function, (SELECT count(*) FROM {table}) AS n, TRUE AS ok FROM (VALUES {rows}) t(function)", name)(run)


invariant("noise_inv", "lineitem", {
    "anon.noise(l_quantity, 0.2)": "{x} IS NOT NULL AND {x} >= 0", "anon.noise(l_partkey, 0.5)": "{x} >= 0", "anon.noise(50, 0.4)": "{x} BETWEEN 30 AND 70", "anon.noise(CAST(2147483647 AS int), 0.9)": "{x} BETWEEN 0 AND 2147483647",
    "anon.noise(CAST(100 AS decimal(5,2)), 0.1)": "{x} BETWEEN 90 AND 110", "anon.dnoise(DATE '2019-06-01', INTERVAL '1 month')": "{x} BETWEEN DATE '2019-05-01' AND DATE '2019-07-02'",
    "anon.dnoise(l_shipdate, '2 days')": "{x} IS NOT NULL", "anon.dnoise(TIMESTAMP '2000-01-01', '1 year')": "year({x}) BETWEEN 1998 AND 2001", "anon.dnoise('23:59:00', '2 hours')": "length({x}) = 15",
})
invariant("random_inv", "customer", {
    "anon.random()": "{x} >= 0 AND {x} < 1", "anon.random_time()": "{x} RLIKE '^[0-2][0-9]:[0-5][0-9]:[0-5][0-9]$'", "anon.random_date()": "{x} BETWEEN TIMESTAMP '1900-01-01' AND current_timestamp()",
    "anon.random_date_between('2020-01-01', '2020-12-31')": "year({x}) = 2020", "anon.random_in_int4range('[2001,2002)')": "{x} = 2001", "anon.random_in_int4range('(2001,2002)')": "{x} IS NULL", "anon.random_in_int4range('[2001,)')": "{x} IS NULL",
    "anon.random_in_int8range('[-5,5]')": "{x} BETWEEN -5 AND 5", "anon.random_in_numrange('[0.1,0.9]')": "{x} BETWEEN 0.1 AND 0.9", "anon.random_in_daterange('[2020-01-01,2021-01-01)')": "year({x}) = 2020", "anon.random_in_tsrange('[2020-01-01,2021-01-01)')": "year({x}) = 2020",
    "anon.random_in_tstzrange('[2020-01-01,2021-01-01)')": "year({x}) = 2020", "anon.random_int_between(1, 3)": "{x} BETWEEN 1 AND 3", "anon.random_bigint_between(-3, 9000000000)": "{x} BETWEEN -3 AND 9000000000", "anon.random_double_precision(0, 2)": "{x} >= 0 AND {x} < 2",
    "anon.random_real(1, 2)": "{x} BETWEEN 1 AND 2", "anon.random_number_with_format('12-##-^')": "{x} RLIKE '^12-[0-9]{2}-[1-9]$'", "anon.random_phone()": "{x} RLIKE '^0[0-9]{9}$'", "anon.random_phone('+33')": "{x} RLIKE '^[+]33[0-9]{9}$'", "anon.plop('0')": "length({x}) = 10",
    "anon.random_phone_with_format('06 ## ##')": "{x} RLIKE '^06 [0-9]{2} [0-9]{2}$'", "anon.random_zip()": "{x} RLIKE '^[0-9]{5}$'", "anon.random_string(12)": "{x} RLIKE '^[0-9A-Za-z]{12}$'", "anon.random_string('[3,6)')": "length({x}) BETWEEN 3 AND 5", "anon.random_string(0)": "{x} = ''",
    "anon.random_hash(c_name)": "length({x}) = 64", "anon.random_in(array(1, 2, 3))": "{x} IN (1, 2, 3)", "anon.random_in(ARRAY['a', 'b'])": "{x} IN ('a', 'b')", "anon.random_id()": "{x} IS NOT NULL",
})
invariant("fake_inv", "customer", {f"anon.fake_{k}()": "length({x}) > 0" for k in ("first_name", "last_name", "email", "address", "city", "company", "country", "iban", "postcode", "siret")} | {"anon.lorem_ipsum()": "size(split({x}, '\\n')) = 5", "anon.lorem_ipsum(2)": "size(split({x}, '\\n')) = 2", "anon.lorem_ipsum(words => 20)": "size(split({x}, ' ')) = 20", "anon.lorem_ipsum(characters => 7)": "length({x}) = 7"})
_ASCII = "length({x}) > 0 AND length({x}) = octet_length({x})"
invariant("dummy_inv", "supplier", {f"anon.dummy_{k}()": "length({x}) > 0" if k == "currency_symbol" else _ASCII for k in [*GENERATORS, *FRENCH, *PLAIN]} | {"anon.dummy_words('[2,5)')": "size(split({x}, ' ')) BETWEEN 2 AND 4"})
invariant("dummy_formats", "supplier", {
    "anon.dummy_isbn()": "{x} RLIKE '^[0-9]{9}[0-9X]$' AND aggregate(transform(split({x}, ''), (d, i) -> (CASE WHEN d = 'X' THEN 10 ELSE CAST(d AS int) END) * (10 - i)), 0, (a, b) -> a + b) % 11 = 0", "anon.dummy_isbn13()": "{x} RLIKE '^978[0-9]{10}$' AND aggregate(transform(split({x}, ''), (d, i) -> CAST(d AS int) * (CASE WHEN i % 2 = 0 THEN 1 ELSE 3 END)), 0, (a, b) -> a + b) % 10 = 0",
    "anon.dummy_credit_card_number()": "luhn_check({x}) AND length({x}) = 16", "anon.dummy_uuidv1()": "{x} RLIKE '^[0-9a-f]{8}-[0-9a-f]{4}-1[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'", "anon.dummy_uuidv3()": "{x} RLIKE '^[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'",
    "anon.dummy_uuidv4()": "{x} RLIKE '^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'", "anon.dummy_uuidv5()": "{x} RLIKE '^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$'", "anon.dummy_ipv4()": "{x} RLIKE '^[0-9]+([.][0-9]+){3}$'",
    "anon.dummy_mac_address()": "{x} RLIKE '^[0-9A-F]{2}(:[0-9A-F]{2}){5}$'", "anon.dummy_hex_color()": "{x} RLIKE '^#[0-9A-F]{6}$'", "anon.dummy_licence_plate()": "{x} RLIKE '^[A-Z]{2}-[0-9]{3}-[A-Z]{2}$'", "anon.dummy_bic()": "{x} RLIKE '^[A-Z]{8}$'", "anon.dummy_isin()": "{x} RLIKE '^[A-Z]{2}[0-9]{10}$'",
})
for _loc in LOCALES:
    invariant(f"dummy_locale_{_loc.lower()}", "nation", {f"anon.dummy_{k}_locale('{_loc}')": "length({x}) > 0" for k in GENERATORS} | ({} if _loc == "ar_SA" else {f"anon.dummy_words_locale('{_loc}', '[1,3)')": "length({x}) > 0"}) | ({f"anon.dummy_first_name_locale('{_loc}')": "length({x}) < octet_length({x})"} if _loc in ("ja_JP", "zh_CN", "zh_TW", "ar_SA") else {}))


@query("SELECT count(*) AS n, count(*) AS ids, (count(*) <= 2147483647) AS within FROM orders")
def random_id_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.register("orders", engine.table("orders").withColumn("o_id", F.lit(0)))
    engine.label("COLUMN", "orders.o_id", f("anon.random_id_int()"))
    return engine.masked("orders").agg(F.count("*").alias("n"), F.countDistinct("o_id").alias("ids"), (F.max("o_id") <= 2147483647).alias("within"))


@query("SELECT count(*) AS n, TRUE AS listed, TRUE AS ids FROM customer")
def random_enum_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a declared enumeration, and small consecutive ids."""
    engine = engine_for(spark, sf_dir)
    engine.register("people", engine.table("customer").withColumn("id", F.lit(0).cast("smallint")), enums={"c_mktsegment": ["red", "green"]})
    engine.label("COLUMN", "people.c_mktsegment", f("anon.random_in_enum(c_mktsegment)"))
    engine.label("COLUMN", "people.id", f("anon.random_id_smallint()"))
    listed = F.expr("bool_and(c_mktsegment IN ('red', 'green'))")
    return engine.masked("people").agg(F.count("*").alias("n"), listed.alias("listed"), F.expr("bool_and(id IS NOT NULL)").alias("ids"))


@query("SELECT TRUE AS fewer, TRUE AS some, TRUE AS hidden")
def sample_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.label("TABLE", "lineitem", "TABLESAMPLE BERNOULLI(20)")
    engine.label("COLUMN", "lineitem.l_quantity", "MASKED WITH VALUE NULL")
    n = engine.table("lineitem").count()
    part = engine.masked("lineitem").agg(F.count("*").alias("m"), F.count("l_quantity").alias("q"))
    return part.select((F.col("m") < n * 0.5).alias("fewer"), (F.col("m") > 0).alias("some"), (F.col("q") == 0).alias("hidden"))


@query("SELECT event_id, md5(user_id::VARCHAR) AS user_id, NULL::VARCHAR AS props FROM events")
def stream_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a table over a stream of files."""
    engine = engine_for(spark, sf_dir)
    engine.register("log", engine.table("events").withColumn("user_id", F.col("user_id").cast("string")))
    engine.label("COLUMN", "log.user_id", f("anon.md5(user_id)"))
    engine.label("COLUMN", "log.props", "MASKED WITH VALUE NULL")
    source = spark.readStream.schema(engine.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = mask_stream(engine, source.withColumn("user_id", F.col("user_id").cast("string")), "log")
    out = shared_path(spark, "stream")
    run = stream.select("event_id", "user_id", "props").writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


# sinks, sources, catalogue


@query("SELECT c_custkey::VARCHAR AS c_custkey, md5(c_name) AS c_name FROM customer")
def dump_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anonymous dump, read back."""
    engine = engine_for(spark, sf_dir)
    engine.label("COLUMN", "customer.c_name", f("anon.md5(c_name)"))
    paths = engine.dump(shared_path(spark, "dump"), tables=["customer", "nation"], exclude_tables=["nation"])
    return spark.read.csv(paths["public.customer"], header=True).select("c_custkey", "c_name")


@query("SELECT c_nationkey, 'x' AS c_name, count(*) AS n FROM customer GROUP BY c_nationkey")
def copy_to_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked role's export of some columns, read back."""
    engine = role_engine(spark, sf_dir)
    engine.label("COLUMN", "customer.c_name", "MASKED WITH VALUE 'x'")
    path = shared_path(spark, "copy")
    engine.session("analyst").write("customer", path, ["c_nationkey", "c_name"], fmt="parquet")
    return spark.read.parquet(path).groupBy("c_nationkey", "c_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, d.val AS c_name FROM customer LEFT JOIN (VALUES (0, 'Rome'), (1, 'Oslo'), (2, 'Lima')) d(oid, val) ON d.oid = " + _OID.format(n=2, seed="c_custkey::VARCHAR", salt=""))
def load_csv_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary loaded from a file of number, tab, value."""
    engine = engine_for(spark, sf_dir)
    path = shared_path(spark, "city")
    spark.createDataFrame([(0, "Rome"), (1, "Oslo"), (2, "Lima")], "oid int, val string").write.option("sep", "\t").csv(path)
    engine.dictionaries.load_csv("city", path)
    engine.label("COLUMN", "customer.c_name", f("anon.pseudo_city(c_custkey)"))
    return engine.masked("customer").select("c_custkey", "c_name")


@query("SELECT r_regionkey, 'anonymized' AS r_name FROM region")
def anonymize_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.label("COLUMN", "region.r_name", "MASKED WITH VALUE 'anonymized'")
    engine.label("COLUMN", "region.r_regionkey", "MASKED WITH VALUE NULL")
    engine.anonymize_column("region", "r_name")
    return engine.table("region")


@query("SELECT count(*) AS n, TRUE AS near, TRUE AS days FROM lineitem")
def noise_columns_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_for(spark, sf_dir)
    engine.register("lines", engine.table("lineitem").selectExpr("l_quantity", "l_quantity AS q", "l_shipdate", "l_shipdate AS d"))
    engine.add_noise_on_numeric_column("lines", "q", 0.25)
    engine.add_noise_on_datetime_column("lines", "d", "3 days")
    near = F.expr("bool_and(abs(q - l_quantity) <= 0.2501 * l_quantity)")
    days = F.expr("bool_and(abs(datediff(d, l_shipdate)) <= 3)")
    return engine.table("lines").agg(F.count("*").alias("n"), near.alias("near"), days.alias("days"))


@query("SELECT * FROM (VALUES ('expressions', '`r_regionkey` AS `r_regionkey`, CAST(NULL AS string) AS `r_name`'), ('value', 'CAST(NULL AS string)'), ('schema', 'anon'), ('filters', '`r_regionkey` AS `r_regionkey`, CAST(NULL AS string) AS `r_name`')) t(what, sql)")
def masking_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules compile to, as text."""
    from ..operators.views import mask_filters

    engine = engine_for(spark, sf_dir)
    engine.label("COLUMN", "region.r_name", "MASKED WITH VALUE NULL")
    rows = [("expressions", engine.masking_expressions("region")), ("value", engine.masking_value("region", "r_name")), ("schema", engine.get_function_schema("anon.md5(r_name)")), ("filters", mask_filters(engine, "region"))]
    return spark.createDataFrame(rows, "what string, sql string")


@query("SELECT * FROM (VALUES ('analyst', TRUE), ('auditor', FALSE), ('owner', FALSE)) t(rolname, hasmask)")
def masked_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_engine(spark, sf_dir).masked_roles()


@query("SELECT * FROM (VALUES ('r_regionkey', NULL, 'int'), ('r_name', 'anon.md5(r_name)', 'string')) t(attname, masking_filter, format_type)")
def mask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import views

    engine = engine_for(spark, sf_dir)
    engine.label("COLUMN", "region.r_name", f("anon.md5(r_name)"))
    return views.mask_columns(engine, "region")


_CATALOGUE = {
    "policies": "anon,second", "subquery": "SELECT * FROM (SELECT `r_regionkey` AS `r_regionkey`, CAST(NULL AS string) AS `r_name` FROM public.region) AS anon_alias_", "default": "'none'", "exists": "true", "missing": "false", "schema": "public", "relname": "region", "policy": "second",
    "trusted": "true", "untrusted": "refused", "masks": "0", "roles": "false", "initialized": "true", "unloaded": "false", "identifier": "public.region.r_name", "version": "true",
}


@query("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in _CATALOGUE.items()) + ") t(what, value)")
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, policies, trust, defaults, identifiers and the removal of masks, as the engine reports them."""
    engine = role_engine(spark, sf_dir)
    engine.register("region", engine.table("region"), defaults={"r_name": "'none'"})
    engine.label("COLUMN", "region.r_name", "MASKED WITH VALUE NULL")
    engine.label("COLUMN", "region.r_name", "INDIRECT IDENTIFIER", policy="k_anonymity")
    engine.register_function("outfit.mask", lambda x: x, trusted=True)
    engine.register_function("outfit.cape", lambda x: x)
    trusted = engine.trusted_functions().where("schema = 'outfit' AND function = 'mask'").count() == 1
    try:
        engine.conf.restrict_to_trusted_schemas = True
        engine.label("COLUMN", "region.r_regionkey", f("outfit.cape(r_regionkey)"))
        untrusted = "accepted"
    except MaskingError:
        untrusted = "refused"
    found = engine.identifiers().first()
    out = {
        "policies": ",".join(engine.policies()), "subquery": engine.masking_subquery("region")[:-32], "default": engine.default_of("region", "r_name"), "exists": engine.column_exists("region", "r_name"), "missing": engine.column_exists("region", "x"), "schema": engine.get_schema("region"),
        "relname": engine.get_relname("public.region"), "policy": engine.masking_policy("auditor"), "trusted": trusted, "untrusted": untrusted, "identifier": ".".join(found[:3]), "version": bool(engine.version()), "initialized": engine.dictionaries.is_initialized(),
    }
    engine.remove_masks_for_all_columns()
    engine.remove_masks_for_all_roles()
    engine.dictionaries.unload()
    out |= {"masks": engine.masking_rules().count(), "roles": engine.hasmask("analyst"), "unloaded": engine.dictionaries.is_initialized()}
    return spark.createDataFrame([(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in out.items()], "what string, value string")


@query("SELECT c_custkey, 'CONFIDENTIAL' AS c_mktsegment FROM customer WHERE c_nationkey = 5")
def dyn_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with a parameter."""
    return role_engine(spark, sf_dir).session("analyst").sql("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = :nation", args={"nation": 5})


@query("SELECT n_nationkey, TRUE AS same_size, TRUE AS changed FROM nation")
def image_blur_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkered bitmaps, blurred: the same header and size, other pixels."""
    engine = engine_for(spark, sf_dir)
    rows = b"".join((b"\x00" * 3 + b"\xff" * 3) * 4 for _ in range(8))
    image = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    df = engine.table("nation").withColumn("image", F.lit(bytearray(image)))
    df = df.withColumn("blurred", engine.expression("anon.image_blur(image, 1.5)", df))
    return df.select("n_nationkey", (F.length("blurred") == len(image)).alias("same_size"), (F.col("blurred") != F.col("image")).alias("changed"))


@query("SELECT c_nationkey, substring(c_name, 1, 2) || '******' || right(c_name, 3) AS c_name, count(*) AS n, CAST(NULL AS DOUBLE) AS total, 'CONFIDENTIAL' AS segment FROM customer GROUP BY 1, 2")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked role's aggregate over customers."""
    engine = engine_for(spark, sf_dir, transparent_dynamic_masking=True)
    engine.label("COLUMN", "customer.c_name", f("anon.partial(c_name, 2, '******', 3)"))
    engine.label("COLUMN", "customer.c_mktsegment", "MASKED WITH VALUE 'CONFIDENTIAL'")
    engine.label("COLUMN", "customer.c_acctbal", "MASKED WITH VALUE NULL")
    engine.create_role("analyst")
    engine.label("ROLE", "analyst", "MASKED")
    return engine.session("analyst").sql("SELECT c_nationkey, c_name, count(*) AS n, sum(c_acctbal) AS total, min(c_mktsegment) AS segment FROM customer GROUP BY c_nationkey, c_name")
