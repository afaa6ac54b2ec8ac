"""Masked roles, static masking, dumps, whole-column operators, analytics."""

import pytest
from maskspark import Engine, EngineConf
from maskspark.errors import FeatureDisabled, InsufficientPrivilege, MaskingError, UnknownObject
from maskspark.operators.static import check_constraints
from maskspark.streaming import mask_stream

ROWS = [(1, "Ada", 10), (2, "Bob", 20), (3, "Cid", 30)]


@pytest.fixture
def engine(spark):
    e = Engine(spark, EngineConf(transparent_dynamic_masking=True))
    e.register("t", spark.createDataFrame(ROWS, "id int, name string, n int"))
    e.register("u", spark.createDataFrame([(1, "x")], "id int, secret string"))
    e.register("other.t", spark.createDataFrame(ROWS, "id int, name string, n int"))
    e.label("COLUMN", "t.name", "MASKED WITH VALUE 'hidden'")
    e.label("COLUMN", "u.secret", "MASKED WITH VALUE NULL")
    e.create_role("masked")
    e.create_role("plain", {"masked"})
    e.label("ROLE", "masked", "MASKED")
    return e


@pytest.mark.parametrize("sql, expected", [
    ("SELECT name FROM t WHERE id = 1", [("hidden",)]),
    ("SELECT t.name FROM public.t", [("hidden",)] * 3),
    ("SELECT x.name FROM t AS x JOIN t y USING (id) WHERE x.id = 2", [("hidden",)]),
    ("WITH t AS (SELECT * FROM t) SELECT DISTINCT name FROM t", [("hidden",)]),
    ("WITH a AS (SELECT name FROM t), b AS (SELECT * FROM a) SELECT max(name) AS m FROM b", [("hidden",)]),
    ("SELECT count(*) AS n FROM t WHERE name = 'Ada'", [(0,)]),
    ("SELECT (SELECT max(name) FROM t) AS m", [("hidden",)]),
    ("SELECT id FROM u WHERE EXISTS (SELECT 1 FROM t WHERE t.id = u.id AND name = 'hidden')", [(1,)]),
    ("SELECT name FROM (SELECT * FROM t) s WHERE id IN (SELECT id FROM u)", [("hidden",)]),
    ("SELECT name FROM t WHERE id = 1 UNION ALL SELECT secret FROM u", [("hidden",), (None,)]),
    ("SELECT id FROM range(2)", [(0,), (1,)]),
    ("SELECT id, rank() OVER w AS r FROM t WINDOW w AS (PARTITION BY (SELECT max(name) FROM t) ORDER BY id)", [(1, 1), (2, 2), (3, 3)]),
    ("SELECT s.name FROM u, LATERAL (SELECT name FROM t WHERE t.id = u.id) s", [("hidden",)]),
    ("SELECT k, name FROM t LATERAL VIEW explode(array(1, 2)) e AS k WHERE id = 1 ORDER BY k", [(1, "hidden"), (2, "hidden")]),
    ("SELECT 'FROM t' AS t", [("FROM t",)]),
    ("TABLE t", [(1, "hidden", 10), (2, "hidden", 20), (3, "hidden", 30)]),
    ("SELECT name FROM (TABLE t) s WHERE id = 1 UNION ALL (SELECT secret FROM (TABLE u) x)", [("hidden",), (None,)]),
    ("SELECT public.t.name FROM public.t WHERE public.t.id = 1", [("hidden",)]),
    ("SELECT public.t.* FROM public.t JOIN u ON public.t.id = u.id", [(1, "hidden", 10)]),
    ("SELECT public.t.name AS a, other.t.name AS b FROM public.t JOIN other.t ON public.t.id = other.t.id WHERE other.t.id = 2", [("hidden", "Bob")]),
    ("SELECT '\U0001f600' AS x, name FROM t WHERE id = 1 /* \U0001f600 */", [("\U0001f600", "hidden")]),
    ("SELECT name, row_number() OVER (ORDER BY id) AS r FROM t ORDER BY id LIMIT 1", [("hidden", 1)]),
])
def test_masked_queries(engine, sql, expected):
    assert [tuple(r) for r in engine.session("masked").sql(sql).collect()] == expected


@pytest.mark.parametrize("sql", [
    "EXPLAIN SELECT * FROM t", "TRUNCATE TABLE t", "INSERT INTO t VALUES (1, 'a', 2)", "CREATE TABLE x AS SELECT * FROM t", "CREATE TEMPORARY VIEW v AS SELECT 1", "DROP TABLE t", "SHOW TABLES", "SET x = 1", "DESCRIBE t", "CACHE TABLE t", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM no_such_table",
    "SELECT reflect('java.lang.System', 'getenv', 'PATH')", "SELECT * FROM IDENTIFIER('t')", "WITH a AS (SELECT * FROM parquet.`/x`) SELECT * FROM a", "SELECT (SELECT max(x) FROM json.`/x`)", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT TRANSFORM(name) USING 'cat' AS (x) FROM t", "SELECT rank() OVER w FROM t WINDOW w AS (ORDER BY (SELECT max(x) FROM parquet.`/x`))",
])
def test_refused(engine, sql):
    with pytest.raises(InsufficientPrivilege):
        engine.session("masked").sql(sql)


def test_sessions(engine):
    s = engine.session("masked")
    assert {r.name for r in s.table("t").collect()} == {"hidden"}
    for refused in (s.explain, s.truncate, s.insert, s.label):
        with pytest.raises(InsufficientPrivilege, match="role is masked"):
            refused("t")
    assert len(s.settings()) == 6
    assert {r.name for r in engine.session("plain").table("t").collect()} == {"Ada", "Bob", "Cid"}
    assert [(r.rolname, r.hasmask) for r in engine.masked_roles().collect()] == [("masked", True), ("plain", False)]
    assert not engine.hasmask(None)
    with pytest.raises(UnknownObject):
        engine.hasmask("nobody")


def test_no_view_is_left_behind(engine, spark):
    before = len(spark.catalog.listTables())
    engine.session("masked").sql("SELECT * FROM t").collect()
    assert len(spark.catalog.listTables()) == before


def test_policies(engine):
    engine.conf.masking_policies = ["other"]
    engine.label("COLUMN", "t.name", "MASKED WITH FUNCTION anon.upper(name)", policy="other")
    engine.create_role("second")
    engine.label("ROLE", "second", "MASKED", policy="other")
    assert engine.masking_policy("second") == "other" and engine.masking_policy("masked") == "anon"
    assert engine.session("second").sql("SELECT max(name) AS m FROM t").first().m == "CID"
    engine.label("ROLE", "second", "MASKED")
    assert engine.masking_policy("second") == "anon"


def test_static_masking_of_files(engine, spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(1, "a", 100.0, 39.4), (2, "b", None, None)], "id int, name string, cm double, inch double").write.parquet(path)
    engine.register("files", path, generated={"inch": "round(cm / 2.54, 1)"})
    assert engine.anonymize_table("files") is None
    with pytest.warns(UserWarning, match="no masking rule"):
        assert engine.anonymize_column("files", "name") is False
    engine.label("COLUMN", "files.cm", "MASKED WITH VALUE 188")
    engine.label("COLUMN", "files.name", "MASKED WITH FUNCTION anon.md5(name)")
    assert engine.anonymize_column("files", "cm")
    assert {(r.name, r.inch) for r in spark.read.parquet(path).collect()} == {("a", 74.0), ("b", 74.0)}
    assert engine.anonymize_database()
    assert spark.read.parquet(path).where("length(name) = 32").count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    engine.conf.static_masking = False
    with pytest.raises(FeatureDisabled):
        engine.anonymize_table("files")


def test_sampled_static_masking(engine, spark):
    engine.register("hundred", spark.range(1000).toDF("h"))
    engine.label("TABLE", "hundred", "TABLESAMPLE BERNOULLI(20)")
    assert engine.anonymize_table("hundred") and 100 < engine.table("hundred").count() < 320


def test_constraints(spark):
    df, other = spark.createDataFrame([(1, None), (1, 5)], "a int, b int"), spark.createDataFrame([(1,)], "k int")
    assert check_constraints(df, unique=[["a"]], not_null=["a", "b"], references=[("a", other, "k"), ("b", other, "k")]) == ["b has nulls", "a isn't unique", "b has values that k lacks"]


def test_dump(engine, spark, tmp_path):
    paths = engine.dump(str(tmp_path / "out"), tables=["public.t"])
    assert list(paths) == ["public.t"]
    assert {r.name for r in spark.read.csv(paths["public.t"], header=True).collect()} == {"hidden"}
    assert list(engine.dump(str(tmp_path / "two"), exclude_tables=["t"], fmt="parquet")) == ["public.u"]
    engine.session("masked").write("t", str(tmp_path / "three"), ["name"])
    assert spark.read.csv(str(tmp_path / "three"), header=True).columns == ["name"]


def test_shuffle_and_noise(engine, spark):
    engine.register("s", spark.range(500).selectExpr("id", "CAST(id * 3 AS int) AS v", "DATE '2020-01-01' AS d"))
    before = engine.table("s").collect()
    engine.shuffle_column("s", "v", "id", seed=1)
    after = sorted(engine.table("s").collect())
    assert sorted(r.v for r in after) == sorted(r.v for r in before) and [r.id for r in after] == list(range(500))
    assert sum(a.v == b.v for a, b in zip(after, sorted(before))) < 20
    engine.add_noise_on_numeric_column("s", "v", 0.1)
    engine.add_noise_on_datetime_column("s", "d", "10 days")
    noisy = {r.id: r for r in engine.table("s").collect()}
    assert all(abs(noisy[r.id].v - r.v) <= 0.1 * r.v + 1 and abs((noisy[r.id].d - r.d).days) <= 10 for r in after)
    for call in (lambda: engine.shuffle_column("s", "zz", "id"), lambda: engine.add_noise_on_numeric_column("s", "zz", 0.1)):
        with pytest.raises(MaskingError, match='Column "zz" does not exist'):
            call()
    with pytest.raises(MaskingError, match="between 0 and 1"):
        engine.add_noise_on_numeric_column("s", "v", 2)


def test_shuffle_of_many_equal_rows(engine, spark):
    engine.register("same", spark.createDataFrame([(1, 7)] * 50 + [(2, 8)] * 50, "k int, v int"))
    engine.shuffle_column("same", "v", "k")
    assert sorted(r.v for r in engine.table("same").collect()) == [7] * 50 + [8] * 50


def test_unique_ids(engine, spark):
    engine.register("ids", spark.range(1000).selectExpr("CAST(0 AS int) AS a", "CAST(0 AS smallint) AS b", "0L AS c").repartition(7))
    for column, call in (("a", "anon.random_id_int()"), ("b", "anon.random_id_smallint()"), ("c", "anon.random_id()")):
        engine.label("COLUMN", f"ids.{column}", f"MASKED WITH FUNCTION {call}")
    rows = engine.masked("ids").collect()
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == len({r.c for r in rows}) == 1000


def test_k_anonymity(engine, spark):
    rows = [("a", 1)] * 3 + [("b", None)] * 2 + [("b", 2)] * 4
    engine.register("k", spark.createDataFrame(rows, "x string, y int"))
    with pytest.warns(UserWarning, match="no identifier"):
        assert engine.k_anonymity("k") is None
    engine.label("COLUMN", "k.x", "QUASI IDENTIFIER", policy="k_anonymity")
    assert engine.k_anonymity("k") == 3
    engine.label("COLUMN", "k.y", "indirect identifier", policy="k_anonymity")
    assert engine.k_anonymity("k") == 2 and engine.identifiers().count() == 2
    engine.register("k", spark.createDataFrame([], "x string, y int"))
    assert engine.k_anonymity("k") is None


def test_dictionaries(engine, spark, tmp_path):
    d = engine.dictionaries
    assert not d.is_initialized() and d.init(None) is None
    (tmp_path / "city.csv").write_text("0\tRome\n1\tOslo\n")
    (tmp_path / "bad.csv").write_text("x\ty\n")
    assert d.load_csv("city", str(tmp_path / "city.csv")) and d.values("city") == ["Rome", "Oslo"]
    with pytest.warns(UserWarning, match="can't be loaded"):
        assert d.load_csv("iban", str(tmp_path / "none.csv")) is False
    with pytest.warns(UserWarning, match="can't be loaded"):
        assert d.load_csv("iban", str(tmp_path / "bad.csv")) is False
    with pytest.warns(UserWarning, match="already initialized"):
        assert d.init()
    d.reset()
    assert not d.is_initialized() and d.init() and all(d.values(k) for k in ("city", "siret"))


def test_legacy_views(engine, spark):
    engine.legacy.start()
    assert {r.name for r in spark.table("mask_t").collect()} == {"hidden"}
    assert [(r.attname, r.masking_filter) for r in __import__("maskspark.operators.views", fromlist=["x"]).mask_columns(engine, "t").collect()][1] == ("name", "'hidden'")
    engine.legacy.mask_role("plain")
    assert {r.name for r in engine.legacy.table("plain", "t").collect()} == {"hidden"}
    engine.legacy.unmask_role("plain")
    assert "Ada" in {r.name for r in engine.legacy.table("plain", "t").collect()}
    engine.legacy.stop()
    assert not engine.hasmask("masked") and not spark.catalog.tableExists("mask_t")
    engine.register("v", engine.table("t"), is_view=True)
    with pytest.raises(MaskingError, match="Masking a view"):
        engine.legacy.create_view("v")


def test_streams_refuse_consecutive_ids(engine, spark, tmp_path):
    stream = spark.readStream.schema("id int, name string, n int").parquet(str(tmp_path))
    assert mask_stream(engine, stream, "t").isStreaming
    engine.label("COLUMN", "t.id", "MASKED WITH FUNCTION anon.random_id_int()")
    with pytest.raises(MaskingError):
        mask_stream(engine, stream, "t")


def test_constant_masks_prune_the_scan(engine, spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame(ROWS, "id int, name string, n int").write.parquet(path)
    engine.register("p", path)
    engine.label("COLUMN", "p.name", "MASKED WITH VALUE 'x'")
    plan = engine.session("masked").sql("SELECT name, id FROM p WHERE id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in plan


def test_variables_do_not_shift_the_rewriting(engine, spark, tmp_path):
    """The parser substitutes variables before it counts places."""
    spark.createDataFrame(ROWS, "id int, name string, n int").write.parquet(f"{tmp_path}/raw")
    spark.createDataFrame(ROWS, "id int, name string, n int").createOrReplaceTempView("t")
    variable = "${spark.sql.shuffle.partitions}"
    for sql in (f"SELECT '{variable}' AS c, name /* {' ' * 40} */ FROM t", f"SELECT '{variable}' AS c, '{variable}', * /* {' ' * 30} FROM parquet.`{tmp_path}/raw` -- */ FROM t", "SELECT '${spark.app.name}' AS c", "SELECT '${' AS c"):
        with pytest.raises(InsufficientPrivilege):
            engine.session("masked").sql(sql)
    for sql in (f"SELECT * FROM parquet.`{tmp_path}/raw`", f"TABLE parquet.`{tmp_path}/raw`", "SELECT * FROM t /* x */ JOIN missing", "SELECT explode(array(1)) FROM (TABLE missing)"):
        with pytest.raises(InsufficientPrivilege):
            engine.session("masked").sql(sql)
    assert {r.name for r in engine.session("masked").sql("SELECT name FROM t").collect()} == {"hidden"}
    spark.catalog.dropTempView("t")


def test_cursors(engine):
    s = engine.session("masked")
    s.declare_cursor("c", "SELECT id, name FROM t ORDER BY id")
    assert [tuple(r) for r in s.fetch("c", 2)] == [(1, "hidden"), (2, "hidden")]
    assert [tuple(r) for r in s.fetch("c", 9)] == [(3, "hidden")] and s.fetch("c") == []
    with pytest.raises(MaskingError):
        s.declare_cursor("c", "SELECT 1")
    s.close_cursor("c")
    with pytest.raises(UnknownObject):
        s.fetch("c")
    with pytest.raises(InsufficientPrivilege):
        s.declare_cursor("d", "SELECT * FROM missing")


@pytest.mark.parametrize("fmt, options", [("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {})])
def test_static_masking_keeps_format_and_partitions(spark, tmp_path, fmt, options):
    path = f"{tmp_path}/table"
    spark.createDataFrame([(1, "Ada", "x"), (2, "Bob", "y"), (3, "Cid", "y")], "id int, name string, part string").write.partitionBy("part").format(fmt).options(**options).save(path)
    e = Engine(spark)
    e.register("t", path, fmt=fmt, options=options)
    e.label("COLUMN", "t.name", "MASKED WITH FUNCTION anon.partial(name, 1, '*', 0)")
    assert e.anonymize_table("t")
    rows = {("1", "A*", "x"), ("2", "B*", "y"), ("3", "C*", "y")}
    assert {(str(r.id), r.name, r.part) for r in spark.read.format(fmt).options(**options).load(path).collect()} == rows
    assert {(str(r.id), r.name, r.part) for r in e.table("t").collect()} == rows
    assert {p.name for p in (tmp_path / "table").iterdir() if p.is_dir()} == {"part=x", "part=y"} and [p.name for p in tmp_path.iterdir()] == ["table"]
    # a swap that was cut off after the old files were moved is finished when the table is registered again
    (tmp_path / "table").rename(tmp_path / "table.staged-1")
    (tmp_path / "table.old-1").mkdir()
    e.register("t", path, fmt=fmt, options=options)
    assert e.table("t").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_static_masking_refuses_what_it_cannot_write(spark, tmp_path):
    spark.createDataFrame(ROWS, "id int, name string, n int").write.parquet(f"{tmp_path}/t")
    e = Engine(spark)
    e.register("t", f"{tmp_path}/t", fmt="binaryFile")
    e.label("COLUMN", "t.path", "MASKED WITH VALUE NULL")
    with pytest.raises(MaskingError):
        e.anonymize_table("t")
