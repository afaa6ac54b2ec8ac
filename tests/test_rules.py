"""Labels, trust, and what rules compile to."""

import pytest
from maskspark import Engine, EngineConf
from maskspark.errors import InsufficientPrivilege, InvalidExpression, InvalidLabel, LabelNotSupported, UnknownObject
from maskspark.sqltext import names, tokens


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("person", spark.createDataFrame([("Ada", "L", 7), ("Bob", None, 9)], "firstname string, lastname string, age int"))
    return e


def test_labels(engine):
    for label in ("MASKED WITH VALUE NULL", " masked  with value 'x'", "MASKED WITH VALUE firstname", "MASKED WITH FUNCTION anon.md5(firstname)", "MASKED WITH FUNCTION anon.partial(firstname,1,$$x$$,\n1)", "NOT MASKED"):
        engine.label("COLUMN", "person.firstname", label)
    engine.label("TABLE", "person", "TABLESAMPLE BERNOULLI(10)")
    engine.label("DATABASE", "main", "tablesample system(33.5) REPEATABLE (7)")
    assert engine.registry.sample(("public", "person"), "anon").share == 0.1
    engine.label("TABLE", "person", None)
    assert engine.registry.sample(("public", "person"), "anon").seed == 7


@pytest.mark.parametrize("kind, name, text", [
    ("COLUMN", "person.firstname", "MASKED"), ("COLUMN", "person.firstname", "MASKED WITH VALUE foo()"), ("COLUMN", "person.firstname", "MASKED WITH VALUE CAST(0 AS INT)"), ("COLUMN", "person.firstname", "MASKED WITH VALUE 1; DROP TABLE x"),
    ("COLUMN", "person.firstname", "MASKED WITH FUNCTION 'x'"), ("COLUMN", "person.firstname", "MASKED WITH FUNCTION md5(firstname)"), ("COLUMN", "person.firstname", "MASKED WITH FUNCTION anon.md5(firstname), 1"), ("COLUMN", "person.firstname", "MASKED WITH FUNCTION anon.md5(firstname"),
    ("COLUMN", "person.firstname", "MASKED WITH FUNCTION pg_catalog.pg_ls_dir('/')"), ("COLUMN", "person.firstname", "MASKED WITH FUNCTION anon.lower(pg_catalog.pg_read_file('x'))"), ("COLUMN", "person.firstname", "MASKED WITH FUNCTION other.f(firstname)"),
    ("TABLE", "person", "TABLESAMPLE BERNOULLI"), ("TABLE", "person", "TABLESAMPLE BERNOULLI(200)"), ("TABLE", "person", "MASKED"), ("ROLE", "r", "NOT MASKED"), ("SCHEMA", "s", "UNTRUSTED"), ("FUNCTION", "s.f", "MASKED"),
])
def test_bad_labels(engine, kind, name, text):
    with pytest.raises(InvalidLabel, match="is not a valid label"):
        engine.label(kind, name, text)


def test_trust(engine):
    engine.register_function("other.f", lambda x: f"reverse({x})")
    with pytest.raises(InvalidLabel, match="does not belong in a TRUSTED schema"):
        engine.label("COLUMN", "person.firstname", "MASKED WITH FUNCTION other.f(firstname)")
    with pytest.raises(InsufficientPrivilege):
        engine.label("SCHEMA", "other", "TRUSTED", superuser=False)
    engine.label("SCHEMA", "other", "TRUSTED")
    engine.label("COLUMN", "person.firstname", "MASKED WITH FUNCTION other.f(firstname)")
    assert [r.firstname for r in engine.masked("person").collect()] == ["adA", "boB"]
    engine.label("FUNCTION", "other.f(text)", "UNTRUSTED")
    with pytest.raises(InvalidLabel, match="UNTRUSTED"):
        engine.label("COLUMN", "person.firstname", "MASKED WITH FUNCTION other.f(firstname)")
    engine.conf.set("anon.restrict_to_trusted_schemas", False)
    engine.label("FUNCTION", "other.f", None)
    engine.label("SCHEMA", "other", None)
    engine.label("COLUMN", "person.firstname", "MASKED WITH FUNCTION other.f(firstname)")


def test_unknown_objects(engine):
    with pytest.raises(UnknownObject):
        engine.label("COLUMN", "person.nothing", "NOT MASKED")
    with pytest.raises(UnknownObject):
        engine.label("COLUMN", "person.age", "NOT MASKED", policy="nowhere")
    with pytest.raises(LabelNotSupported):
        engine.label("INDEX", "x", "MASKED")
    with pytest.raises(LabelNotSupported):
        engine.label("TABLE", "person", "QUASI IDENTIFIER", policy="k_anonymity")
    with pytest.raises(InvalidLabel):
        engine.label("COLUMN", "person.age", "IDENTIFIER", policy="k_anonymity")


def test_expressions(engine):
    assert engine.masking_subquery("person") is None
    engine.label("COLUMN", "person.lastname", "MASKED WITH VALUE NULL")
    assert engine.masking_expressions("person") == "`firstname` AS `firstname`, CAST(NULL AS string) AS `lastname`, `age` AS `age`"
    assert engine.masking_value("person", "lastname") == "CAST(NULL AS string)" and engine.masking_value("person", "gone") is None
    engine.conf.set("strict_mode", False)
    assert engine.masking_value("person", "lastname") == "NULL"
    engine.label("TABLE", "person", "TABLESAMPLE BERNOULLI(10)")
    assert "TABLESAMPLE (10 PERCENT)) AS anon_alias_" in engine.masking_subquery("person")


def test_strict_casts(engine, spark):
    engine.register("t", spark.createDataFrame([(1, "a", "b")], "n int, v string, c string"), types={"v": "varchar(3)", "c": "char(5)"})
    engine.label("COLUMN", "t.n", "MASKED WITH FUNCTION anon.ternary(true, 2.5D, 0D)")
    engine.label("COLUMN", "t.v", "MASKED WITH VALUE 'abcdef'")
    engine.label("COLUMN", "t.c", "MASKED WITH VALUE 'xy'")
    assert tuple(engine.masked("t").first()) == (2, "abc", "xy   ")
    engine.label("COLUMN", "t.n", "MASKED WITH FUNCTION anon.ternary(true, 2.5, 0.0)")
    assert engine.masked("t").first().n == 3


def test_masks_read_authentic_values(engine, spark):
    """Swapping two columns works, since all masks read the old row."""
    engine.label("COLUMN", "person.firstname", "MASKED WITH VALUE lastname")
    engine.label("COLUMN", "person.lastname", "MASKED WITH VALUE firstname")
    assert [tuple(r)[:2] for r in engine.masked("person").collect()] == [("L", "Ada"), (None, "Bob")]


def test_renames_and_drops(engine):
    engine.label("COLUMN", "person.lastname", "MASKED WITH VALUE NULL")
    engine.registry.rename_table("person", "human")
    assert engine.masked("human").where("lastname IS NOT NULL").count() == 0
    engine.registry.drop_table("human")
    assert engine.masking_rules().count() == 0


def test_small_things(engine):
    assert engine.get_function_schema("anon.f(1)") == "anon" and engine.get_function_schema("f(1)") == ""
    for bad, message in (("", "is empty"), ("a", "is not a valid function call")):
        with pytest.raises(InvalidExpression, match=message):
            engine.get_function_schema(bad)
    assert engine.get_schema('"A b".c') == "A b" and engine.get_relname("X.Y") == "y" and engine.column_exists("person", "age")
    assert names('a."B".c') == ["a", "B", "c"] and tokens("$$it's$$")[0].text == "'it\\'s'"
    assert engine.version() and engine.trusted_functions().where("function = 'md5'").count() == 1
    with pytest.raises(KeyError):
        engine.conf.set("anon.nothing", 1)


def test_privacy_by_default_view(spark):
    e = Engine(spark, EngineConf(privacy_by_default=True))
    e.register("t", spark.createDataFrame([(1, 2)], "a int, b int"), defaults={"a": "5"})
    e.label("COLUMN", "t.b", "NOT MASKED")
    assert tuple(e.masked("t").first()) == (5, 2)
    assert [(r.attname, r.masking_value, r.priority) for r in e.masking_rules().collect()] == [("a", "5", 0)]
