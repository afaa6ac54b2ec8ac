"""Known values of deterministic masks, and bounds of random ones."""

import datetime as dt
import struct

import numpy as np
import pytest
from maskspark import Engine, EngineConf
from maskspark.errors import InvalidExpression
from maskspark.functions import FUNCTIONS
from maskspark.functions.image import blur
from maskspark.functions.intervals import parse_interval
from maskspark.functions.ranges import parse_range


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.init()
    return e


@pytest.fixture(scope="module")
def value(engine, spark):
    df = spark.range(1)
    return lambda call: df.select(engine.expression(call, df).alias("x")).first().x


GOLDEN = [
    ("anon.partial('abcdefgh', 1, 'xxxxxx', 1)", "axxxxxxh"),
    ("anon.partial('+33142928100', 4, '******', 2)", "+331******00"),
    ("anon.partial(NULL, 1, 'x', 1)", None),
    ("anon.partial('ab', 2, '*', 2)", "ab*ab"),
    ("anon.partial('abc', 0, '*', 0)", "*"),
    ("anon.partial_email('daamien@gmail.com')", "da******@gm******.com"),
    ("anon.partial_email('big@ben.co.uk')", "bi******@be******.uk"),
    ("anon.ternary(NULL, 0, 100)", 100),
    ("anon.ternary(true, 'a', 'b')", "a"),
    ("anon.hex_to_int('123456')", 1193046),
    ("anon.hex_to_int('ffffff')", 16777215),
    ("anon.projection_to_oid('abcdefgh', '', 10000)", 9096),
    ("anon.projection_to_oid('xxxxxxxx', 'yyyyy', 10000)", 9784),
    ("anon.projection_to_oid(42, '', 10000)", 6321),
    ("anon.projection_to_oid(DATE '2020-03-24', '', 10000)", 3227),
    ("anon.digest('a', 'b', 'md5')", "187ef4436122d1cc2f40dc2b92f0eba0"),
    ("anon.digest('a', 'b', 'sha1')", None),
    ("anon.digest('a', 'b', 'sha256')", "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"),
    ("anon.digest(NULL, 'b', 'md5')", None),
    ("anon.range_text(anon.generalize_int4range(42))", "[40,50)"),
    ("anon.range_text(anon.generalize_int4range(42, 3))", "[42,45)"),
    ("anon.range_text(anon.generalize_int4range(-5))", "[0,10)"),
    ("anon.range_text(anon.generalize_int4range(-15))", "[-10,0)"),
    ("anon.range_text(anon.generalize_int4range(CAST(NULL AS int)))", "(,)"),
    ("anon.range_text(anon.generalize_int8range(4345646464646, 10000000000))", "[4340000000000,4350000000000)"),
    ("anon.range_text(anon.generalize_numrange(0.32378, 1))", "[0,1)"),
    ("anon.range_text(anon.generalize_numrange(0.6, 1))", "[1,2)"),
    ("anon.range_text(anon.generalize_tsrange(TIMESTAMP_NTZ '1904-11-07', 'week'))", "[1904-11-07 00:00:00,1904-11-14 00:00:00)"),
    ("anon.range_text(anon.generalize_daterange(DATE '1904-11-07', 'decade'))", "[1900-01-01,1910-01-01)"),
    ("anon.range_text(anon.generalize_daterange(DATE '1904-11-07', 'century'))", "[1901-01-01,2001-01-01)"),
    ("anon.range_text(anon.generalize_daterange(DATE '1904-11-07', 'millennium'))", "[1001-01-01,2001-01-01)"),
    ("anon.range_text(anon.generalize_daterange(DATE '1904-11-07', 'hour'))", "empty"),
    ("anon.range_text(anon.generalize_daterange(DATE '1904-11-07', NULL))", "(,)"),
    ("anon.random_in_int4range('[2001,2002)')", 2001),
    ("anon.random_in_int4range('(2001,2002)')", None),
    ("anon.random_in_int4range('[2001,)')", None),
    ("anon.random_string(0)", ""),
    ("anon.concat('a', NULL)", "a"),
    ("anon.concat('a', 'b', 'c')", "abc"),
    ("anon.regexp_replace('aaa', 'a', 'b')", "baa"),
    ("anon.regexp_replace('aaa', 'a', 'b', 'g')", "bbb"),
    ("anon.regexp_replace('foo1bar2', '([0-9])', '<\\1>')", "foo<1>bar2"),
    ("anon.replace('abcabc', 'b', 'x')", "axcaxc"),
    ("anon.substr('alphabet', 3, 2)", "ph"),
    ("anon.substr('alphabet', 3)", "phabet"),
    ("anon.substr('abc', 0, 2)", "a"),
    ("anon.to_char(125.8, '999D9')", " 125.8"),
    ("anon.to_char(TIMESTAMP '2002-04-20 17:31:12', 'HH12:MI:SS')", "05:31:12"),
    ("anon.to_char(INTERVAL '15 hours 2 minutes 12 seconds', 'HH24:MI:SS')", "15:02:12"),
    ("anon.to_date('05 Dec 2000', 'DD Mon YYYY')", dt.date(2000, 12, 5)),
    ("anon.date_part('day', TIMESTAMP '2001-02-16 20:38:40')", 16.0),
    ("anon.date_part('month', INTERVAL '2 years 3 months')", 3.0),
    ("anon.make_date(2013, 7, 15)", dt.date(2013, 7, 15)),
    ("anon.age(DATE '2001-04-10', DATE '1957-06-13')", "43 years 9 mons 28 days"),
    ("pg_catalog.btrim('  a ')", "a"),
    ("anon.left('abcde', 2)", "ab"),
    ("anon.right('abcde', 2)", "de"),
    ("anon.length('jose')", 4),
    ("anon.upper(anon.left('abc', 1))", "A"),
    ("anon.json_build_object('a', 1, 'b', 'x')", '{"a" : 1, "b" : "x"}'),
]


@pytest.mark.parametrize("call, expected", GOLDEN)
def test_known_values(value, call, expected):
    assert value(call) == expected


def test_salted_hash(spark):
    e = Engine(spark, EngineConf(salt="pepper", algorithm="md5"))
    df = spark.range(1)
    import hashlib

    assert df.select(e.expression("anon.hash('x')", df)).first()[0] == hashlib.md5(b"xpepper").hexdigest()
    assert "pepper" not in repr(e.conf) and "salt" not in e.conf.visible(masked=True)


def test_pseudonyms_are_stable_and_in_the_dictionary(engine, spark):
    df = spark.range(50)
    out = df.select(engine.expression("anon.pseudo_first_name(id, 's')", df).alias("a"), engine.expression("anon.pseudo_first_name(id, 's')", df).alias("b")).collect()
    assert all(r.a == r.b and r.a in engine.dictionaries.values("first_name") for r in out) and len({r.a for r in out}) > 20


def test_functions_without_dictionaries_are_null(spark):
    e, df = Engine(spark), spark.range(1)
    with pytest.warns(UserWarning, match="not initialized"):
        assert df.select(e.expression("anon.fake_city()", df)).first()[0] is None


def test_noise_keeps_its_mean(engine, spark):
    df = spark.range(20000).selectExpr("42.0D AS x")
    mean = df.select(engine.expression("anon.noise(x, 0.3)", df).alias("y")).agg({"y": "avg"}).first()[0]
    assert abs(mean - 42) < 0.5


def test_ranges_and_intervals():
    assert parse_range("'(1,10]'", "int4range").upper == "(CAST(10 AS int) + 1)"
    assert parse_range("int4range(1, 5, '[]')", "int4range").lower == "CAST(1 AS int)"
    assert parse_range("'[,5)'", "int4range").lower is None
    assert parse_interval("INTERVAL '1 year 2 months 3 days 04:05:06'") == (14, (3 * 86400 + 4 * 3600 + 5 * 60 + 6) * 10**6)
    assert parse_interval("'2 centuries'") == (2400, 0)
    for bad in ("'[1;2)'", "5"):
        with pytest.raises(InvalidExpression):
            parse_range(bad, "int4range")
    with pytest.raises(InvalidExpression):
        parse_interval("'3 parsecs'")


def test_wrong_locale_and_wrong_arguments(value):
    with pytest.raises(InvalidExpression, match="not a supported locale"):
        value("anon.dummy_city_name_locale('xx_YY')")
    with pytest.raises(InvalidExpression, match="not a supported locale"):
        value("anon.dummy_words_locale('ar_SA', '[1,2)')")
    with pytest.raises(InvalidExpression, match="takes 4 to 4"):
        value("anon.partial('a')")
    with pytest.raises(InvalidExpression, match="does not exist"):
        value("anon.no_such_function()")


def test_all_signatures_are_there():
    assert sum(k.startswith("dummy_") for k in FUNCTIONS) >= 144
    assert all(f"fake_{k}" in FUNCTIONS for k in "first_name last_name email address city company country iban postcode siret".split())


def bmp(pixels):
    h, w, _ = pixels.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels.reshape(h, w * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def test_image_blur(engine, spark):
    rng = np.random.default_rng(0)
    data = bmp(rng.integers(0, 256, (9, 8, 3), dtype=np.uint8))
    out = blur(data, 2.0)
    assert out[:54] == data[:54] and len(out) == len(data) and np.frombuffer(out[54:], np.uint8).std() < np.frombuffer(data[54:], np.uint8).std() / 2
    flat = bmp(np.full((5, 5, 3), 77, np.uint8))
    assert blur(flat, 3.0) == flat and blur(None, 1.0) is None
    df = spark.createDataFrame([(bytearray(data),), (None,)], "img binary")
    got = df.select(engine.expression("anon.image_blur(img, 2.0)", df).alias("x")).collect()
    assert bytes(got[0].x) == out and got[1].x is None
