import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(texts or (id, text) pairs, extra columns with awkward names)."""

    def make(rows, extra=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], SCHEMA)
        if extra:  # names that operators use themselves
            for name in ("start", "length", "fp", "blob", "findings", "bucket", "id", "hash", "score", "rank"):
                df = df.selectExpr("*", f"'own' AS {name}")
        return df

    return make


#: Null, empty, blank, ties, repeated rows, signs of many kinds.
AWKWARD = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (3, "two words"), (None, "no id here"), (4, "Ünïcödé 文字 \U0001f600 é"), (5, "a\x00b\x1cc"), (6, "word " * 3000)]
