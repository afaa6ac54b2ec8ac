import corpus_pipeline
from maskspark.llm import packing
from maskspark.llm.common import read

from .test_models import evenly
from .test_tokens import check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    bench = read(spark, sf, "benchmark").orderBy("item_id").first().text
    top = docs.agg({"doc_id": "max"}).first()[0]
    add = spark.createDataFrame([(top + 1, "12 34 !!", "en", "x", 8), (top + 2, None, None, "x", None), (top + 3, f"{bench} {bench}", "en", "x", 9), (top + 4, "the and of with this token = 'abcdef0123456789abcdef0123456789abcd' that is there", "en", "x", 9)], docs.schema)
    copy = docs.orderBy("doc_id").limit(3).selectExpr(f"doc_id + {top + 10} AS doc_id", "text", "lang", "source", "n_chars")
    now = docs.unionByName(add).unionByName(copy)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        rows = now.collect()
        seen[name] = rows
        if name != "pack":
            assert now.columns == COLUMNS
            now = spark.createDataFrame(rows, now.schema)
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert {top + 1, top + 2} & ids("language_id") == set() and top + 4 in ids("language_id")
    assert len(ids("language_id")) >= 0.99 * docs.count()
    assert not {top + 10, top + 11, top + 12} & ids("near_dedup")
    assert top + 3 in ids("near_dedup") and top + 3 not in ids("decontaminate")
    clean = {r.doc_id: r for r in seen["secret_scan"]}
    assert ids("secret_scan") == ids("decontaminate") and "[SECRET]" in clean[top + 4].text and clean[top + 4].n_chars == len(clean[top + 4].text)
    check_pieces(seen["pack"], [(r.doc_id, r.text) for r in seen["secret_scan"]])


def test_even_mixtures_go(spark, sf):
    for n, stays in ((2, 1), (4, 0)):
        docs = evenly(spark, sf, n)[1].selectExpr("doc_id", "text", "lang", "'x' AS source", "length(text) AS n_chars")
        assert corpus_pipeline.language_id(spark, docs, sf).where("doc_id = 100000").count() == stays


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [c.split()[0] for c in packing.SCHEMA.split(", ")] and out.count() > 100
