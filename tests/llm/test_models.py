import math
import zlib

import numpy as np
import pyarrow as pa
from maskspark.llm import languages, machine
from maskspark.llm.common import read
from maskspark.llm.words import block_of

from .conftest import AWKWARD, SCHEMA


def test_pairwise_terms_equal_the_plain_sum():
    rng = np.random.default_rng(0)
    x, w, v = rng.normal(size=(5, 30)), rng.normal(size=30), rng.normal(size=(30, 4))
    plain = [0.3 + r @ w + sum(v[i] @ v[j] * r[i] * r[j] for i in range(30) for j in range(i + 1, 30)) for r in x]
    assert np.allclose(machine.raw_score(x, 0.3, w, v), plain)


def test_features_do_not_depend_on_the_block():
    texts = ["Some words here.\nAnd more!!", "", "ÀB 12 ab ab", None, "x" * 50]
    whole = machine.features(block_of(pa.array(texts)))
    alone = np.concatenate([machine.features(block_of(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(whole, alone) and whole.shape == (5, machine.FEATURES)


def auc(y, s):
    order = np.argsort(np.argsort(s)) + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    labels = read(spark, sf, "labels")
    got = machine.score_quality(read(spark, sf, "documents"), labels).join(labels, "doc_id").toPandas()
    assert all((zlib.crc32(str(k).encode()) % 5 == 0) == h for k, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert auc(held.quality.values, held.score.values) > 0.95
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_quality_of_awkward_rows(documents, spark):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (6, 0, 0), (None, 1, 1), (5, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = machine.score_quality(documents(AWKWARD, extra=True), labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    none = machine.score_quality(documents(AWKWARD), labels.limit(0)).collect()
    assert len(none) == len(AWKWARD) and {r.score for r in none} == {0.5}
    assert machine.score_quality(documents([]), labels).count() == 0


def test_languages_on_held_out_rows(spark, sf):
    docs = read(spark, sf, "documents")
    got = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert all((zlib.crc32(str(k).encode()) % 4 == 2) == h for k, h in zip(got.doc_id, got.held_out))
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_mixtures_and_awkward_rows(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang").where("lang in ('fr', 'de')")
    fr, de = (docs.where(f"lang = '{x}'").orderBy("doc_id").limit(5).toPandas().text.str.cat(sep=" ")[:4000] for x in ("fr", "de"))
    rows = [(1000 + i, t) for i, t in enumerate([fr, fr + " " + de[:800], None, "", "123 ... !!", "١٢٣ ٤٥", "文字だけ"])]
    extra = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    got = {r.doc_id: r for r in languages.identify(docs.unionByName(extra.select("doc_id", "text", "lang"))).collect()}
    assert got[1000].lang_pred == "fr" and got[1000].score > 0.95
    assert got[1001].lang_pred == "fr" and 0.6 < got[1001].score < 0.97
    assert [got[k].lang_pred for k in (1002, 1003, 1004, 1005)] == ["und"] * 4 and got[1002].score == 0
    assert got[1006].lang_pred in ("fr", "de")


def evenly(spark, sf, n):
    """Texts of n languages in equal parts, and the table of documents."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang").where("lang is not null")
    names = sorted(r.lang for r in docs.select("lang").distinct().collect())[:n]
    parts = [docs.where(f"lang = '{x}'").orderBy("doc_id").limit(12).toPandas().text.str.cat(sep=" ").split()[:500] for x in names]
    assert len(names) == n and all(len(p) == 500 for p in parts)
    extra = spark.createDataFrame([(100000, " ".join(w for p in parts for w in p), None)], docs.schema)
    return names, docs.unionByName(extra)


def test_sets_of_four_languages(spark, sf):
    for n in (2, 4):
        names, docs = evenly(spark, sf, n)
        (row,) = languages.identify(docs).where("doc_id = 100000").collect()
        assert sorted(row.languages) == names and abs(sum(row.proportions) - 1) < 1e-9
        assert all(abs(p - 1 / n) < 0.06 for p in row.proportions) and row.proportions == sorted(row.proportions, reverse=True)
        assert row.lang_pred == row.languages[0] and row.score == row.proportions[0] and abs(row.share - 1 / n) < 0.06


def plain_inference(text, table):
    """Language, its share among all and the selected set's proportions, word by word and gram by gram."""
    n = table.shape[1]
    words = __import__("re").findall("[a-z]+", text)
    bucket = lambda g: (int.from_bytes(g.encode(), "big") * 2654435761 % 2**32) >> 16
    p = []
    for w in words:
        like = [sum(table[bucket(f" {w} "[i : i + 3])][k] for i in range(len(w))) for k in range(n)]
        p.append([math.exp(max(x - max(like), -60)) for x in like])

    def mixture(mix):
        while True:
            after = [0.0] * n
            for x in p:
                total = sum(a * b for a, b in zip(x, mix))
                after = [c + a * b / total / len(p) for c, a, b in zip(after, x, mix)]
            if max(abs(a - b) for a, b in zip(after, mix)) < languages.SETTLED:
                return mix, sum(math.log(sum(a * b for a, b in zip(x, mix))) for x in p)
            mix = after

    whole, _ = mixture([1 / n] * n)
    order = sorted(range(n), key=lambda k: -whole[k])
    best = (-math.inf, None)
    for k in range(1, n + 1):
        start = [max(whole[i], 1e-9) if i in order[:k] else 0 for i in range(n)]
        mix, fit = mixture([x / sum(start) for x in start])
        best = max(best, (fit - languages.PENALTY * (k - 1) * math.log(len(p) + 1), mix))
    return max(range(n), key=lambda k: best[1][k]), whole, best[1]


def test_inference_against_plain_loops():
    rng = np.random.default_rng(2)
    table = np.log(rng.dirichlet(np.full(1 << languages.BUCKETS_LOG2, 0.3), 4).T + 1e-7).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(n)) for n in (1, 2, 5, 30, 30, 90, 4000)]
    texts.append(" ".join(["cab"] * 40 + ["ba"] * 40))
    best, share, chosen = languages.infer(languages.lowered(pa.array(texts)), table)
    sizes = set()
    for i, t in enumerate(texts):
        want, whole, mix = plain_inference(t, table)
        assert best[i] == want and np.allclose(chosen[i], mix, atol=1e-6) and abs(share[i] - whole[want]) < 1e-6
        sizes.add((np.array(mix) > 0).sum())
    assert len(sizes) > 1


def test_languages_without_rows_to_learn_from(documents, spark):
    docs = documents(AWKWARD, extra=True).drop("lang", "id").selectExpr("*", "CAST(NULL AS string) AS lang", "1 AS id", "2 AS body")
    got = languages.identify(docs, keep=("doc_id", "text")).collect()
    assert len(got) == len(AWKWARD) and {r.lang_pred for r in got} == {"und"}
    assert languages.identify(documents([])).count() == 0
