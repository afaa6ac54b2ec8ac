import functools
import hashlib
import itertools

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from maskspark.llm import components, simhash, sketch
from maskspark.llm import words as words_module

from .conftest import AWKWARD


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(ids, fps, radius=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n\x1cé", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_awkward_rows(documents):
    rows = [*AWKWARD, *((100 + i, "some text about nothing in particular number %d" % (i % 7)) for i in range(40))]
    got = simhash.near_duplicates(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = brute_components([k for k, _ in rows], fps)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(zip([k for k, _ in rows], [f"{f:016x}" for f in fps], want), key=key)
    assert simhash.near_duplicates(documents([])).count() == 0


def planted(n, seed=0):
    """Fingerprints in chains and clusters around random ones."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [int(x) for x in base]
    for x in base[: n // 3]:
        y = int(x)
        for _ in range(rng.integers(1, 5)):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(b)
            out.append(y)
    return sorted(set(out))


def linked(spark, fps, radius=3):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(df, len(fps), radius)
    roots = {r.vertex: r.root for r in components.components(links).collect()}
    return [roots.get(x, x) for x in signed]


def same_classes(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_links_connect_what_brute_force_does(spark, monkeypatch):
    fps = planted(300)
    want = brute_components(list(range(len(fps))), fps)
    assert same_classes(linked(spark, fps), want)
    # keys of fewer bits, cells dealt out in parts, small tiles
    monkeypatch.setattr(simhash, "CELL", 64)
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "scheme", lambda n, radius: (4, 3))
    assert same_classes(linked(spark, fps), want)
    monkeypatch.setattr(simhash, "scheme", lambda n, radius: (6, 20))
    assert same_classes(linked(spark, fps), want)


def test_scheme_covers_all_sizes():
    for n in (0, 1, 10**3, 10**6, 10**9, 10**12):
        m, bits = simhash.scheme(n, 3)
        assert m > 3 and 0 <= bits <= (m - 3) * (64 // m)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (101, 100)]
    got = {r.vertex: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplicate_keeps_the_smallest(documents):
    docs = documents([(9, "same text here now"), (4, "same text here now"), (4, "same text here now"), (7, "another thing entirely, of course"), (None, "x y z")], extra=True)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [4, 7, None]
    assert simhash.deduplicate(documents([])).count() == 0


def test_similar_documents(documents, spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 3000, 300)]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 3):
            copy = list(words)
            for at in rng.choice(300, 4, replace=False):  # at most 20 of about 300 shingles change
                copy[at] = "edit"
            rows.append((10 * k + j, " ".join(copy)))
            want[10 * k + j] = 10 * k
    rows += [(5000, None), (5001, ""), (5002, "short"), (5003, "short"), (None, "short")]
    for cells in (simhash.CELL, 40):
        monkeypatch.setattr(simhash, "CELL", cells)
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows, extra=True)).collect()}
        assert sum(got[k] == v for k, v in want.items()) >= 0.98 * len(want)
        assert all(got[10 * k] == 10 * k for k in range(120))
        assert got[5001] == 5000 and got[5003] == got[None] == 5002
    assert simhash.similar_documents(documents([])).count() == 0


def shared(k, n, name):
    """Two texts of n words each, whose five-word shingles agree in the first k words only."""
    return [" ".join([f"{name}{i}" for i in range(k)] + [f"{name}{side}{i}" for i in range(n - k)]) for side in "xy"]


def jaccard(a, b):
    a, b = map(plain_shingles, (a, b))
    return len(a & b) / len(a | b)


def test_pairs_below_the_similarity_do_not_link(documents):
    rows, below = [], 0
    for k in range(160):
        rows += [(2 * k + i, t) for i, t in enumerate(shared(76 + k % 20, 100, f"n{k}q"))]
        below += 0.55 < jaccard(rows[-1][1], rows[-2][1]) < 0.8
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows)).collect()}
    assert below > 80
    for k in range(160):
        assert (got[2 * k + 1] == 2 * k) == (jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8)


def test_no_pair_at_the_similarity_is_lost(documents):
    # four of five shingles, the similarity just reached; and a common passage that many texts hold
    rows = []
    for k in range(1300):
        a = [f"s{k}q{i}" for i in range(9)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:8]))]
    passage = " ".join(f"common{i}" for i in range(30))
    rows += [(10000 + i, f"{passage} {t}") for i, t in enumerate(t for k in range(60) for t in shared(94, 100, f"m{k}q"))]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows)).collect()}
    texts = dict(rows)
    assert jaccard(texts[0], texts[1]) == 0.8
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(1300))
    assert all(got[10000 + 2 * k] == got[10001 + 2 * k] == 10000 + 2 * k for k in range(60))


def test_similar_components_against_brute_force(documents):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(25):
        words = [f"b{k % 5}w{x}" for x in rng.integers(0, 400, 40)]
        for _ in range(8):
            words = list(words)
            words[rng.integers(0, len(words))] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(words)))
    root = list(range(len(rows)))
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if jaccard(a, b) >= 0.8 and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = [low if x == high else x for x in root]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == root and 25 < len(set(root)) < 190


def test_parities_bound_the_difference():
    rng = np.random.default_rng(8)
    for n, k in itertools.product((0, 1, 5, 64, 65, 700), (0, 1, 30, 600)):
        both, x, y = (np.unique(rng.integers(0, 2**64, m, dtype=np.uint64)) for m in (n, k, k // 2))
        a, b = np.union1d(both, x), np.union1d(both, y)
        assert simhash.apart(simhash.parity(a), simhash.parity(b)) <= len(np.setxor1d(a, b))


def test_candidates_are_those_of_all_pairs():
    rng = np.random.default_rng(9)
    pool = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    sets = []
    for k in range(60):
        base = rng.choice(pool, rng.integers(20, 120), replace=False)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) < 0.95], rng.choice(pool, 3)])) for _ in range(5)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    folds = np.array([simhash.folded(simhash.parity(h)) for h in sets], np.uint64).view(np.int64)
    size = np.array([len(h) for h in sets])
    rows = np.zeros((len(sets), 8 + simhash.FOLDED), np.int64)
    rows[:, 4] = rows[:, 5] = np.arange(len(sets))
    rows[:, 6], rows[:, 8:] = size, folds
    for cells in (np.zeros(len(sets), int), np.arange(len(sets)) // 7):
        rows[:, 0] = cells
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(sets)]])
        got = set(simhash.candidates(rows, bounds, 0.8))
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if cells[i] == cells[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
        assert want and want <= got and len(got) < 3 * len(want) + 50
        near = simhash.candidates(rows, bounds, 0.8, nearest=True)
        assert set(near) <= got and len(near) <= len(sets) and {i for p in near for i in p} == {i for p in got for i in p}
    halves = np.concatenate([rows, rows])
    halves[:, 0] = halves[:, 1] = 0
    halves[:, 2], halves[len(sets) :, 3] = 1, 1
    halves[len(sets) :, 4:6] += 1000
    across = set(simhash.candidates(halves, np.array([0, len(halves)]), 0.8))
    assert {(i, 1000 + i) for i in range(len(sets))} <= across and all(a < 1000 <= b for a, b in across)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**64, 5000, dtype=np.uint64), rng.integers(0, 2**64, 80, dtype=np.uint64)
    both = np.concatenate([a, b])
    assert (sketch.merge(sketch.scaled(a), sketch.scaled(b)) == sketch.scaled(both)).all()
    assert (sketch.scaled(b) == np.sort(b[b < np.uint64(2**61)])).all()
    large = np.concatenate([rng.integers(0, 2**64, 60000, dtype=np.uint64), a])
    part = np.concatenate([a[:2500], rng.integers(0, 2**64, 2500, dtype=np.uint64)])
    assert abs(sketch.containment(sketch.scaled(part), sketch.scaled(large)) - 0.5) < 0.15
    none = sketch.scaled(a[:0])
    assert sketch.containment(none, none) == 1.0 and sketch.containment(none, sketch.scaled(a)) == 0.0
    assert (sketch.from_text(sketch.to_text(sketch.scaled(a))) == sketch.scaled(a)).all()


def plain_shingles(text, size=5):
    """Distinct shingles as text, by plain string functions."""
    words = __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@functools.cache
def plain_word(word):
    return int(words_module.hash_of(word))


@functools.cache
def plain_hash(line):
    words = [plain_word(w) for w in line.split(" ")]
    total = 0
    for w in words:
        total = (total * words_module._BASE + w) % 2**64
    return int(words_module.mix(np.array([(total + len(words)) % 2**64], np.uint64))[0])


def plain_sketch(text):
    return sorted(h for h in map(plain_hash, plain_shingles(text)) if h < 2**61)


def plain_likeness(a, b):
    return float(a == b) if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \n\x1cé", max_size=60), max_size=5))
def test_shingles(texts):
    got = words_module.shingles(words_module.block_of(__import__("pyarrow").array(texts, "string")), 5)
    assert [x.tolist() for x in got] == [sorted(map(plain_hash, plain_shingles(t))) for t in texts]


def brute_edited(rows):
    """Rows in descending order with the edited texts; ties by the operator's hash can't be told here, so ids differ."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        own, other, after = map(plain_sketch, (t, edited, n))
        prints = ["".join(f"{h:016x}" for h in x) for x in (own, other)]
        out[k] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, plain_likeness(own, other), plain_likeness(own, after))
    return out


def test_edited_pairs(documents, spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), None if i == 3 else "" if i == 4 else " ".join(f"w{x}" for x in rng.integers(0, 50, 20000 if i == 5 else rng.integers(1, 200)))) for i, k in enumerate(rng.choice(10**6, 120, replace=False))]
    want = brute_edited(rows)
    for parts in ("4", "1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = sketch.edited_pairs(documents(rows, extra=True)).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == want and len(got) == len(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sum(r.near_edited > r.near_next for r in got) > 95
    assert np.mean([r.near_edited for r in got]) > 0.55 and np.mean([r.near_next for r in got]) < 0.05
    alone = sketch.edited_pairs(documents([(1, "abc def")])).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(1, 1.0)]
    assert sketch.edited_pairs(documents([])).count() == 0
    assert sketch.edited_pairs(documents(AWKWARD)).count() == len(AWKWARD)
    plain = sketch.fingerprint_documents(documents([(1, "a b c d e f g"), (2, "A B C D E F G"), (3, None)])).collect()
    assert plain[0].fingerprint == plain[1].fingerprint != plain[2].fingerprint == ""
