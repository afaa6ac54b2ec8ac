import gc
import json
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from maskspark.llm import dac, packing, tokens
from maskspark.llm.tokens import Encoder, default_vocabulary, encoder

from .conftest import AWKWARD

LETTERS = "abzXYZ éÉßñÀ0159 .,!'\"<|>\n\t\x1c ﬁΣσ́中Kſ-"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=40))
def test_chunks_give_the_library_ids(text):
    e = encoder(default_vocabulary())
    assert e.encode(text) == e.whole(text)
    assert e.encode(text + " <|endoftext|>x don't") == e.whole(text + " <|endoftext|>x don't")


def _other(spec, kind):
    if kind == "digits":
        spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"
    elif kind == "spaces":
        spec["normalizer"]["normalizers"][1]["content"] = "_"
    elif kind == "plain token":
        spec["added_tokens"][0]["content"] = "abc"
    else:
        spec["added_tokens"][0]["content"] = "<a b>"


@pytest.mark.parametrize("kind", ["digits", "spaces", "plain token", "token with a space"])
def test_other_specifications_get_the_library_ids(tmp_path, kind):
    with open(default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    _other(spec, kind)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    e = Encoder(str(path))
    assert not e.chunked and encoder(default_vocabulary()).chunked
    for text in ("in 2024 zabc <a b> don't", "abc  abc\t12345", ""):
        assert e.encode(text) == e.whole(text)


def test_encoder_keeps_neither_rare_nor_long_chunks():
    e = Encoder(default_vocabulary())
    rare, long = " ".join(f"{i}x{i}" for i in range(100_000)), " ".join(f"{i}" + "ab-" * 10_000 for i in range(100))
    tracemalloc.start()
    for text in (rare, *[long] * 3):
        ids = e.encode(text)
    assert ids == e.whole(long)
    del ids
    grown = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert grown < 5e6


def test_repeated_chunks_are_kept_through_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    e = Encoder(default_vocabulary())
    for i in range(0, 300, 10):
        text = " ".join(f"word{k}, Word{k} né{k}" for k in range(i, i + 20)) + " the The, 7"
        for _ in range(3):
            assert e.encode(text) == e.whole(text)
    assert b"the" in e.chunks or b"the" in e.older_chunks
    assert max(map(len, (e.chunks, e.older_chunks, e.parts, e.older_parts))) <= 50


def test_workers_drop_packing_encoders_with_their_tasks(spark, documents):
    def held(batches):
        for batch in batches:
            n = sum(type(x).__name__ == "Encoder" and hasattr(x, "chunked") for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch), pa.int64())], ["n"])

    most = lambda: spark.range(8, numPartitions=8).mapInArrow(held, "n long").agg({"n": "max"}).first()[0]
    before = most()  # token files' encoders stay
    packing.pack_sequences(documents(AWKWARD).repartition(8)).count()
    assert most() <= before


def brute_ids(text):
    e = encoder(default_vocabulary())
    return np.frombuffer(e.whole(text or ""), "<u4").tolist() + [1]


def check_pieces(pieces, rows):
    """Every id lies in one piece; sequences are full or powers of two, without gaps."""
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.ids is None or zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at == own[0].sequence_length and (at == 2048 or at & (at - 1) == 0) and at <= 2048
    assert sum(p.length for p in pieces) == sum(len(brute_ids(t)) for _, t in rows)


def test_packing_awkward_rows(documents):
    pieces = packing.pack_sequences(documents(AWKWARD, extra=True)).collect()
    check_pieces(pieces, AWKWARD)
    for key, text in AWKWARD:
        if key in (0, 1, 2, 4, 5, 6):
            own = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
            ids = np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()
            assert ids == brute_ids(text) and all(p.doc_tokens == len(ids) for p in own)
    assert packing.pack_sequences(documents([])).count() == 0


def test_packing_many(documents):
    rng = np.random.default_rng(1)
    rows = [(i, "token " * int(n)) for i, n in enumerate(rng.integers(0, 900, 300))]
    pieces = packing.pack_sequences(documents(rows).coalesce(1), window_tokens=20_000).collect()
    check_pieces(pieces, rows)
    full = {p.sequence_id for p in pieces if p.sequence_length == 2048}
    assert len(full) * 2048 >= 0.97 * sum(p.length for p in pieces)
    costs = [sum(p.cost for p in pieces if p.sequence_id == s) for s in full]
    assert np.std(costs) < 0.25 * np.mean(costs)


def test_assign_goes_to_the_cheapest_sequence_with_room():
    pieces = [packing.Piece(i, b"", 0, n) for i, n in enumerate([6, 5, 4, 3, 2])]
    bins, left = packing.assign(pieces, 10, 1.0, 0.1)
    assert [sorted(p.length for p in b) for b in bins] == [[2, 3, 5]] or [sum(p.length for p in b) for b in bins] == [10, 10]
    assert sum(p.length for b in bins for p in b) + sum(p.length for p in left) == 20


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 700), [0, 255, 256, 65535, 65536, 2**32 - 1]]).astype("<u4")
    ids = [values[:1000].tobytes(), b"", values[1000:].tobytes()]
    file = dac.DacFile(dac.encode_file([7, None, -3], ids))
    assert file.doc_ids == [7, None, -3] and file.starts.tolist() == [0, 1000, 1000, len(values)]
    assert (file.tokens() == values).all()
    assert [file.token(i) for i in range(len(values))] == values.tolist()
    assert (file.document(0) == values[:1000]).all()
    with pytest.raises(IndexError):
        file.token(len(values))
    assert len(dac.DacFile(dac.encode_file([], [])).tokens()) == 0
    with pytest.raises(ValueError):
        dac.DacFile(b"nope" + bytes(40))


def test_files_hold_all_documents_in_order(documents, spark, tmp_path):
    got = dac.token_files(documents(AWKWARD, extra=True), path=str(tmp_path / "dac"), file_tokens=500).orderBy("start").collect()
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(keys) == len(AWKWARD)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((k is not None, k, len(brute_ids(t)), zlib.crc32(np.array(brute_ids(t), "<u4").tobytes())) for k, t in AWKWARD if k is not None)
    assert sorted((True, r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == want
    (tmp_path / "files").mkdir()
    assert dac.export_files(spark, str(tmp_path / "dac"), str(tmp_path / "files")) == len(list((tmp_path / "files").iterdir())) > 1
    assert dac.token_files(documents([])).count() == 0
