import random
import re

import pyarrow as pa
import pytest
from maskspark.llm import licences, templates
from maskspark.llm.words import block_of

from .conftest import AWKWARD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    words, out = plain_words(text), []
    for label, phrase in licences.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in out]
    return len(words), len(out), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in out}))


def mixed(n=300):
    rng = random.Random(7)
    words = "under the mit license apache version 2 cc by nc a Released MIT. Licensé CC-BY-NC 文 \n under the MIT License Apache License, Version 2.0".split(" ")
    return [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n)]


def test_base_places(documents):
    texts = mixed()
    got = sorted(licences.scan_licences(documents(texts, extra=True)).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sum(r.n_base for r in got) > 50
    assert licences.scan_licences(documents(AWKWARD)).count() == len(AWKWARD)
    assert licences.scan_licences(documents([])).count() == 0


def test_automaton_gives_matching_statistics():
    rng = random.Random(8)
    for _ in range(30):
        sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 5))]
        inside = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        text = [rng.randrange(5) for _ in range(60)]
        a = licences.SuffixAutomaton(sequences)
        for i, (state, length) in enumerate(a.stream(text)):
            assert length == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in inside), default=0)
            match = tuple(text[i + 1 - length : i + 1])
            if length:
                assert a.states[state].ends == sorted({(k, j - 1) for k, s in enumerate(sequences) for j in range(length, len(s) + 1) if tuple(s[j - length : j]) == match})
            whole = {k for k, s in enumerate(sequences) if len(s) <= length and tuple(s) == match[length - len(s) :]}
            assert whole == {k for k in a.states[state].phrases if len(sequences[k]) <= length}


@pytest.mark.parametrize("label, text", licences.TEMPLATES)
def test_every_template_is_found(label, text):
    scan = licences.scanner().scan
    block = block_of(pa.array(["before it. " + text.capitalize() + " and after", "the license of the mit under a version by"]))
    found, not_found = scan(block)
    assert label in found[5].split(",") and found[6] == 1.0
    assert not_found[5] == ""


def test_long_templates_with_gaps():
    mit = licences.TEMPLATES[1][1].split()
    text = " ".join(mit[:40] + ["(see", "below)"] + mit[40:70] + mit[75:])
    row = licences.scanner().scan(block_of(pa.array([text])))[0]
    assert row[5] == "mit" and row[6] > 0.85


def test_a_repeated_passage_does_not_break_a_chain():
    b, r, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "brc")
    scanner = licences.Scanner(base=(), templates=(("own", f"a1 a2 a3 {r} {b} {r} {c} z1 z2 z3"),))
    row = scanner.scan(block_of(pa.array([f"{b} junk {r} junk {c}"])))[0]
    assert row[5] == "own" and abs(row[6] - 36 / 54) < 1e-9 and row[7] == "own:0:38"


def plain_chain(text, template, ends):
    """Words that the best chain covers, trying every chain of matches that end at ends."""
    anchors = []
    for end in ends:
        for at in range(1, len(template) + 1):
            n = 0
            while n < min(end, at) and text[end - n - 1] == template[at - n - 1]:
                n += 1
            if n >= licences.LEAST:
                anchors.append((end, at, n))

    def longest(last, covered):
        best = covered
        for end, at, n in anchors:
            if not last:
                best = max(best, longest((end, at), n))
            elif last[0] < end and last[1] < at and end - n - last[0] <= licences.GAP:
                best = max(best, longest((end, at), covered + min(n, end - last[0], at - last[1])))
        return best

    return longest(None, 0)


def test_chains_against_brute_force(monkeypatch):
    monkeypatch.setattr(licences, "LEAST", 2)
    monkeypatch.setattr(licences, "GAP", 3)
    rng = random.Random(11)
    chained = 0
    for _ in range(200):
        found = [[rng.choice("abc") for _ in range(rng.randint(3, 10))] for _ in range(2)]
        text = [rng.choice("abcx") for _ in range(14)]
        scanner = licences.Scanner(base=(), templates=tuple((str(i), " ".join(s)) for i, s in enumerate(found)))
        tokens = [scanner.word_of.get(w, -1) for w in text]
        stats = [*scanner.automaton.stream(tokens), (0, 0)]
        matches = [(i + 1, *stats[i]) for i in range(len(text)) if stats[i][1] >= 2 and stats[i + 1][1] <= stats[i][1]]
        got = scanner._chains(matches)
        for k, template in enumerate(found):
            best = plain_chain(text, template, [m[0] for m in matches])
            assert round(got.get(k, (0,))[0] * len(template)) == min(best, len(template))
            chained += k in got and got[k][2] - got[k][1] > best > 0
    assert chained > 20


ITEM = "A train leaves the station at 40 km per hour and meets Anna after 3 hours of slow travel along the river"


def pairs(documents, spark, texts, items):
    bench = spark.createDataFrame([(i, t, "own") for i, t in enumerate(items)], "item_id long, text string, id string")
    return {(r.doc_id, r.item_id): r for r in templates.leaks(documents(texts, extra=True), bench).collect()}


def test_verbatim_and_reparameterised_questions(documents, spark):
    other = ITEM.replace("40", "95").replace("3 hours", "7 hours").replace("Anna", "Bertrand")
    unequal = "The cat counts 5 mice and 5 dogs and then 5 birds in the garden of the house with 5 doors"
    texts = [f"Intro. {ITEM}. End.", f"First this: {other}! Then more.", ITEM.split(" km")[0], "clean text about other things entirely " * 5, None, "", "4 5 6 7 8 9 10 11 12 " * 5, unequal.replace("5 mice", "1 mice").replace("5 dogs", "2 dogs").replace("5 birds", "3 birds").replace("5 doors", "4 doors"), unequal.replace("5", "8")]
    got = pairs(documents, spark, texts, [ITEM, unequal, None, "", "short one"])
    assert set(got) == {(0, 0), (1, 0), (8, 1)}
    assert not got[0, 0].reparameterised and got[1, 0].reparameterised and got[8, 1].reparameterised
    assert got[0, 0].coverage == 1.0


def test_names_that_open_sentences(documents, spark):
    item = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"
    only = "Tom sold 48 clips to his friends in the month of April. Tom sold half as many in the next month"
    texts = [item.replace("Tom", "Anna"), f"Some words first. {item.replace('Tom', 'Bertrand').replace('5', '9')} And more.", only.replace("Tom", "Zoe"), "The house has a garden. The garden has a gate. How many gates does a garden have?"]
    got = pairs(documents, spark, texts, [item, only])
    assert set(got) == {(0, 0), (1, 0), (2, 1)} and all(r.reparameterised for r in got.values())


def test_short_items_inside_longer_texts(documents, spark):
    ask = "What is the capital of France?"
    texts = [f"Here is a quiz about countries. {ask} Answer it in a single word.", f"We start with it. {ask.replace('France', 'Norway')} Then more words follow here.", "the capital is what it is, and the rest of it follows", "Paris is the capital of France, as many people know"]
    got = pairs(documents, spark, texts, [ask])
    assert set(got) == {(0, 0), (1, 0)} and not got[0, 0].reparameterised and got[1, 0].reparameterised


def test_items_dense_in_values(documents, spark):
    dense = "Add 5 km 3 hours Anna 7 kg Bob 9 miles 4 days Carl 8 grams 2 weeks"
    got = pairs(documents, spark, [f"Before it. {dense}. After it, more words.", f"Before it. {dense.replace('5', '6').replace('3', '1').replace('7', '2').replace('9', '8').replace('4', '3')}. After it."], [dense])
    assert set(got) == {(0, 0)} and not got[0, 0].reparameterised


def test_short_items_match_whole_texts_only(documents, spark):
    got = pairs(documents, spark, ["Short one!", "a short one that goes on and on", "short one"], ["short one"])
    assert set(got) == {(0, 0), (2, 0)}


def test_plain_windows_against_brute_force(documents, spark):
    rng = random.Random(9)
    vocabulary = [f"w{chr(97 + i)}x" for i in range(12)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [text(rng.randint(8, 30)) for _ in range(12)]
    texts = []
    for i in range(60):
        body = text(rng.randint(0, 30)).split()
        if i % 3 == 0:
            own = rng.choice(items).split()
            cut = rng.randint(0, len(own) // 2)
            body[5:5] = own[cut:]
        texts.append(" ".join(body))
    want = set()
    for d, t in enumerate(texts):
        w = t.split()
        held = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for k, item in enumerate(items):
            v = item.split()
            wins = [tuple(v[i : i + 8]) for i in range(len(v) - 7)]
            if sum(x in held for x in wins) >= 0.5 * len(wins):
                want.add((d, k))
    assert set(pairs(documents, spark, texts, items)) == want and want


def test_decontaminate(documents, spark):
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    docs = documents([(1, f"x {ITEM} y"), (2, "fine"), (2, "fine"), (None, ITEM), (3, None)], extra=True)
    got = templates.decontaminate(docs, bench)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["2", "2", "3", "None"]
    assert templates.decontaminate(docs, bench.limit(0)).count() == 5
    assert templates.decontaminate(documents([]), bench).count() == 0
    assert templates.leaks(documents(AWKWARD), bench).count() == 0
