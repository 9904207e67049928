"""Aho-Corasick decontamination against a plain version, in one and in several automata, with odd rows."""

import hashlib
import random
import re

import pytest

from proofmill.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for name, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("" if name is None else str(name))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def cases():
    rng = random.Random(3)
    vocabulary = ["Aa", "b", "ß", "ÀB", "9", "x1", "日本"]
    items = [(i, rng.choice([" ", "-", ", "]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(None, "null item of more than ten words so that it has two windows"), (3, "the same id twice"), (20, None), (21, "...")]
    texts = [None, "", " \n.", "the same id twice", "THE SAME! id\x00twice\x7f"]
    for _ in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(w) - 1))
            parts.append("; ".join(w[a:]).upper().replace("SS", "ß"))
        rng.shuffle(parts)
        texts.append("\t".join(parts))
    return items, texts + texts[5:8]


@pytest.mark.parametrize("bound", [dc.AUTOMATON_BYTES, 120])
def test_counts_equal_a_plain_version(spark, bound):
    items, texts = cases()
    docs = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, `a.b` string, items int")
    bench = spark.createDataFrame(items, "item_id int, text string")
    out = dc.report(docs, bench, automaton_bytes=bound).collect()
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out)
    assert got == sorted((i // 2, *plain(t, items)) for i, t in enumerate(texts))
    assert any(r.contaminated for r in out) and not all(r.contaminated for r in out)
    kept = dc.clean(docs, bench, automaton_bytes=bound)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in out)


def test_spans_cut_the_hit_words_from_the_original(spark):
    item = "One two, three four five six seven eight nine ten"
    text = "Før: \U0001f600 (ONE two three -- four five six seven eight nine TEN) etc. one two three"
    row = dc.report(spark.createDataFrame([(1, text)], "doc_id int, text string"), spark.createDataFrame([(7, item)], "item_id int, text string")).first()
    assert [text[s.start : s.end] for s in row.spans] == ["ONE two three -- four five six seven eight nine TEN"]
    assert row["items"] == ["7"] and row.n_hit == 10


def test_long_texts_keep_the_state_between_pieces():
    item = " ".join(f"w{i}" for i in range(30))
    text = ("x" * 50 + " ") * 40 + item + " " + "y" * 3000 + " " + item
    automaton = dc.Automaton([("a", item)])
    want = automaton.find(text.encode())
    old = dc.pieces.__defaults__
    try:
        dc.pieces.__defaults__ = (37,)
        assert automaton.find(text.encode()) == want
    finally:
        dc.pieces.__defaults__ = old
    assert want[0] == 101 and sum(b - a for a, b in want[1]) == 60


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [(r.n_words, r.contaminated) for r in dc.report(docs, none).collect()] == [(3, False)]
    assert dc.report(docs.filter("false"), none).count() == 0
