"""LaTeX to text: literal forms, and maps that lead back to what was read."""

import random

import pytest

from proofmill.operators import latex_text as L

CASES = [
    ("", ""), ("plain words", "plain words"), ("a % gone\n  b", "a b"), ("50\\% of", "50% of"), ("G\\\"{u}nther, \\'{\\i}, \\c c, \\H{o}, \\k{a}", "Günther, í, ç, ő, ą"),
    ("\\textbf{bold \\emph{both}} \\unknown{x}", "bold both x"), ("see \\cite{a,b} and~\\ref{f}.", "see  and ."), ("a--b---c ``q'' `s'", "a–b—c “q” ‘s’"), ("\\ss{} \\AE sop, na\\\"ive", "ß Æsop, naïve"),
    ("\\href{http://x}{name} \\url{http://y_z}", "name http://y_z"), ("$a_1$ \\{x\\} A\\\\B", "a_1 {x} A B"), ("\\.z \\~n \\=e", "ż ñ ē"), ("\\v{\U0001f600}", "\U0001f600"), ("x\\^", "x"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_forms(source, text):
    assert L.plain(source)[0] == text


def test_runs_are_in_order_and_cover_both_sides():
    rng = random.Random(6)
    for _ in range(500):
        source = "".join(rng.choice(["a", "b ", "\\'e", "\\\"{o}", "{", "}", "\\emph{", "%c\n", "--", "~", "\\cite{k}", "é\U0001f600", "\\", "$", "``", "\\o "]) for _ in range(rng.randint(0, 25)))
        text, runs = L.plain(source)
        at = out = 0
        for a, b, s, e in runs:
            assert a == out and s == at
            out, at = b, e
        assert out == len(text) and at == len(source)
        for _ in range(5):
            i = rng.randint(0, len(text))
            j = rng.randint(i, len(text))
            start, end = L.source_span(runs, i, j)
            assert 0 <= start <= end <= len(source)
            # A span within one run that was copied is found in the source as it is.
            if any(a <= i < j <= b and text[a:b] == source[s:e] for a, b, s, e in runs):
                assert source[start:end] == text[i:j]
            # Whatever its runs are, they lie in the span from end to end, but for copied ones at its edges.
            inner = [(s, e) for a, b, s, e in runs if i <= a and b <= j and a < b]
            assert all(start <= s and e <= end for s, e in inner)


def test_null_sources_and_spans(spark):
    sources = spark.createDataFrame([(1, "G\\\"ut"), (2, None), (3, "")], "file int, text string")
    assert {r.file: r.text for r in L.texts(sources).collect()} == {1: "Güt", 3: ""}
    spans = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 2, 2), (2, 0, 1)], "file int, start int, end int")
    got = {(r.file, r.start, r.end): (r["from"], r.to) for r in L.in_source(spans, sources).collect()}
    assert got == {(1, 0, 3): (0, 5), (1, 1, 2): (1, 4), (1, 2, 2): (4, 4)}
