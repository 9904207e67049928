"""Protected text by literal cases; edits against the intervals character by character."""

import random

from proofmill.operators import edits, protected as P

SF = "/root/testdata/sf0.001"


def test_zones():
    cases = [
        ("", []), ("a % b\nc", [(2, 5, "comment")]), ("50\\% of $x$", [(8, 11, "inline")]), ("\\\\[2pt] a \\] b", []), ("\\[a\\] \\$5 $ b", [(0, 5, "display")]),
        ("% $\n 5 m $", [(0, 3, "comment")]), ("\\verb|%| 5 m", [(0, 8, "verbatim")]), ("\\begin{align*}1\\end{align*}", [(0, 27, "environment")]), ("\\begin{align}1\\end{array}", []),
        ("\\citep[p.~1]{a,b}", [(0, 17, "argument")]), ("\\reference{a}", []), ("😀\\url{x}", [(1, 8, "argument")]),
    ]
    for source, want in cases:
        assert list(P.zones(source)) == want, source


def test_units():
    def made(source):
        return [(m.group(), right) for m, right in P.measured(source)]

    assert made("5 MeV, 3 Mhz, 0.4 MT, 7 q") == [("5 MeV", "MeV"), ("3 Mhz", "MHz"), ("0.4 MT", "MT")]
    assert made("Fig. 2 A and Table 3 K, step 4 m, Fig.~2 A, x2 m, 1.2.3 m") == []
    assert made("5 mG 5 mg 3 ev") == [("5 mG", "mG"), ("5 mg", "mg"), ("3 ev", "eV")]
    assert made("5 m, % 5 m") == [("5 m", "m")] and made("4 \\%") == [("4 \\%", "")]


def test_edits_and_styles(spark):
    rows = [(1, "5 MeV and 6 ghz, 3\\,mm", "tie"), (2, "\\usepackage{siunitx} 5 MeV", None), (3, "5 MeV", "macro"), (4, None, "tie"), (5, "", "tie"), (6, "\\qty{1}{m} 5 MeV", "tie")]
    docs = spark.createDataFrame(rows, "file int, text string, style string")
    got = sorted((r.file, r.before, r.after, r.check_id, r.tier) for r in P.unit_edits(docs).collect())
    assert got == [(1, "5 MeV", "5~MeV", "FMT-UNIT-01", "auto"), (1, "6 ghz", "6~GHz", "FMT-UNIT-02", "suggest"), (2, "5 MeV", "\\qty{5}{MeV}", "FMT-UNIT-01", "auto"), (3, "5 MeV", "5~MeV", "FMT-UNIT-01", "auto"), (6, "5 MeV", "5~MeV", "FMT-UNIT-01", "auto")]
    sources = spark.createDataFrame([(1, "a", "\\qty{1}{m} \\SI{2}{m} 3~m"), (2, "b", "3~m 4\\,m"), (3, "c", "x"), (4, "c", None), (5, "d", "3~m")], "file int, conf string, text string")
    profiles = spark.createDataFrame([("d", "macro")], "conf string, style string")
    assert {r.conf: r.style for r in P.house_styles(sources, "conf", profiles).collect()} == {"a": "macro", "b": "tie", "c": "auto", "d": "macro"}


def test_edits_change_nothing_protected_and_are_made_once(spark):
    rng = random.Random(3)
    parts = ["5 MeV ", "$4 m$", "% 3 mm\n", "\\cite{2 m}", "7 ghz, ", "\\verb|1 m|", "\\[3 kV\\]", "5~m ", "\\%", "x ", "\\begin{array}2 m\\end{array}", "9 \\% ", "$", "\\\\"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["y " * 5000 + "5 MeV $" + "4 m " * 2000 + "$ 3 kV"]
    docs = spark.createDataFrame(list(enumerate(texts)), "file int, text string")
    found = P.unit_edits(docs)
    held = {i: [c for c in P.zones(t)] for i, t in enumerate(texts)}
    rows = found.collect()
    assert rows and not any(a < r.end and r.start < b for r in rows for a, b, _ in held[r.file])
    assert P.outside(found, P.protected_spans(docs)).count() == len(rows)
    every = edits.pattern_edits(docs, r"[0-9]+ [a-zA-Z]+|(?=x)", "z", "A-1", 1)
    want = {(r.file, r.start, r.end) for r in every.collect() if not any(a < r.end and r.start < b for a, b, _ in held[r.file])}
    assert {(r.file, r.start, r.end) for r in P.outside(every, P.protected_spans(docs)).collect()} == want
    again = edits.apply(edits.resolve(found), docs).select("file", "text")
    assert P.unit_edits(again).count() == 0
