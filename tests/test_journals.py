"""Journals by literal names, and both joins against all pairs."""

import random

from proofmill.operators import journals as J
from proofmill.operators.align import likeness

LIST = [
    ("Physical Review Letters", "Phys. Rev. Lett."), ("Nuclear Instruments and Methods in Physics Research Section A: Accelerators, Spectrometers", "Nucl. Instrum. Methods Phys. Res. A"),
    ("Nuclear Instruments and Methods in Physics Research Section B: Beam Interactions", "Nucl. Instrum. Methods Phys. Res. B"), ("Journal of Physics", "J. Phys."), ("Japan Physics", "Jpn. Phys."),
    ("Nature Communications", "Nat. Commun."), ("National Physics Archive", "Natl. Phys. Arch."), ("Nature", "Nature"), (None, "x"), ("Optics Express", None), ("Physics Today and Tomorrow", "Phys. Today Tomorrow"), ("Physics Today or Tomorrow", "Phys. Today or Tomorrow"),
]


def test_names(spark):
    journals = spark.createDataFrame(LIST, "full string, short string")
    variants = spark.createDataFrame([("PRL", "Phys. Rev. Lett."), ("nature", "Not this"), (None, "y")], "name string, short string")
    cases = {
        "PHYSICAL REVIEW LETTERS": ("Phys. Rev. Lett.", "listed"), "in Phys Rev Lett,": ("Phys. Rev. Lett.", "listed"), "prl": ("Phys. Rev. Lett.", "listed"), "Nature": ("Nature", "listed"),
        "Nuclear Instruments & Methods in Physics Research Section A": ("Nucl. Instrum. Methods Phys. Res. A", "listed"), "Nature Communications: Physics": ("Nat. Commun.", "head"),
        "Physical Reviwe Letters": ("Phys. Rev. Lett.", "typo"), "Nucl. Instr. Meth. Phys. Res., Sect. A": ("Nucl. Instrum. Methods Phys. Res. A", "words"), "Natnl. Ph. Arch.": ("Natl. Phys. Arch.", "words"), "J. Ph.": (None, "tie"),
        "Reviews of Physical Instruments": ("Reviews Phys. Instrum.", "made"), "Zygote": ("Zygote", "as written"), "Xyz. Q.": ("Xyz. Q.", "as written"), "Physics Today of Tomorrow": (None, "tie"),
    }
    names = spark.createDataFrame([(n,) for n in [*cases, None, " ", ";", "prl"]], "name string")
    out = J.resolved(names, journals, variants).collect()
    assert {r.name: (r.short, r.how) for r in out} == cases and len(out) == len(cases)
    assert {tuple(r.choices) for r in out if r.how == "tie"} == {("J. Phys.", "Jpn. Phys."), ("Phys. Today Tomorrow", "Phys. Today or Tomorrow")}


def test_empty_list(spark):
    none = spark.createDataFrame([], "full string, short string")
    names = spark.createDataFrame([("A Journal of B",)], "name string")
    assert [(r.short, r.how, r.choices) for r in J.resolved(names, none).collect()] == [("A Journal of B", "as written", ["A Journal of B"])]
    assert J.resolved(names.limit(0), none).count() == 0


def test_like_keys_are_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abc é") for _ in range(rng.randint(9, 45))) for _ in range(40)]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s))
            kind = rng.random()
            if kind < 0.4:
                s[i] = rng.choice("abcx")
            elif kind < 0.7:
                del s[i]
            else:
                s.insert(i, rng.choice("abcx"))
        return "".join(s)

    asked = [changed(rng.choice(base)) for _ in range(300)] + ["short", ""]
    a, b = spark.createDataFrame([(x,) for x in asked], "asked string"), spark.createDataFrame([(x,) for x in [*base, "shorx", ""]], "key string")
    got = [(r.asked, r.key) for r in J.like_keys(a, b).collect()]
    want = {(x, y) for x in asked for y in base if len(x) >= J.LEAST and abs(len(x) - len(y)) <= J.APART and likeness(x, y) >= J.LIKE - 1e-9}
    assert set(got) == want and len(got) == len(want) and len(want) > 50


def test_by_words_are_all_pairs(spark):
    rng = random.Random(8)
    pool = ["physics", "physical", "review", "reviews", "nature", "natural", "national", "journal", "japan", "of", "a"]
    full = sorted({" ".join(rng.choice(pool) for _ in range(rng.randint(1, 4))) for _ in range(120)} - {"of", "a"})
    asked = sorted({" ".join(rng.choice(["ph", "phys", "p", "rev", "rvw", "n", "nat", "natl", "j", "jnl", "jpn", "review"]) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    grid = spark.createDataFrame([(x,) for x in asked], "asked string")
    rows = spark.createDataFrame([(x, x.upper()) for x in full], "full string, short string")
    cut = {r.full: list(r.w) for r in rows.select("full", J.words(rows.full).alias("w")).collect()}

    def grade(s, f):
        if s == f:
            return 0
        if f.startswith(s):
            return 1
        it = iter(f)
        return 2 if len(s) > 2 and s[:2] == f[:2] and all(c in it for c in s) else None

    want = {}
    for x in asked:
        by = {}
        for f, w in cut.items():
            g = [grade(s, t) for s, t in zip(x.split(), w)] if len(w) == len(x.split()) else [None]
            if None not in g:
                by.setdefault(sum(g), set()).add(f.upper())
        if by:
            want[x] = sorted(by[min(by)])
    got = {r.asked: list(r.shorts) for r in J.by_words(grid, rows).collect()}
    assert got == want and len(want) > 20


def test_issues_put_what_is_known_and_report_the_rest(spark):
    journals = spark.createDataFrame(LIST, "full string, short string")
    names = ["Phys. Rev. Lett.", "Physical Review Letters", "J. Ph.", "Zygote", None]
    fields = spark.createDataFrame([(i, "journal", "journal", n, 5, 5 + len(n or "")) for i, n in enumerate(names)] + [(9, "book", "title", "Physical Review Letters", 0, 23)], "ref int, category string, field string, value string, start int, end int")
    got = sorted((r.ref, r.start, r.end, r.before, r.put or "", r.how) for r in J.issues(fields, journals).collect())
    assert got == [(1, 5, 28, "Physical Review Letters", "Phys. Rev. Lett.", "listed"), (2, 5, 11, "J. Ph.", "", "tie"), (3, 5, 11, "Zygote", "", "as written")]
