"""The divergence audit against a plain version, with digests so short that terms share them, and its integer shares."""

import random
import re
from collections import Counter, defaultdict

import pytest

from proofmill.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    in_docs, out = defaultdict(Counter), []
    for lang, _, terms in docs:
        in_docs[lang].update(set(terms))
    for lang in {d[0] for d in docs}:
        kept = {t for t, n in in_docs[lang].items() if n >= 3}
        v, whole, by = len(kept), Counter(), {}
        for own, source, terms in docs:
            if own == lang:
                have = [t for t in terms if t in kept]
                by.setdefault(source, Counter()).update(have)
                whole.update(have)
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + v)
        f = lambda p, q: (p - q) ** 2 // q
        for source, own in by.items():
            pair = [(-sum(f(p(own, t), p(x, t)) for t in kept), name) for name, x in by.items() if name != source]
            term = [(-f(p(own, t), p(whole, t)), t) for t in kept if own[t] and p(own, t) > p(whole, t)]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, source, part, item, -value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < 200]
    return sorted(out)


def rows():
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcé日Z" for b in "xyzÄß"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    out = [(None, None, None), ("en", None, ""), ("xx", "lone", "one two three"), ("yy", "a", "one"), ("yy", "b", "two")]
    for i in range(160):
        k = 3000 if i == 7 else rng.randint(0, 60)
        out.append((rng.choice(["en", "de", ""]), rng.choice(["s", "s", "s", "t", "u", "é"]), rng.choice([" ", "9", "\n", "-"]).join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=k))))
    return out + out[20:24]


@pytest.mark.parametrize("bits", [64, 6, 1])
def test_rows_equal_a_plain_version(spark, bits):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows()], "lang string, source string, text string, n long, digest int").repartition(5)
    got = sorted(tuple(r) for r in divergence.audit(docs, bits=bits).collect())
    assert got == plain(rows())


def test_no_rows_and_no_terms(spark):
    docs = spark.createDataFrame([("en", "a", "one"), ("en", "b", None)], "lang string, source string, text string")
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(docs.filter("false")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(0, 0, 1), (10**13, 3 * 10**14, 10**9), (7, 10, 3), (10**15, 5 * 10**15 + 1, 12345)]
    out = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share("c", "n", "v").alias("p")).collect()
    assert [r.p for r in out] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in cases]


def test_long_texts_are_one_document():
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"w{chr(97 + i % 26)}" for i in range(400_000)) + " " + "é" * 700_000
    t = divergence.counted(pa.array([text]), np.zeros(1, np.int64), 64, spell=True)
    assert len(t) == 27 and set(t["docs"].to_pylist()) == {1} and sum(t["n"].to_pylist()) == 400_001
