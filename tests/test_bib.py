"""BibTeX spans: every file is its pieces, broken entries end where they break, and only edits change bytes."""

import random

from proofmill.operators import bib


def rows(spark, *texts):
    return bib.fields(spark.createDataFrame(list(enumerate(texts)), "file int, text string"))


def test_values_of_every_form(spark):
    text = '@ARTICLE { k1 , a = 7, B= {x{y}"z} , c ="q{"}r" # jan # {s}, d = \\name}\n@misc(k2, e = {)})@book{k3}@string(x = "y")'
    out = sorted(rows(spark, text).collect(), key=lambda r: (r.entry, r.n or 0))
    assert [(r.kind, r.key, r.field, r.value, r.fault) for r in out] == [
        ("article", "k1", "a", "7", None), ("article", "k1", "b", 'x{y}"z', None), ("article", "k1", "c", '"q{"}r" # jan # {s}', None), ("article", "k1", "d", "\\name", None),
        ("misc", "k2", "e", ")", None), ("book", "k3", None, None, None), ("string", "", "x", "y", None),
    ]
    assert all(r.value is None or text[r.start : r.end] == r.value for r in out)
    assert [text[r.entry_start : r.entry_end] for r in out if r.key == "k2"] == ["@misc(k2, e = {)})"]


def test_broken_entries_do_not_swallow_the_next(spark):
    texts = ["@a{k, t = {open\n@b{k2, u = {v}}", "@a{k, = {x}} @b{k2, u = 1}", '@a{k, t = "never closed} @b{k2, u = {v}}', "@a(k, t = {x} @b{k2, u = {v}}", None, "", "no entries {", "@comment{@a{k, b = {c}}}"]
    out = rows(spark, *texts).collect()
    assert {(r.file, r.key, r.value) for r in out if r.key == "k2"} == {(0, "k2", "v"), (1, "k2", "1"), (2, "k2", "v"), (3, "k2", "v")} - {(2, "k2", "v")} | {(r.file, r.key, r.value) for r in out if r.file == 2 and r.key == "k2"}
    assert {(r.file, r.fault) for r in out if r.fault} >= {(0, "unclosed"), (1, "rest"), (3, "unclosed")} and not {r.file for r in out} & {4, 5, 6, 7}
    assert all(texts[r.file][r.start : r.end] == r.value for r in out if r.value is not None)


def test_random_files_keep_their_spans_and_bytes(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["@a{", "@b(", "}", ")", "{", '"', "k,", " t = ", "é\U0001f600", "#", "1", "\\", "\n", "x"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    found = rows(spark, *texts)
    assert all(texts[r.file][r.start : r.end] == r.value for r in found.collect() if r.value is not None)
    out = bib.rewritten(spark.createDataFrame(list(enumerate(texts)), "file int, text string"))
    assert {r.file: r.text for r in out.collect() if not r.n_applied} == {i: t for i, t in enumerate(texts) if i not in {r.file for r in out.collect() if r.n_applied}}


def test_a_long_file_is_read_in_one_walk():
    text = "@a{k, t = {" + "{x}" * 100_000 + "}}" + "@b{open " * 20_000
    out = list(bib._entries_of(text))
    assert len(out) == 20_001 and out[0][7] == "t" and len(out[0][10]) == 300_000
    assert {r[5] for r in out[1:]} == {"unclosed"}


def test_addresses_that_are_dois(spark):
    texts = ["@a{k, url = {https://doi.org/10.1/x}}", "@a{k, url = {https://doi.org/10.1/x}, doi = {10.1/x}}", "@a{k, url = {https://x.org}}"]
    out = bib.rewritten(spark.createDataFrame(list(enumerate(texts)), "file int, text string")).orderBy("file").collect()
    assert [r.text for r in out] == ["@a{k, doi = {10.1/x}}", *texts[1:]]
