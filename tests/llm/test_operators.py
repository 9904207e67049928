"""Nulls, empty and long texts, ties, repeated rows, empty tables and further columns, and brute-force results."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oracle import same
from proofmill.llm import ann, bpe, chat, labelled, mixing, near_duplicates, nbsvm, pii, quality_rules, queries, sharding, textscan, toxicity

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _quality int, size int, list int"


def odd_rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    long = " ".join(rng.choice(words) for _ in range(3000))
    near = long.split()
    near[7] = "other"
    texts = [None, "", "  \n\t ", "one two three", "ONE two three", long, long, " ".join(near), "same same same " * 40, "a@b.co +1 (921) 555-8394 or 10.0.0.1", "é 日本 \U0001f600 " * 30, "x" * 50_000, "<|endoftext|> a"]
    return [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 0, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "text without id", "en", "s1", 0, 1, 2, 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.SQL[name], SF)


def test_quality_rules(docs, none):
    out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(out) == docs.count() and out[0].n_words == 0 and out[0].base_failed and not out[8].kept
    assert not out[5].base_failed and out[5].n_words == 3000
    assert quality_rules.judge(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in out.items() if r.kept}


def test_sharding_is_even_and_clockwise(docs, none):
    rows = sharding.shard(docs, 3).collect()
    assert sharding.shard(none, 3).count() == 0
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(3)}
    assert sum(map(len, slots.values())) == docs.count() and all(v == list(range(len(v))) for v in slots.values())
    counts = sorted(map(len, slots.values()))
    assert counts[-1] - counts[0] <= 1
    rng = random.Random(1)
    counts = {c: rng.randint(1, 9) for c in rng.sample(range(sharding.CELLS), 700)}
    plan, order = sharding.allot(counts, 5), sharding.choices(5)
    room = [sum(counts.values()) // 5 + (s < sum(counts.values()) % 5) for s in range(5)]
    want = {}
    waiting = {c: n for c, n in counts.items()}
    for turn in range(5):  # one key at a time
        for c in sorted(waiting):
            while waiting[c] and room[order[c][turn]]:
                want.setdefault(c, []).append(order[c][turn])
                room[order[c][turn]] -= 1
                waiting[c] -= 1
    got = {}
    for c, lo, hi, s, _ in plan:
        got.setdefault(c, []).extend([s] * (hi - lo))
    assert got == want


def test_mixing(docs, none):
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    rows = mixing.mix(sized, "size").select("doc_id", f"{mixing.STRUCT}.*").collect()
    assert len(rows) == docs.count() and mixing.mix(none, "size").count() == 0
    total = sum(r.size for r in rows)
    by = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total and all(t <= 2 * s for s, t in by)
    assert all(len(r.positions) == r.epochs and all(0 <= p <= 1 for p in r.positions) for r in rows)
    order = [r["__pm_position"] for r in mixing.training_order(mixing.mix(sized, "size")).collect()]
    assert order == sorted(order)


def test_curves_invert(spark):
    for curve in mixing.CURVES:
        t = spark.range(101).select(mixing.invert(F.col("id") / 100, curve).alias("t")).toPandas()["t"].to_numpy()
        x, w = zip(*curve, strict=True)
        grid = np.linspace(0, 1, 20001)
        area = np.concatenate(([0], np.cumsum((np.interp(grid[1:], x, w) + np.interp(grid[:-1], x, w)) / 2)))
        assert np.abs(np.interp(t, grid, area / area[-1]) - np.arange(101) / 100).max() < 1e-6


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "be kind", 9), (1, 1, "ann", "hi", 9), (1, 2, "bob", None, 9), (1, None, "", "aside", 9), (None, 0, "cy", "alone", 9), (2, 0, "system", "x", 9)], "conv_id long, turn long, role string, text string, name int")
    rows = chat.perspectives(turns).collect()
    dialogues = {}
    for r in sorted(rows, key=lambda r: r.start):
        whole = dialogues.setdefault((r.conv_id, r.perspective), "")
        assert r.start == len(whole)
        dialogues[r.conv_id, r.perspective] = whole + r.segment
    assert set(dialogues) == {(1, "ann"), (1, "bob"), (None, "cy")}
    for r in rows:
        assert (r.mask_start is not None) == (r.role == "assistant")
        if r.mask_start is not None and r.perspective == "ann":
            assert dialogues[1, "ann"][r.mask_start : r.mask_end] == "hi" + chat.CLOSE
    assert chat.perspectives(turns.limit(0)).count() == 0


def jaccard_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def spoilt(rng, n_bases, n_copies, n_words, edits, shared=()):
    """Texts of ``n_bases`` word lists, each copied with a few words replaced."""
    for _ in range(n_bases):
        base = [f"t{rng.randrange(5000)}" for _ in range(n_words)] + list(shared)
        for _ in range(n_copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            yield " ".join(w)


def test_near_duplicates(spark, docs, none):
    """Against all pairs: sets that are whole heads, sets that aren't, short sets of few words, and a passage that all share."""
    rng = random.Random(8)
    texts = [r[1] for r in odd_rows() if r[0] is not None]
    passage = [f"p{i}" for i in range(40)]
    for n_words, edits in ((60, 4), (150, 7), (400, 16), (12, 2)):
        texts += spoilt(rng, 6, 5, n_words, edits, passage)
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = list(enumerate(texts, 1))
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == jaccard_components(rows)
    assert near_duplicates.near_duplicates(none).count() == 0
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([0, 1, 2, 3, 5, 8, 9, 10, 11, 12, None], key=str)


def test_near_duplicates_of_repeated_ids(spark):
    """An id with two texts is one node of the join, but both texts stay in the pipeline; repeated rows are one document."""
    a, b = ([f"{c}{i}" for i in range(80)] for c in "ab")
    near = [" ".join([*w[:40], "other", *w[41:]]) for w in (a, b)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near[0]), (8, near[1]), (9, "alone"), (9, "alone"), (9, None), (None, near[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()), key=str)
    assert out == sorted([(5, 5), (5, 5), (7, 5), (8, 5), (9, 9), (9, 9), (9, 9), (None, None)], key=str)
    assert sorted(near_duplicates.keep_one(docs).collect(), key=str) == sorted([rows[0], rows[1], rows[4], rows[6], rows[7]], key=lambda r: str(spark.createDataFrame([r], docs.schema).first()))


def test_heads_share_enough():
    for n in [*range(1, 400), 1000, 4567]:
        low, high = (4 * n + 4) // 5, 5 * n // 4
        assert near_duplicates.least_shared(n) == max(1, min(near_duplicates.shared_heads(n, m) for m in range(low, high + 1)))
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        pool = np.sort(rng.choice(10**6, 2 * n, replace=False))
        a, b = (np.sort(rng.choice(pool, int(rng.integers(max(1, n - n // 6), n + 1)), replace=False)) for _ in range(2))
        both = np.intersect1d(a, b)
        if 100 * len(both) >= 80 * len(np.union1d(a, b)):
            heads = [s[: near_duplicates.head_size(len(s))] for s in (a, b)]
            assert len(np.intersect1d(*heads)) >= max(near_duplicates.least_shared(len(s)) for s in (a, b))


def test_words_of_long_texts_are_hashed_in_runs(monkeypatch):
    texts = pa.array(["one two  three\tfour " * 9, "", None, "x" * 50 + " y " + "z" * 70, "é 日本 " * 20])
    whole = list(textscan.word_hashes(texts))
    monkeypatch.setattr(textscan, "CHUNK_BYTES", 16)
    for x, y in zip(whole, textscan.word_hashes(texts), strict=True):
        assert x.tolist() == y.tolist()


def test_pii_base_spans_equal_plain_patterns():
    plain = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    rng = random.Random(3)
    parts = [*"@@..++--__ %()[]0123456789abZé\n", "4111 1111 1111 1111", "a@b.c", "+1 (921) 555-8394", "10.0.0.1"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        want = sorted(((*m.span(), k) for k, p in enumerate(plain) for m in p.finditer(t) if good[k](m.group())), key=lambda s: (s[0], s[2]))
        assert pii.base_spans(t) == want


def test_pii_digests_and_redaction(docs, none):
    out = {r.doc_id: r for r in pii.digests(docs).collect()}
    assert (out[9].n_email, out[9].n_phone, out[9].n_ip, out[9].n_card) == (1, 1, 1, 0)
    assert out[0].base_sha256 == hashlib.sha256(b"").hexdigest() and out[9].spans.startswith("email:0:6,phone:7:24,ip:28:36")
    assert pii.digests(none).count() == 0
    clean = pii.redact(docs, pii.train(docs))
    assert clean.columns == docs.columns and clean.filter("doc_id = 9").first().text == "<EMAIL> <PHONE> or <IP>"


def test_bpe_equals_the_library(docs, none):
    t = Tokenizer.from_file(BPE)
    for r in bpe.encode(docs, BPE, decoded="lang").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.lang == t.decode(ids, skip_special_tokens=False)
    assert bpe.digests(none, BPE).count() == 0


def test_bpe_on_odd_strings():
    t, own, rng = Tokenizer.from_file(BPE), bpe.ByteBpe(BPE), random.Random(2)
    parts = [" ", "  ", "\n", "\r\n", "\x85", "　", "\x1c", "​", "the", " don't", "'S", "'ll", "12", "½", "²", "é", "\U0001f600", "日本", "<|endoftext|>", "!!", "\x00", "_", "a" * 70, "the" * 20, "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for x, y in zip(own.encode(texts), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(x, np.int32).tolist() == y.ids


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6000, 24)).astype(float)
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(6000), -s))[:5].tolist()) & set(found[q]))
    assert hits >= 0.9 * 5 * 120 and found[50] == [51, 52, 53, 54, 55]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id < 3"), df.filter("vec_id = 0")).count() == 2


@pytest.mark.parametrize("classify, label, good", [(nbsvm.classify, "quality", 0.97), (toxicity.classify, "toxic", 0.95)])
def test_classifiers_on_held_out_labels(spark, docs, none, classify, label, good):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = classify(d, labels).filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    assert np.mean([r[0] == r[1] for r in out]) >= good
    assert classify(none, labels).count() == 0 and classify(docs, labels.limit(0)).filter("score between 0 and 1").count() == docs.count()


def test_lexicon_edits_and_quotes():
    lexicon = toxicity.Lexicon([("idiot", False, 5.0), ("worthless", False, 6.0), ("chll", True, 4.0)])
    assert [lexicon.match(w) for w in ("idiot", "idot", "idiott", "id1ot", "wortles", "chllaga", "chlaga", "idle")] == [(5.0, 0), (5.0, 1), (5.0, 1), (5.0, 0), (6.0, 2), (4.0, 0), None, None]
    abuse, quoted = toxicity.features("you are an idiot", lexicon), toxicity.features('he wrote "idiot" here', lexicon)
    assert abuse[0] > 0 and abuse[2] == 0 and quoted[0] == 0 and quoted[2] > 0


def test_folds(spark):
    import zlib

    ids = spark.range(50).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in ids)
