"""Operators held against plain versions of their methods."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proofmill.llm import mixing, nbsvm, near_duplicates, pii, quality_rules, sharding, toxicity


def test_descent_solves_the_hinge_loss(monkeypatch):
    """The dual solution against projected gradient steps on the same quadratic, and the ratios against counts by hand."""
    monkeypatch.setattr(nbsvm, "SPACE", 12)
    rng = np.random.default_rng(4)
    y = np.where(rng.random(40) < 0.5, -1.0, 1.0)
    rows = [np.flatnonzero((rng.random(12) < 0.4) | ((np.arange(12) == 0) & (t > 0))) for t in y]
    rows = [r if len(r) else np.array([1]) for r in rows]
    ratio = rng.standard_normal(12)
    w, bias, slope = nbsvm.descend(rows, y, ratio, cost=0.7, epochs=400)
    x = np.zeros((40, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 12] = 1.0
    q = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(40)
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / 60, 0, 0.7)
    plain = (alpha * y) @ x
    assert np.abs(plain[:12] - w).max() < 1e-3 and abs(plain[12] - bias) < 1e-3 and slope > 0


def test_ratios_equal_counts(spark, monkeypatch):
    monkeypatch.setattr(nbsvm, "SPACE", 4)
    found = spark.createDataFrame([(1, [0, 1]), (1, [1]), (0, [1, 2])], "label int, places array<int>")
    p, q = np.array([2, 3, 1, 1.0]), np.array([1, 2, 2, 1.0])
    assert np.allclose(nbsvm.log_count_ratios(found), np.log(p / p.sum()) - np.log(q / q.sum()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    terms = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 11))) for _ in range(60)})
    weights = {t: float(i + 1) for i, t in enumerate(terms)}
    lexicon = toxicity.Lexicon([(t, False, weights[t]) for t in terms])
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "e"])
        word = "".join(word)
        near = [(distance(word, t), -weights[t]) for t in terms if distance(word, t) <= toxicity.most_edits(t, False)]
        assert lexicon.match(word) == ((-min(near)[1], min(near)[0]) if near and word else None), word


def test_expectation_maximisation_finds_the_reliabilities():
    """Votes drawn with known reliabilities: posteriors side with the truth, and a labeler that guesses counts for little."""
    rng = np.random.default_rng(2)
    counts = {}
    truth = {}
    for _ in range(20_000):
        real = rng.random() < 0.4
        v = [int(rng.choice([1, -1, 0], p=[0.8, 0.1, 0.1] if real else [0.1, 0.8, 0.1])) for _ in range(2)] + [int(rng.choice([1, -1, 0]))]
        key = (6, *v, 0, 0, 0)
        counts[key] = counts.get(key, 0) + 1
        truth.setdefault(key, []).append(real)
    post = pii.em(counts)
    for key, p in post.items():
        if counts[key] > 150:
            assert abs(p - np.mean(truth[key])) < 0.06, (key, p, np.mean(truth[key]))
    weights = pii.fit(counts)
    assert all((pii.features(k) @ weights >= 0) == (p >= 0.5) for k, p in post.items() if counts[k] > 150 and abs(p - 0.5) > 0.1)


def test_rows_and_slots_of_repeated_and_null_ids(spark):
    rows = [(None, f"text {i % 50}") for i in range(3000)] + [(7, "same")] * 2000 + [(i, "x" * (i % 9)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard(docs, 8).collect()
    assert len(found) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) == 750
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(i), len(t) + 1) for i, t in rows)


def test_mixing_of_null_ids_equals_a_walk(spark):
    import hashlib

    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else i, f"s{i % 2}", rng.randrange(6)) for i in range(600)] + [(5, "s0", 3)] * 40
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5), "size").select("doc_id", "source", f"{mixing.STRUCT}.*").collect()
    want = []
    for s in ("s0", "s1"):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] is not None, r[0] or 0, r[2]))
        total = sum(r[2] for r in own)
        goal = next(r.target for r in got if r.source == s)
        at = 0
        for r in own:
            want.append((s, str(r[0]), r[2], sum(r[2] > 0 and at + e * total + r[2] / 2 <= goal for e in range(2))))
            at += r[2]
    assert sorted((r.source, str(r.doc_id), r.size, r.epochs) for r in got) == sorted(want)


ODD = "doc_id long, text string, lang string, source string, n_chars long, `x.y` string, score double, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good + " a@b.co", "en", "s", 0), (1, good + " a@b.co", "en", "s", 0), (2, good + " zebra a@b.co", "en", "s", 0), (None, good + " null id", "en", None, 0), (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, " ".join(f"long{i % 4000}x{i}" for i in range(60_000)), "en", "s", 0), (6, "a b c " * 60, "en", "s", 0), (7, " ".join(f"other{i}" for i in range(60)), "en", "t", 0)]
    return spark.createDataFrame([(*r, "v", 0.5, "z") for r in rows], ODD).cache()


def test_stages_on_odd_rows(spark, odd):
    """Nulls, repeated rows, a long text and further columns with awkward names, against what a plain reading says stays."""
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "5", "7", "None"]
    one = near_duplicates.keep_one(kept)
    assert one.columns == odd.columns and sorted(str(r.doc_id) for r in one.collect()) == ["1", "5", "7", "None"]
    clean = pii.redact(one, pii.train(one))
    assert clean.columns == odd.columns and clean.filter("doc_id = 1").first().text.endswith("<EMAIL>")
    mixed = mixing.training_order(mixing.mix(clean.withColumn("size", mixing.word_count(F.col("text"))), "size"))
    assert set(odd.columns) <= set(mixed.columns) and mixed.count() >= 3
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.filter("n_tokens > 0").count() == docs.count() >= 3
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_classifiers_with_a_fitted_model_on_odd_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    both = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    for classify in (nbsvm.classify, toxicity.classify):
        out = classify(both, labels).filter("doc_id is null or doc_id > 999999").collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 1_000_001}) == 1


def test_words_of_slices_are_whole():
    from proofmill.llm import textscan

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 50, "", "c"]})
    assert [p.num_rows for p in textscan.slices(batch, "text", 10)] == [2, 1, 2]
