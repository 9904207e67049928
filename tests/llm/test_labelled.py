import numpy as np
from pyspark.sql import functions as F

from proofmill.llm import labelled, nbsvm, toxicity

SF = "/root/testdata/sf0.01"
MISSPELLED = "you patetic worthles disgustin idiiot stuppid"


def test_misspelled_insults_alone_are_toxic(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = spark.createDataFrame([(-1, MISSPELLED), (-2, ""), (-3, "der nichte und das idle patent")], "doc_id long, text string")
    out = {r.doc_id: r.predicted for r in toxicity.classify(docs.select("doc_id", "text").unionByName(more), labels).filter("doc_id < 0").collect()}
    assert out == {-1: 1, -2: 0, -3: 0}


def test_edits_are_dropped_where_clean_documents_hold_them():
    terms = [("disgusting", False, 5.0), ("worthless", False, 5.0), ("idiot", False, 5.0), ("scum", False, 5.0)]
    near = {("disgusting", 2): (0, 3), ("worthless", 1): (1, 9), ("idiot", 1): (50, 1)}
    assert [t[3] for t in toxicity.bound_edits(terms, near, {1: 100, 0: 1000})] == [1, 0, 1, 0]


def test_stems_need_words_and_leave_misspelled_words_to_the_automata(spark):
    words = [f"zorgen{x}" for x in ("aba", "ibi", "obo", "ubu", "ebe")]
    texts = [(f"plain text {w}", 1) for w in words for _ in range(6)] + [("plain text", 0)] * 300
    rows = spark.createDataFrame(texts, "text string, label int").repartition(3)
    counted = {(r.term, r.stem): (r.p, r.q, r.n_words) for r in toxicity.term_counts(rows).collect()}
    assert counted["zorg", True] == (30, 0, 5) and counted["zorgena", True] == (6, 0, 1) and counted["zorgenaba", False] == (6, 0, 1)
    terms = toxicity.learn(rows)
    assert [t[0] for t in terms if t[1]] == ["zorg"] and {t[0] for t in terms if not t[1]} == set(words)
    lexicon = toxicity.Lexicon(terms)
    assert lexicon.match("zorgenana")[1] == 0 and lexicon.match("zrogenaba")[1] == 2 and lexicon.match("sorgenobo")[1] == 1


def test_frequent_stems_of_lower_odds_are_terms(spark):
    ends = [f"{a}{b}" for a in "aeiou" for b in "klmnprst"]
    texts = [(f"plain text quibb{e}", 1) for e in ends] + [(f"plain text quibb{e}", 0) for e in ends[::2]] + [("plain text", 1)] * 20 + [("plain text", 0)] * 400
    terms = toxicity.learn(spark.createDataFrame(texts, "text string, label int").repartition(3))
    assert [(t[0], t[1]) for t in terms] == [("quib", True)] and 2 <= terms[0][2] < toxicity.LEAST_ODDS


def test_no_hit_speaks_against_abuse():
    x = np.array([[0.0, 0, 0, 0, 0], [2, 0, 0, 1, 0], [2, 1, 0, 3, 0], [0, 0, 2, 1, 0]] * 20)
    w = toxicity.supporting(x, np.array([0.0, 1, 0, 0] * 20))
    assert w[[1, 2, 4]].min() >= 0 > w[3]


def test_sampled_rows_weigh_as_many_as_their_class_has(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'a text' AS text")
    labels = spark.range(900).selectExpr("id AS doc_id", "int(id % 10 = 0) AS toxic")
    train = labels.filter(labelled.fold(F.col("doc_id")) != 1).groupBy("toxic").count().collect()
    for per_class in (10, 10_000):
        rows = labelled.sample(docs, labels, "toxic", per_class).groupBy("label").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("taken")).collect()
        assert {r.label: round(r.n, 6) for r in rows} == {r.toxic: r["count"] for r in train}
        assert all(r.taken == min(per_class, round(r.n)) for r in rows)


def test_weights_stand_for_rows():
    rng = np.random.default_rng(5)
    y = (np.arange(400) % 2).astype(float)
    x = np.abs(rng.standard_normal((400, 4)) + 1.5 * y[:, None])
    weight = np.where(y == 0, 9, 1)
    again = np.repeat(np.arange(400), weight)
    assert np.allclose(toxicity.logistic(x, y, weight=weight), toxicity.logistic(x[again], y[again]), atol=1e-6)
    rows = [np.array([0, 1 + int(i % 5)]) for i in range(400)]
    equal, weighted = (nbsvm.descend(rows, 2 * y - 1, np.ones(nbsvm.SPACE), weight=w)[:2] for w in (None, weight.astype(float)))
    margin = lambda m: (m[0][rows[0]].sum() / 2**0.5 + m[1])
    assert margin(weighted) < -0.9 < margin(equal)
