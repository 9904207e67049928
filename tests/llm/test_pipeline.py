import corpus_pipeline
from oracle import plain  # noqa: F401  the tests' folder is on the path
from test_operators import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        n.append(docs.count())
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "near duplicates":
            want = jaccard_components([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == {c for _, c in want.values()}
        if name == "personal data":
            assert docs.filter("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").isEmpty() and docs.filter("n_chars <> length(text)").isEmpty()
    assert n[0] > n[1] >= n[2] == n[3] and n[4] == n[5]
