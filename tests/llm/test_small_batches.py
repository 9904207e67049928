import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from proofmill.llm import bpe
from proofmill.session import BATCH_BYTES, scratch

SF = "/root/testdata/sf0.001"


def largest_batch(spark):
    docs = spark.range(0, 2000, 1, 1).selectExpr("repeat('word ', 4000) text")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"b": [b.nbytes]}) for b in batches), "b long")
    return max(r.b for r in sizes.collect())


@pytest.fixture
def usual(spark):
    spark.conf.unset(BATCH_BYTES)
    yield spark
    spark.conf.unset(BATCH_BYTES)


def test_scratch_has_small_batches(usual):
    before = largest_batch(usual)
    with scratch(usual):
        assert largest_batch(usual) < 5 << 20
    assert largest_batch(usual) == before > 16 << 20


@pytest.mark.parametrize("stage", ["quality", "redact", "tokenize"])
def test_stages_have_small_batches(usual, stage):
    getattr(corpus_pipeline, stage)(usual, usual.read.parquet(f"{SF}/documents.parquet"), SF)
    assert largest_batch(usual) < 5 << 20


def test_few_pretokens_wait(monkeypatch):
    own = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    waited, flush = [], own._flush
    monkeypatch.setattr(own, "_flush", lambda waiting: (waited.append(sum(len(p) for _, p in waiting)), flush(waiting)))
    texts = ["a b " * 240_000, "c " * 90_000, *["d e " * 40_000] * 4]
    got = own.encode(texts)
    assert max(waited) <= 400_000 and len(own.pretokens) <= 200_000
    assert [len(x) // 4 for x in got] == [len(own.pattern.findall(t)) for t in texts]
