"""What a host's posterior does: it rejects the host, makes a document's own failure count, or clears it."""

from pyspark.sql import functions as F

from proofmill.llm import quality_rules

PROSE = [f"w{i}" for i in range(80)]


def judged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert kept == {i for i, r in out.items() if r.kept}
    return out


def test_host_verdict_and_own_failure_each_reject(spark):
    prose = " ".join(PROSE)
    rows = [(i, prose + " #" * (12 if i else 0), "junk") for i in range(60)] + [(100 + i, prose, "fine") for i in range(60)] + [(200, "too few", "fine"), (201, prose + " #" * 40, "fine"), (202, prose + " #" * 40, None)]
    out = judged(spark, rows)
    assert not out[0].base_failed and not out[0].own_failed and out[0].host_rejected and not out[0].kept
    assert out[200].base_failed and not out[200].host_rejected and not out[200].kept
    assert all(not out[i].base_failed and not out[i].host_rejected and out[i].own_failed and not out[i].kept for i in (201, 202))
    assert all(out[100 + i].kept for i in range(60))


def test_the_same_failure_counts_at_one_host_and_not_at_another(spark):
    thin = "\n".join([" ".join(PROSE[:2]), " ".join(PROSE[:2]), " ".join(PROSE[2:])])
    prose = "\n".join([" ".join(PROSE[:40]), " ".join(PROSE[40:])])
    heavy = "\n".join([" ".join(PROSE[:40])] + ["again"] * 9 + [" ".join(PROSE[40:])])
    rows = [(i, prose, "fine") for i in range(99)] + [(99, thin, "fine")] + [(100 + i, heavy if i < 45 else prose, "copies") for i in range(99)] + [(199, thin, "copies")]
    out = judged(spark, rows)
    assert out[99].n_dup_lines == out[199].n_dup_lines == 1
    assert out[99].kept and not out[199].kept and not out[199].host_rejected and not out[100].kept


def test_on_the_tables_the_posterior_decides_beyond_the_base_rules(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").cache()
    assert not out.filter("kept = base_failed").isEmpty()
    share = lambda kept: out.filter(kept).agg(F.avg("quality")).first()[0]
    assert share("kept") > share("not base_failed") and out.filter("not kept and not base_failed").agg(F.avg("quality")).first()[0] < 0.1
