"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.operators import corpus
from proofmill.plans import bib, conferences, dataset, deliveries, desk, edits, journals, latex, latex_text, layout, names, papers, parsing, protected, references, registry_records, review, scalars, scoring, search  # noqa: F401  they register their queries
from proofmill.plans.registry import QUERIES, SQL
from proofmill.session import table

FLAGSHIP = "score_by_check"


def source_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters by source, with their denominators."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count("text").alias("n_texts"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars")
    )


QUERIES["source_volume"] = source_volume
SQL["source_volume"] = """
SELECT source, count(*) AS n_docs, count(text) AS n_texts, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars
FROM documents GROUP BY source
"""


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES["duplicate_groups"] = duplicate_groups
SQL["duplicate_groups"] = r"""
SELECT md5(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\v\f\r]+', ' ', 'g')))) AS signature, min(doc_id) AS first_id, count(*) AS n, count(DISTINCT text) AS n_spellings
FROM documents GROUP BY 1 HAVING count(*) > 1
"""


def revision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.first_last(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "side", "text")


QUERIES["revision_pairs"] = revision_pairs
SQL["revision_pairs"] = """
SELECT conv_id, turn, CASE WHEN up = 1 THEN 'original' ELSE 'current' END AS side, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down FROM conversations)
WHERE up = 1 OR down = 1
"""


def confirmation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return corpus.rates(items, ["l_returnflag", "l_linestatus"], F.col("l_quantity") >= 25, F.col("l_discount") > 0.05)


QUERIES["confirmation_rates"] = confirmation_rates
SQL["confirmation_rates"] = """
SELECT l_returnflag, l_linestatus, count(*) AS proposals, CAST(sum(CAST(l_quantity >= 25 AS INT)) AS BIGINT) AS confirmed,
  CAST(sum(CAST(l_discount > 0.05 AS INT)) AS BIGINT) AS contradicted, CAST(sum(CAST(l_quantity >= 25 AS INT)) AS DOUBLE) / count(*) AS rate
FROM lineitem GROUP BY 1, 2
"""
