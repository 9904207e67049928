"""Documents to tokens in five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and reads the columns of ``documents``;
further columns of ``docs`` end in the first stage, as all but the last return
just these.  An empty table stays empty through all stages.  Texts are processed
whole, of any length, and go to Python in batches of a few MB.  Nulls, ties and repeated rows are said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.llm import bpe, mixing, near_duplicates, pii, quality_rules
from proofmill.session import small_batches, stash, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule and no host verdict rejects.

    A null or empty text has too few words and goes.  A null id stays a document; a
    null source is no host and can't be rejected as one.  Repeated rows are judged
    alike, so ties don't matter.
    """
    small_batches(spark)
    return quality_rules.keep_good(docs.select(*COLUMNS))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows without an id or without words are in no group and stay.  Of rows that are
    repeated whole one stays; texts that share an id are judged apart.
    """
    return near_duplicates.keep_one(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text.

    A null text stays null, with n_chars 0.  Other columns may be null.  Of
    overlapping spans the first names what is replaced; repeated rows change alike.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in training order: a document's row once for each of its epochs.

    A null or wordless text takes nothing and goes.  A null source is a source of its
    own.  Rows without an id follow each other by size and content, repeated ones
    too, so ties are settled and reruns agree.
    """
    sized = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("__pm_size"))
    return mixing.training_order(mixing.mix(sized, "__pm_size")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text: one row for every row, null texts as empty ones, repeated rows repeated."""
    small_batches(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("near duplicates", deduplicate), ("personal data", redact), ("mixing", mix), ("tokens", tokenize)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
