"""Corpus analytics: paragraphs, revisions, duplicates, splits, and rates with denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tidy(text: Column) -> Column:
    """White space collapsed; a non-breaking space is not white space here."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def duplicate_groups(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Groups of at least two texts that are equal once tidied and lower-cased: first id, rows, distinct spellings."""
    key = F.md5(F.lower(tidy(F.col(text))).cast("binary"))
    spelt = docs.groupBy(key.alias("signature"), F.sha2(F.col(text).cast("binary"), 256).alias("spelling")).agg(F.min(doc_id).alias("first_id"), F.count(F.lit(1)).alias("n"))
    return spelt.groupBy("signature").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"), F.count("spelling").alias("n_spellings")).filter(F.col("n") > 1)


def first_last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Per key the first row as ``original`` and the last as ``current``; a key with one row has only an original."""
    rest = [c for c in rows.columns if c != key and c not in order]
    row = F.struct(*order, *rest)
    ends = rows.groupBy(key).agg(F.min(row).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("n"))
    side = lambda name, c: F.struct(F.lit(name).alias("side"), F.col(c).alias("row"))
    both = F.when(F.col("n") > 1, F.array(side("original", "first"), side("current", "last"))).otherwise(F.array(side("original", "first")))
    return ends.select(key, F.explode(both).alias("s")).select(key, "s.side", "s.row.*").select(*rows.columns, "side")


def rates(judged: DataFrame, by: list[str], confirmed: Column, contradicted: Column) -> DataFrame:
    """Proposals, confirmations and contradictions by key, each rate beside its denominator; no proposals give a rate of 0."""
    out = judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("proposals"), F.sum(confirmed.cast("long")).alias("confirmed"), F.sum(contradicted.cast("long")).alias("contradicted")
    )
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("confirmed"), F.col("proposals")), F.lit(0.0)))
