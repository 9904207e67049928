"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 3; 1 is the held-out fold.  A null id has none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts with their labels (0 or 1) and weights: at most ``per_class`` labels of each class outside the held-out fold.

    A row's weight is the number of its class's labels over all data by the number
    taken, so weighted rows have the class balance of all labels at any size.
    The labels with the smallest hash of their id are taken, so a rerun takes the
    same.  At most ``2 * per_class`` ids are broadcast, at any size of the input.
    Of contradictory labels of a document the larger holds.
    """
    one = labels.filter((fold(F.col(doc_id)) != 1) & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r.label: r.n for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = [max(1.0, sizes.get(y, 0) / per_class) for y in (0, 1)]
    picked = [one.filter(F.col("label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class).withColumn("weight", F.lit(weight[y])) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    return docs.join(F.broadcast(ids), docs[doc_id] == F.col("_id")).select(F.col(text).alias("text"), "label", "weight")
