"""Order-sensitive operators: order of first uses, numbering by position, sessions, merged spans and newest rows by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def appearance(rows: DataFrame, key: str, item: str, ts: str, tie: str) -> DataFrame:
    """Items of each key in the order of their first row: (key, item, place).  First rows are aggregated before the window."""
    first = rows.groupBy(key, item).agg(F.min(F.struct(ts, tie)).alias("_first"))
    return first.select(key, item, F.row_number().over(W.partitionBy(key).orderBy("_first")).alias("place"))


def newest(rows: DataFrame, key: str, n: int, ts: str, tie: str) -> DataFrame:
    """The ``n`` newest rows of each key with their ``age_rank``; all but n rows a key are dropped before the shuffle."""
    w = W.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return rows.withColumn("age_rank", F.row_number().over(w)).filter(F.col("age_rank") <= n)


def sessions(rows: DataFrame, key: str, ts: str, tie: str, gap: str) -> DataFrame:
    """Rows less than ``gap`` apart fall in one session: (key, session, began, ended, n)."""
    w = W.partitionBy(key).orderBy(ts, tie)
    opens = F.coalesce((F.col(ts) - F.lag(ts).over(w)) >= F.expr(f"INTERVAL {gap}"), F.lit(True))
    numbered = rows.withColumn("_opens", opens.cast("int")).withColumn("session", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("n"))


def merged_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans of a key that overlap or touch as one: (key, start, end, n)."""
    w = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    grouped = marked.withColumn("_span", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_span").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_span")


def out_of_order(rows: DataFrame, key: str, number: str, *order: str) -> DataFrame:
    """(key, number, highest): first uses of a number after a higher one's.  Later uses don't count; first uses are a partial minimum before the window."""
    first = rows.groupBy(key, number).agg(F.min(F.struct(*order)).alias("_first"))
    before = W.partitionBy(key).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    return first.withColumn("highest", F.max(number).over(before)).filter(F.col(number) < F.col("highest")).select(key, number, "highest")


def misnumbered(rows: DataFrame, key: str, number: str, *order: str, most: int = 5) -> DataFrame:
    """(key, number, expected): entries whose number isn't their place, the first ``most`` of each key."""
    of = W.partitionBy(key)
    placed = rows.withColumn("expected", F.row_number().over(of.orderBy(*order))).filter(F.col(number) != F.col("expected"))
    return placed.withColumn("_n", F.row_number().over(of.orderBy("expected"))).filter(F.col("_n") <= most).select(key, number, "expected")


def unanimous(rows: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """(key, answer, votes): the answer on which all of at least ``least`` votes agree, else null; a null vote is none."""
    out = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("votes"))
    return out.select(key, F.when((F.col("votes") >= least) & (F.col("low") == F.col("high")), F.col("low")).alias("answer"), "votes")


def reordered(listed: DataFrame, cited: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, pos, place, moved): where each listed item belongs, cited ones in order of citation, then the rest as listed; items of one place go by their own order.  ``listed``: key, item, pos; ``cited``: key, item, rank."""
    both = listed.join(cited, [key, item], "left")
    place = F.row_number().over(W.partitionBy(key).orderBy(F.col("rank").asc_nulls_last(), "pos", item))
    now = F.row_number().over(W.partitionBy(key).orderBy("pos", item))
    return both.select(key, item, "pos", place.alias("place"), (place != now).alias("moved"))


def next_id(rows: DataFrame, key: str, name: str, prefix: str) -> DataFrame:
    """(key, next_id): one more than the greatest number after ``prefix``, with three digits at least."""
    number = F.regexp_extract(name, f"^{prefix}([0-9]+)$", 1)
    greatest = F.coalesce(F.max(F.expr("1") * F.when(number != "", number.cast("int"))), F.lit(0)) + 1
    return rows.groupBy(key).agg(F.concat(F.lit(prefix), F.when(greatest < 1000, F.lpad(greatest.cast("string"), 3, "0")).otherwise(greatest.cast("string"))).alias("next_id"))
