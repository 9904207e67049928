"""The review desk: stages of papers, worklists, holders, carried decisions, and logs of lookups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from proofmill.functions import texts as X


def stage(prepared: Column, status: Column, qa: Column) -> Column:
    return (
        F.when(~prepared, "unprepared")
        .when(status == "done", F.when(qa == "passed", "qa_passed").otherwise("to_qa"))
        .when(status == "needs_author", "waiting_author")
        .when(qa == "failed", "to_reedit")
        .otherwise("to_edit")
    )


def taken_for(stage_: Column) -> Column:
    """What a paper in a stage is taken for: edit, qa, or nothing."""
    return F.when(stage_.isin("to_edit", "waiting_author", "to_reedit"), "edit").when(stage_ == "to_qa", "qa").otherwise("")


def deadline(moment: Column, grace: str = "48 HOURS") -> Column:
    """``grace`` later, rounded up to the hour."""
    later = moment + F.expr(f"INTERVAL {grace}")
    hour = F.date_trunc("hour", later).cast("timestamp_ntz")
    return F.when(hour == later, hour).otherwise(hour + F.expr("INTERVAL 1 HOUR"))


def title_status(c: dict[str, Column], now: Column) -> Column:
    """Where the check of title and authors is: applied changes come first, then a reply, then the mail, then the comparison.

    ``c``: applied, tasks_done, reply, sent, changed, due, compared, differs, unreadable.
    """
    return (
        F.when(c["applied"].isNotNull(), F.when(c["tasks_done"], "done").otherwise("applied"))
        .when(c["reply"] == "declined", "replied")
        .when(c["sent"].isNotNull(), F.when(c["changed"], "changed").when(now >= c["due"], "due").otherwise("waiting"))
        .when(~c["compared"], "unknown")
        .when(c["differs"], "differs")
        .when(c["unreadable"], "unknown")
        .otherwise("match")
    )


def progress(decided: Column, to_decide: Column) -> Column:
    return X.rate(decided, decided + to_decide, 1.0)


def newer(remote: Column, local: Column, worked_on: Column) -> Column:
    """Which copy is newer by its revisions and by work on it; empty without a local copy."""
    ahead = remote > local
    return F.when(local.isNull(), "").when(ahead & worked_on, "both").when(ahead, "indico").when(worked_on, "local").otherwise("same")


def left_alone(holder: Column, me: Column, prepared: Column, status: Column) -> Column:
    """Why a paper isn't prepared again."""
    return F.when(holder.isNotNull() & (holder != me), "held").when(prepared & status.isin("done", "needs_author"), "finished").otherwise("")


def holders(claims: DataFrame, assignments: DataFrame) -> DataFrame:
    """(paper, taken, here, remote): who holds each paper; ``claims``: paper, who, mode; ``assignments``: paper, editor."""
    both = claims.join(assignments, "paper", "full")
    here, remote = F.col("who").isNotNull(), F.col("editor").isNotNull()
    taken = (
        F.when(here & remote, F.when(F.col("who") == F.col("editor"), "both").when(F.col("mode") == "edit", "conflict").otherwise("here"))
        .when(here, "here")
        .when(remote, "indico")
        .otherwise("")
    )
    return both.select("paper", taken.alias("taken"), F.col("who").alias("here"), F.col("editor").alias("remote"))


def carry_over(decided: DataFrame, after: DataFrame) -> DataFrame:
    """(paper, old_id, new_id, how): where the decisions on old edits go.

    Both sides: paper, id, file, check_id, before, after, left, right.  Old ids ask in
    their order: each takes the first free new id whose six fields are equal, else
    the one free new id with its first four fields, if there is just one at that
    moment, though a later old id would take it exactly; else it is dropped.  What
    shares the four fields streams through a task together, new ids first; they are the
    copies of one edit in a paper.
    """
    near, fine = ["paper", "file", "check_id", "before", "after"], ["left", "right"]
    side = lambda df, n: df.select(*near, F.lit(n).alias("side"), "id", *fine)
    both = side(after, 0).unionByName(side(decided, 1)).repartition(*near).sortWithinPartitions(*near, "side", "id")
    schema = T.StructType([both.schema["paper"], T.StructField("old_id", both.schema["id"].dataType), T.StructField("new_id", both.schema["id"].dataType), T.StructField("how", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, {}
        for b in batches:
            rows = []
            for *key, which, own, left, right in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    now, free = key, {}
                if which == 0:
                    free[own] = (left, right)
                    continue
                took = next((n for n, x in free.items() if x == (left, right)), None)
                how = "dropped" if took is None else "exact"
                if took is None and len(free) == 1:
                    took, how = next(iter(free)), "near"
                free.pop(took, None)
                rows.append((key[0], own, took, how))
            kinds = [b.column(0).type, b.column(6).type, b.column(6).type, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=schema.names)

    return both.mapInArrow(run, schema)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key as a partial maximum of structs: no window, and copies are combined before the shuffle."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_last")).select(key, "_last.*")


def lookups(log: DataFrame) -> DataFrame:
    """(service, attempts, successes, failures, offline); ``log``: service, ok.  A service that never answered is offline."""
    out = log.groupBy("service").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))
    return out.withColumn("offline", F.col("successes") == 0)


def fresh(cache: DataFrame, now: Column) -> DataFrame:
    """Cached answers still worth using: hits for 30 days, misses for 7."""
    return cache.filter(F.col("at") > F.when(F.col("found"), now - F.expr("INTERVAL 30 DAYS")).otherwise(now - F.expr("INTERVAL 7 DAYS")))
