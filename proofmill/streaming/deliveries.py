"""Copies of changed papers that are due, sent, retried and given up: one state machine with timers, as batch and as stream.

A change makes a copy due once the paper has been quiet for ``QUIET``; further
changes put it off.  A copy that fell due is under way: its success settles the
paper, its failure makes it due again, each time after twice the wait, until
``ATTEMPTS`` have failed.  What is heard of neither within ``KEPT`` expires.  A
paper that is settled, given up or expired has no state left, so state is bounded by
the papers in motion.

Times are in milliseconds of event time.  A timer fires before any event that isn't
earlier, whenever that event arrives, and at the end once the watermark is past it; so
the rows don't depend on how a stream is cut into batches, as long as a paper's events
come in order.  The same two functions serve both forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

QUIET, WAIT, LONGEST, KEPT = 4_000, 30_000, 3_600_000, 86_400_000
ATTEMPTS = 5
OUT = ["paper", "at", "what", "attempt"]


class Copy(NamedTuple):
    """A paper in motion: failed attempts so far, when its copy falls due (or none is to), and when it expires."""

    failed: int
    due: int | None
    expires: int


def fire(copy: Copy | None, until: int) -> tuple[Copy | None, list[tuple[int, str, int]]]:
    """The state after all timers up to ``until``, and what they report: (at, what, attempt)."""
    rows = []
    while copy is not None:
        if copy.due is not None and copy.due <= until:
            rows.append((copy.due, "due", copy.failed + 1))
            copy = Copy(copy.failed, None, copy.due + KEPT)
        elif copy.due is None and copy.expires <= until:
            rows.append((copy.expires, "expired", copy.failed + 1))
            copy = None
        else:
            break
    return copy, rows


def step(copy: Copy | None, at: int, what: str) -> tuple[Copy | None, list[tuple[int, str, int]]]:
    """The state after an event, with the timers before it."""
    copy, rows = fire(copy, at)
    if what == "change":
        # A new text needs a copy of its own, whatever became of the last one.
        copy = Copy(0, at + QUIET, at + QUIET + KEPT)
    elif copy is None or copy.due is not None:
        pass  # nothing is under way
    elif what == "sent":
        rows.append((at, "settled", copy.failed + 1))
        copy = None
    elif what == "failed":
        failed = copy.failed + 1
        if failed >= ATTEMPTS:
            rows.append((at, "given up", failed))
            copy = None
        else:
            due = at + min(LONGEST, WAIT << (failed - 1))
            copy = Copy(failed, due, due + KEPT)
    return copy, rows


def timer(copy: Copy) -> int:
    return copy.expires if copy.due is None else copy.due


def _schema(events: DataFrame) -> str:
    return f"paper {events.schema['paper'].dataType.simpleString()}, at long, what string, attempt int"


def _millis(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn("at", F.unix_millis(F.col(ts).cast("timestamp")))


def log(events: DataFrame, ts: str = "ts", late_ms: int = 60_000) -> DataFrame:
    """Batch form over (paper, ts, seq, what): the rows that the stream gives once its watermark, ``late_ms`` behind the latest event, has come."""
    e = _millis(events, ts)
    latest = e.agg(F.max("at")).first()[0]
    if latest is None:
        return e.select("paper", "at", "what", F.lit(0).alias("attempt"))
    until = latest - late_ms - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paper, copy, first, out = None, None, True, []
        for b in batches:
            for p, at, what in zip(b["paper"].tolist(), b["at"].tolist(), b["what"].tolist(), strict=True):
                if first or p != paper:
                    out += [(paper, *r) for r in fire(copy, until)[1]]
                    paper, copy, first = p, None, False
                copy, rows = step(copy, at, what)
                out += [(p, *r) for r in rows]
            yield pd.DataFrame(out, columns=OUT)
            out = []
        if not first:
            yield pd.DataFrame([(paper, *r) for r in fire(copy, until)[1]], columns=OUT)

    ordered = e.select("paper", "at", "seq", "what").repartition("paper").sortWithinPartitions("paper", "at", "seq")
    return ordered.mapInPandas(run, _schema(events))


def follow(events: DataFrame, ts: str = "ts", late_ms: int = 60_000) -> DataFrame:
    """Streaming form over a streaming ``events``: timers are event-time timeouts of each paper's state."""
    e = _millis(events.withWatermark(ts, f"{late_ms} milliseconds"), ts)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        copy, out = (Copy(*state.get) if state.exists else None), []
        if state.hasTimedOut:
            copy, out = fire(copy, state.getCurrentWatermarkMs() - 1)
        else:
            b = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
            for at, what in zip(b["at"].tolist(), b["what"].tolist(), strict=True):
                copy, rows = step(copy, at, what)
                out += rows
        if copy is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(copy))
            state.setTimeoutTimestamp(max(timer(copy), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=OUT)

    picked = e.select("paper", ts, "at", "seq", "what").groupBy("paper")
    return picked.applyInPandasWithState(run, _schema(events), "failed int, due long, expires long", "append", GroupStateTimeout.EventTimeTimeout)
