"""Claims on papers from a stream of actions: who holds a paper, and how it came to that.

A free paper goes to the first who takes it.  Its holder alone releases it; anyone
may take it over, and the chief frees it.  The same step serves both forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = ["paper", "seq", "action", "who", "accepted", "holder"]


def step(holder: str | None, action: str, who: str) -> tuple[str | None, bool]:
    """The holder after an action, and whether the action was accepted."""
    if action == "take":
        return (who, True) if holder is None else (holder, holder == who)
    if action == "release":
        return (None, True) if holder is not None and holder == who else (holder, False)
    if action == "take_over":
        return who, True
    if action == "free":
        return None, holder is not None
    return holder, False


def _schema(actions: DataFrame) -> str:
    kind = actions.schema["paper"].dataType.simpleString()
    return f"paper {kind}, seq long, action string, who string, accepted boolean, holder string"


def history(actions: DataFrame) -> DataFrame:
    """Batch form over (paper, seq, action, who): every action with ``accepted`` and the ``holder`` after it.

    A paper's actions come to one task in order and pass through it row by row; the
    state is one holder, so a paper with any number of actions fits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paper, holder, first = None, None, True
        for b in batches:
            accepted, holders = [], []
            for p, a, w in zip(b["paper"], b["action"], b["who"], strict=True):
                if first or p != paper:
                    paper, holder, first = p, None, False
                holder, ok = step(holder, a, w)
                accepted.append(ok)
                holders.append(holder)
            yield b.assign(accepted=accepted, holder=pd.Series(holders, dtype=object, index=b.index))[OUT]

    ordered = actions.select("paper", "seq", "action", "who").repartition("paper").sortWithinPartitions("paper", "seq")
    return ordered.mapInPandas(run, _schema(actions))


def follow(actions: DataFrame) -> DataFrame:
    """Streaming form: the same rows from a streaming ``actions``; a batch's actions of a paper go by ``seq``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder = state.get[0] if state.exists else None
        for b in batches:
            b = b.sort_values("seq", kind="stable")
            accepted, holders = [], []
            for a, w in zip(b["action"], b["who"], strict=True):
                holder, ok = step(holder, a, w)
                accepted.append(ok)
                holders.append(holder)
            yield b.assign(accepted=accepted, holder=pd.Series(holders, dtype=object, index=b.index))[OUT]
        state.update((holder,))

    return actions.select("paper", "seq", "action", "who").groupBy("paper").applyInPandasWithState(run, _schema(actions), "holder string", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, ts: str, action: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Actions by window, with a watermark so that a stream's state is dropped; batch or stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), action).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), action, "n")


def debounced(events: DataFrame, key: str, ts: str, quiet: str = "4 seconds", late: str = "1 minute") -> DataFrame:
    """One send for each burst of changes of a key: those less than ``quiet`` apart; batch or stream."""
    burst = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet)).agg(F.count(F.lit(1)).alias("n"))
    return burst.select(key, F.col("session_window.start").alias("began"), F.col("session_window.end").alias("due"), "n")
