"""Latched alarm monitors: one pure state machine, replayed in batch by windows and in streams by keyed state.

A monitor watches one scalar of an episode in order of its steps. It smooths the last `width` values, opens when the
smoothed value stays over the threshold for `confirm` steps in a row, and stays open. Batch and stream give the same
first alarm and the same smoothed values, whatever the micro-batches.

Steps of an episode must come in order within and across micro-batches (ordering is by step, there is no event time).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import windows as W
from ..runtime import ship

OUT = "ep long, q int, smooth double, run int, alarm boolean, first_alarm int"
STATE = "recent array<double>, run int, first_alarm int"


@dataclass(frozen=True)
class Monitor:
    width: int = 4
    confirm: int = 2
    threshold: float = 60.0

    def update(self, state: tuple, q: int, x: float) -> tuple[tuple, tuple]:
        """(next state, output row without the episode) for one step."""
        recent, run, first = state
        recent = [*recent, x][-self.width :]
        smooth = sum(recent) / self.width if len(recent) == self.width else None
        run = run + 1 if smooth is not None and smooth > self.threshold else 0
        if first < 0 and run >= self.confirm:
            first = q
        return (recent, run, first), (q, smooth, run, first >= 0, first)


def batch(df: DataFrame, monitor: Monitor, s: W.Series = W.Series()) -> DataFrame:
    """The monitor's outputs over whole episodes, by window functions."""
    m = df.withColumn("smooth", W.trailing_mean(s, "x", monitor.width))
    m = W.run_length(m, s, F.coalesce(F.col("smooth") > monitor.threshold, F.lit(False)), "run")
    first = F.min(F.when(F.col("run") >= monitor.confirm, F.col(s.q))).over(s.past)
    return m.select(s.ep, s.q, "smooth", F.col("run").cast("int").alias("run"), first.isNotNull().alias("alarm"), F.coalesce(first, F.lit(-1)).cast("int").alias("first_alarm"))


def stream(df: DataFrame, monitor: Monitor) -> DataFrame:
    """The same outputs over a stream of (ep, q, x), with keyed state."""
    ship(df.sparkSession)

    def step(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ([], 0, -1)
        state = (list(state[0]), state[1], state[2])
        rows = []
        for frame in frames:
            for q, x in sorted(zip(frame["q"], frame["x"])):
                state, out = monitor.update(state, int(q), float(x))
                rows.append((key[0], *out))
        held.update(state)
        yield pd.DataFrame(rows, columns=["ep", "q", "smooth", "run", "alarm", "first_alarm"])

    return df.groupBy("ep").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(df: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Event-time tumbling counts and means with a watermark; the same plan serves batch and stream."""
    w = df.withWatermark("ts", late) if df.isStreaming else df
    return w.groupBy(F.window("ts", length).alias("w"), "k").agg(F.count("*").alias("n"), F.avg("x").alias("mean")).select(F.col("w.start").alias("start"), "k", "n", "mean")


def session_counts(df: DataFrame, gap: str = "12 hours") -> DataFrame:
    """Sessions of an episode: events no further apart than the gap."""
    return df.groupBy("ep", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("ep", F.col("w.start").alias("start"), "n")
