"""Episode state over a stream of steps: recoveries and step budgets, the same rows as the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEPS = "episode_id long, step long, tool string, error_code string, resolves string"
FOUND = "episode_id long, error_code string, failure_step long, recovery_step long, recovery_tool string"
STATE = "open map<string,long>, next long, waiting array<struct<step:long,tool:string,error_code:string,resolves:string>>"


def recoveries_of(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Closes the latest open failure of a code at the first step that resolves it.

    Steps are taken in step order: one that comes early waits for those before it, one that comes again is dropped. The
    state holds the open failures, the next step, and what waits.
    """
    open_, following, waiting = state.get if state.exists else ({}, 1, [])
    open_, rows = dict(open_ or {}), {r[0]: tuple(r) for r in waiting or []}
    for frame in frames:
        for r in frame.itertuples(index=False):
            if r.step >= following:
                rows.setdefault(int(r.step), (int(r.step), r.tool, r.error_code, r.resolves))
    out = []
    while following in rows:
        step, tool, error, resolves = rows.pop(following)
        if isinstance(error, str):
            open_[error] = step
        if isinstance(resolves, str) and resolves in open_:
            out.append((key[0], resolves, open_.pop(resolves), step, tool))
        following += 1
    state.update((open_, following, [rows[s] for s in sorted(rows)]))
    yield pd.DataFrame(out, columns=["episode_id", "error_code", "failure_step", "recovery_step", "recovery_tool"])


def streaming_recoveries(steps: DataFrame) -> DataFrame:
    """Recoveries of a streaming (or batch-sourced) DataFrame of steps, as they happen."""
    keyed = steps.select(*[c.split()[0] for c in STEPS.split(", ")])
    return keyed.groupBy("episode_id").applyInPandasWithState(recoveries_of, FOUND, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_failures(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Failures by tool in tumbling event-time windows, closed once the watermark has passed."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return marked.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
