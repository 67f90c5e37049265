"""Structured Streaming forms of the run analytics, and keyed state between runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_outcomes(runs: DataFrame, length: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts of rows and errors in tumbling or sliding windows, with a watermark for late rows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        runs.withWatermark("ts", late)
        .groupBy(window.alias("w"))
        .agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "error").alias("errored"))
        .select(F.col("w.start").alias("start"), "total", "errored")
    )


def sessions(runs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each source, closed by a gap."""
    return (
        runs.withWatermark("ts", late)
        .groupBy("source_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("source_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


STATE = "hash string, failures int"
CHANGES = "source_id long, change string, failures int"


def track(batch: DataFrame) -> DataFrame:
    """Per source: new, changed or same by content hash; a failure keeps the last good hash and counts up.

    Input: source_id, event_id (order), outcome, hash.
    """

    def step(key, frames, state: GroupState):
        last, failures = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("event_id")
        for r in rows.itertuples():
            if r.outcome == "error":
                failures += 1
                kind = "error"
            else:
                kind = "new" if last is None else "changed" if r.hash != last else "same"
                last, failures = r.hash, 0
            out.append((key[0], kind, failures))
        state.update((last, failures))
        yield pd.DataFrame(out, columns=["source_id", "change", "failures"])

    return batch.groupBy("source_id").applyInPandasWithState(step, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout)
