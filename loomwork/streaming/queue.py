"""The deferred queue as a stream: keyed state that expires by a timer, and marks that count once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTCOMES = "id long, outcome string, page_id string"
STATE = "page_id string, due long, done boolean"
DAY_MS = 86_400_000


class Deferred(StatefulProcessor):
    """stored, processed or expired, once for each id; its state goes ``keep`` days after it is due.

    Rows: id, kind (``store`` or ``processed``), page_id, at (event time). A
    second ``store`` or ``processed`` of an id is silent, and so is a mark for an
    id that is not there or has expired. What counts is event time.
    """

    def __init__(self, days: float = 7, keep: float = 7):
        self.days, self.keep = days, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        for r in frame.itertuples():
            page, due, done = self.item.get() if self.item.exists() else (None, None, None)
            if r.kind == "store" and due is None:
                due = int(r.at.timestamp() * 1000) + int(self.days * DAY_MS)
                self.item.update((r.page_id, due, False))
                self.handle.registerTimer(due)
                out.append((key[0], "stored", r.page_id))
            elif r.kind == "processed" and due is not None and not done:
                late = int(r.at.timestamp() * 1000) > due  # its timer has not run yet
                self.item.update((page, due, True))
                out.append((key[0], "expired" if late else "processed", page))
        yield pd.DataFrame(out, columns=["id", "outcome", "page_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.item.exists():
            page, due, done = self.item.get()
            if expiredTimerInfo.getExpiryTimeInMs() > due:
                self.item.clear()
            else:
                self.handle.registerTimer(due + int(self.keep * DAY_MS))
                if not done:
                    self.item.update((page, due, True))
                    out.append((key[0], "expired", page))
        yield pd.DataFrame(out, columns=["id", "outcome", "page_id"])

    def close(self) -> None:
        pass


def deferred_queue(events: DataFrame, days: float = 7, late: str = "1 day", keep: float = 7) -> DataFrame:
    """What became of each deferred id, as it becomes known. Needs the RocksDB state store."""
    keyed = events.withWatermark("at", late).groupBy("id")
    return keyed.transformWithStateInPandas(statefulProcessor=Deferred(days, keep), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
