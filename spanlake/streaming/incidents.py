"""Open incidents as state: extend or close them as detections arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanlake.schemas import WATERMARK_SECONDS, WINDOW_SECONDS

KEY = ["target_type", "target", "detector"]
OUTPUT = (
    "target_type string, target string, detector string, incident_id string, start_window bigint, end_window bigint, "
    "window_count bigint, peak_severity string, peak_deviation double, closed boolean"
)
_STATE = "opened long, start_window long, end_window long, window_count long, peak_severity string, peak_deviation double"
_RANK = {"warning": 1, "critical": 2}


class OpenIncidents(StatefulProcessor):
    """One open incident per (target type, target, detector).

    A detection extends the open incident or, after a gap, closes it and opens
    the next. Event time passing the end plus a window closes it, too. One that
    comes late (within the watermark) moves the start back where it joins the open
    incident, which keeps its id, and else is a closed incident of its own.
    """

    def __init__(self, window_seconds: int):
        self.window_seconds = window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _STATE)

    def _row(self, key, incident, closed: bool) -> dict:
        opened, start, end, count, severity, deviation = incident
        return {
            **dict(zip(KEY, key)),
            "incident_id": f"{':'.join(key)}:{opened}",
            "start_window": start,
            "end_window": end,
            "window_count": count,
            "peak_severity": severity,
            "peak_deviation": deviation,
            "closed": closed,
        }

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A key has at most one detection per window, so its batch is small.
        batch = pd.concat(list(rows)).sort_values("window_start")
        incident = self.open.get() if self.open.exists() else None
        out = []
        for at, severity, deviation in zip(batch["window_start"], batch["severity"], batch["deviation"]):
            at, deviation = int(at), float(deviation)
            alone = (at, at, at, 1, severity, deviation)
            if incident is not None and incident[1] - at > self.window_seconds:
                out.append(self._row(key, alone, True))
                continue
            if incident is not None and at - incident[2] > self.window_seconds:
                out.append(self._row(key, incident, True))
                incident = None
            if incident is None:
                incident = alone
                continue
            opened, start, end, count, top, peak = incident
            if (_RANK[severity], abs(deviation)) > (_RANK[top], abs(peak)):
                top, peak = severity, deviation
            incident = (opened, min(start, at), max(end, at), count + 1, top, peak)
        out.append(self._row(key, incident, False))
        self.open.update(incident)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((incident[2] + self.window_seconds) * 1000)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([self._row(key, self.open.get(), True)])
            self.open.clear()

    def close(self) -> None:
        pass


def stream_open_incidents(
    detections: DataFrame, window_seconds: int = WINDOW_SECONDS, delay_seconds: int = WATERMARK_SECONDS
) -> DataFrame:
    """Updates of incidents; the row with the largest (window_count, closed) per id stands.

    Needs the RocksDB state store provider.
    """
    events = detections.withColumn("event_time", F.timestamp_seconds("window_start")).withWatermark(
        "event_time", f"{delay_seconds} seconds"
    )
    return events.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=OpenIncidents(window_seconds),
        outputStructType=OUTPUT,
        outputMode="Update",
        timeMode="EventTime",
    )
