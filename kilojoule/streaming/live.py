"""Records and activities that keep arriving."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kilojoule.operators.resample import ResampleConfig


def live_sessions(records: DataFrame, pause_gap: int = 30, delay: str = "10 minutes") -> DataFrame:
    """(activity_id, begin, last, records, avg_power, avg_hr) of records (activity_id, at, power, heart_rate), a stream or a table.

    A session ends where more than pause_gap seconds are missing. Records later than the delay behind the watermark are dropped; it
    is one for the whole stream, so within the delay, order doesn't matter.
    """
    session = F.session_window("at", f"{pause_gap + 1} seconds")
    rows = records.withWatermark("at", delay).groupBy("activity_id", session)
    out = rows.agg(F.max("at").alias("last"), F.count("*").alias("records"), F.avg("power").alias("avg_power"), F.avg("heart_rate").alias("avg_hr"))
    return out.select("activity_id", F.col("session_window.start").alias("begin"), "last", "records", "avg_power", "avg_hr")


def content_id(content: Column) -> Column:
    """A file's identity: the first 12 bytes of its SHA-256, in hex."""
    return F.left(F.sha2(content, 256), F.lit(24))


def store(activities: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what the stream has now to the table at path and ends; a batch that is repeated after a failure replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return activities.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(stored: DataFrame, added: str = "added") -> DataFrame:
    """Of every content_id the row added last (of equals, of the last batch), so that what is uploaded again replaces what was there."""
    order = [F.desc(added), *([F.desc("batch")] if "batch" in stored.columns else [])]
    return stored.withColumn("_turn", F.row_number().over(Window.partitionBy("content_id").orderBy(*order))).where("_turn = 1").drop("_turn")


#: Counters of a live report, as resample()'s report has them.
COUNTERS = ("records", "duplicates", "out_of_order", "power_spikes", "gaps_filled", "gap_seconds_filled", "pauses", "paused_seconds")


class _Reports(StatefulProcessor):
    """Of each activity the last time, the segment that is open and the counters so far; a timer closes what gets no more records."""

    def __init__(self, cfg: ResampleConfig, idle_s: int | None):
        self.cfg, self.idle = cfg, None if idle_s is None else idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("report", "last long, begun long, segment long, due long, " + ", ".join(f"{c} long" for c in COUNTERS))

    def _row(self, key: tuple, last: int, begun: int, segment: int, counts: list[int], closed: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *counts, segment, begun, last, closed]], columns=["activity_id", *COUNTERS, "segment", "segment_start", "last_ts", "closed"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        last, begun, segment, due, *counts = known if known is not None else (None, 0, 0, -1, *[0] * len(COUNTERS))
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        ts = batch["ts"].to_numpy(np.int64)
        top = np.maximum.accumulate(np.concatenate([[ts[0] if last is None else last], ts]))
        late, same = ts < top[:-1], ts == top[:-1]
        if last is None:
            same[0] = False
        step = np.diff(top) - 1
        gap = np.where(late | same, 0, step)
        if last is None:
            gap[0] = 0
        filled, pause = (gap > 0) & (gap <= self.cfg.pause_gap), gap > self.cfg.pause_gap
        spikes = int((batch["power"] > self.cfg.max_power).sum()) if self.cfg.max_power is not None else 0
        new = [len(ts), int(same.sum()), int(late.sum()), spikes, int(filled.sum()), int(gap[filled].sum()), int(pause.sum()), int(gap[pause].sum())]
        counts = [int(a) + b for a, b in zip(counts, new)]
        segment = int(segment) + int(pause.sum())
        begun = int(ts[np.flatnonzero(pause)[-1]]) if pause.any() else int(ts[0]) if last is None else int(begun)
        if due >= 0:
            self.handle.deleteTimer(int(due))
        if self.idle is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(due)
        self.state.update((int(top[-1]), begun, segment, due, *counts))
        yield self._row(key, int(top[-1]), begun, segment, counts, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last, begun, segment, _, *counts = self.state.get()
            self.state.clear()
            yield self._row(key, last, begun, segment, counts, True)

    def close(self) -> None:
        pass


def live_report(records: DataFrame, cfg: ResampleConfig = ResampleConfig(), idle_s: int | None = None) -> DataFrame:
    """(activity_id, COUNTERS, segment, segment_start, last_ts, closed) of a stream of records (activity_id, seq, ts, power), a row for each
    activity of each batch with the counters so far.

    A record earlier than the last kept one of its activity is dropped and counted, in whichever batch it comes; within a batch records
    count in order of seq. Gaps of up to pause_gap seconds count as filled, longer ones begin a segment, also across batches. With
    idle_s, a last row with `closed` follows after so many seconds of processing time without records, and the activity is forgotten; such a
    query waits for its timers and so never ends by itself, as one without it does under availableNow. The state store must keep state by
    key: set spark.sql.streaming.stateStore.providerClass to the one of RocksDB.
    """
    kind = records.schema["activity_id"].dataType.simpleString()
    rows = records.where("ts is not null").select("activity_id", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("long").alias("ts"), F.col("power").cast("double").alias("power"))
    out = f"activity_id {kind}, {', '.join(c + ' long' for c in COUNTERS)}, segment long, segment_start long, last_ts long, closed boolean"
    return rows.groupBy("activity_id").transformWithStateInPandas(_Reports(cfg, idle_s), out, "Update", "None" if idle_s is None else "ProcessingTime")
