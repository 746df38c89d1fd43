"""Job status as keyed state: what a job last said, its newest lines, and an end for jobs that were stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a query with lists and processing-time timers in its state starts with. Without the second it would never run out of batches;
#: timers then go off with the next rows that come.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
SCHEMA = "job_id long, stage string, done long, total long, status string, log array<string>"


class JobStatus(StatefulProcessor):
    """Folds a job's progress rows into its status. Rows may come late, split and repeated: seq decides, not arrival.

    State of a job: one row, and its newest `lines` lines. `keep` after a stopped job's last row a timer clears both.
    """

    def __init__(self, lines: int, keep: timedelta):
        self.most, self.keep = lines, int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, stage string, done long, total long, status string, stopped boolean")
        self.lines = handle.getListState("lines", "seq long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        lines = {seq: line for seq, line in map(tuple, self.lines.get())} if self.lines.exists() else {}
        for pdf in rows:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for seq, stage, done, total, status, line in pdf[["seq", "stage", "done", "total", "status", "line"]].itertuples(index=False, name=None):
                stopped = status == "stopped" or last is not None and last[5]
                newest = last is None or seq >= last[0]
                last = (seq, stage, done, total, status, stopped) if newest else (*last[:5], stopped)
                lines[seq] = line
            for seq in sorted(lines)[: -self.most]:
                del lines[seq]
        self.last.update(last)
        self.lines.put(sorted(lines.items()))
        if last[5]:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
        status = "stopped" if last[5] else last[4]
        row = (key[0], *last[1:4], status, [line for _, line in sorted(lines.items()) if line is not None])
        yield pd.DataFrame([row], columns=["job_id", "stage", "done", "total", "status", "log"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.lines.clear()
        yield pd.DataFrame(columns=["job_id", "stage", "done", "total", "status", "log"])

    def close(self) -> None:
        pass


def job_stream(progress: DataFrame, lines: int = 40, keep: timedelta = timedelta(days=1)) -> DataFrame:
    """job_id, stage, done, total, status, log of each job that a batch touches, for update mode.

    progress: a stream of job_id, seq, stage, done, total, status, line. The row with the greatest seq is what a job last said; a
    stopped job stays stopped; the log is its newest lines. The state of a job is bounded by `lines`; a stopped job's is
    cleared once it has been silent for `keep`, and rows that come later still begin it anew.
    """
    return progress.groupBy("job_id").transformWithStateInPandas(JobStatus(lines, keep), SCHEMA, "update", "ProcessingTime")


def run_jobs(status: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a job_stream over what is there and stop; `then` gets each batch's rows. A query keeps the settings that it starts with, so
    those that it needs are set for its start only."""
    conf = status.sparkSession.conf
    before = {k: conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            conf.set(k, v)
        return status.writeStream.outputMode("update").foreachBatch(then).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
