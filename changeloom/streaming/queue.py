"""The job queue as streams: jobs added once, states with retries and backoff, flags that expire, stale targets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STATE_SCHEMA = "state string, attempts int, log_lines long"
JOB_SCHEMA = "queue string, job_id string, state string, attempts int, run_after_ms long, log_lines long, at timestamp"


def added_once(jobs: DataFrame, within: str = "1 hour") -> DataFrame:
    """Jobs (queue, job_id, ts): one of each id, however often it is added."""
    return jobs.withWatermark("ts", within).dropDuplicatesWithinWatermark(["queue", "job_id"])


def next_state(state: str | None, attempts: int, event: str, max_attempts: int, delay_ms: int) -> tuple[str, int, int]:
    """(state, attempts, delay until the next run in ms) after an event: add, start, done, fail, recover."""
    if event == "start" and state in ("waiting", "delayed"):
        return "active", attempts + 1, 0
    if event == "done" and state == "active":
        return "completed", attempts, 0
    if event in ("fail", "recover") and state == "active":
        if attempts >= max_attempts:
            return "failed", attempts, 0
        return ("delayed", attempts, delay_ms * 2 ** max(0, attempts - 1)) if event == "fail" else ("waiting", attempts, 0)
    if event == "add" and state in (None, "completed", "failed"):
        return "waiting", 0, 0
    return state or "waiting", attempts, 0


class JobStates(StatefulProcessor):
    """A job's state, with one timer: a delayed job's next run, or the end of a finished one's keeping."""

    def __init__(self, max_attempts: int, delay_ms: int, keep_ms: int, by_events: bool):
        self.max_attempts, self.delay_ms, self.keep_ms, self.by_events = max_attempts, delay_ms, keep_ms, by_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", STATE_SCHEMA)

    def told(self, key: tuple, state: str, attempts: int, wait: int, lines: int, at: pd.Timestamp) -> pd.DataFrame:
        return pd.DataFrame({"queue": [key[0]], "job_id": [key[1]], "state": [state], "attempts": [attempts], "run_after_ms": [wait], "log_lines": [lines], "at": [at]})

    def timed(self, at_ms: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        name, attempts, lines = self.job.get() if self.job.exists() else (None, 0, 0)
        # Log lines are only counted; what is held of a batch are the few events that change the state.
        steps, last = [], None
        for part in rows:
            logs = part["event"] == "log"
            lines, last = lines + int(logs.sum()), max(x for x in (last, part["ts"].max()) if x is not None)
            steps.append(part.loc[~logs, ["seq", "event"]])
        wait = 0
        for event in pd.concat(steps).sort_values("seq", kind="stable")["event"]:
            name, attempts, wait = next_state(name, attempts, event, self.max_attempts, self.delay_ms)
        name = name or "waiting"
        self.job.update((name, int(attempts), int(lines)))
        now = int(last.timestamp() * 1000) if self.by_events else timerValues.getCurrentProcessingTimeInMs()
        self.timed(now + wait if name == "delayed" else now + self.keep_ms if name in ("completed", "failed") else None)
        yield self.told(key, name, int(attempts), int(wait), int(lines), last)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            name, attempts, lines = self.job.get()
            if name == "delayed":  # it is due
                self.job.update(("waiting", attempts, lines))
                yield self.told(key, "waiting", attempts, 0, lines, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))
            elif name in ("completed", "failed"):
                self.job.clear()


def job_states(events: DataFrame, *, max_attempts: int = 3, delay_ms: int = 1000, keep_ms: int = 86_400_000, late: str | None = None) -> DataFrame:
    """Events (queue, job_id, seq, event, ts) to the state of their job after each batch, and when a delayed job is due.

    Events of a job are taken in the order of seq; a `log` event only counts a line. A delayed job waits again when its delay has passed, and a
    finished one is forgotten after keep_ms, so the state does not grow for ever; an event for a forgotten job starts it anew. Timers go by the clock, or, with `late`, by the events' own
    time, behind the watermark that it sets. Needs the RocksDB state store, which is set for the session if none is.
    """
    spark, provider = events.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(provider, None) or ""):
        spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = (events.withWatermark("ts", late) if late else events).groupBy("queue", "job_id")
    return keyed.transformWithStateInPandas(JobStates(max_attempts, delay_ms, keep_ms, bool(late)), JOB_SCHEMA, "Update", "EventTime" if late else "ProcessingTime")


def flags(events: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Spans in which a flag (key, ts) is set: each setting holds for ttl_seconds, and settings within it join."""
    span = F.session_window("ts", f"{ttl_seconds} seconds")
    return events.withWatermark("ts", late).groupBy("key", span).agg(F.count("*").alias("settings")).select("key", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "settings")


def event_windows(events: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by time window."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def stale(targets: DataFrame, analysed: DataFrame, version: int) -> DataFrame:
    """Targets (repo, sha) whose newest analysis is of another sha or another version."""
    return targets.join(analysed.where(F.col("version") == version).select("repo", "sha"), ["repo", "sha"], "left_anti")


def reparse_new(files: DataFrame, known_path: str, parse):
    """A foreachBatch function: parses the blobs (blob, text) that the table at known_path has not, and appends them."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.parquet(known_path).select("blob")
        parse(batch.dropDuplicates(["blob"]).join(seen, "blob", "left_anti")).write.mode("append").parquet(known_path)

    return files.writeStream.foreachBatch(each)
