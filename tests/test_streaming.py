import datetime as dt

import pytest
from pyspark.sql import functions as F

from changeloom.streaming import queue


@pytest.fixture
def stream(spark, tmp_path):
    """Writes each list of rows as one file of a stream, and collects what a query over the stream gives."""

    def run(batches, schema, make, mode="append"):
        folder = f"{tmp_path}/in"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
            _ = i
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = make(source).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return [r.asDict() for r in spark.table("out").collect()]

    return run


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 12, minute, second)


def test_jobs_are_added_once(stream):
    rows = [[("q", "a", at(0)), ("q", "b", at(0))], [("q", "a", at(1)), ("r", "a", at(1))]]
    got = stream(rows, "queue string, job_id string, ts timestamp", queue.added_once)
    assert sorted((r["queue"], r["job_id"]) for r in got) == [("q", "a"), ("q", "b"), ("r", "a")]


def test_state_machine():
    steps = [("add", ("waiting", 0, 0)), ("start", ("active", 1, 0)), ("fail", ("delayed", 1, 100)), ("start", ("active", 2, 0)), ("fail", ("delayed", 2, 200)), ("start", ("active", 3, 0)), ("fail", ("failed", 3, 0)), ("done", ("failed", 3, 0)), ("add", ("waiting", 0, 0))]
    state, attempts = None, 0
    for event, want in steps:
        got = queue.next_state(state, attempts, event, 3, 100)
        assert got == want
        state, attempts = got[:2]
    assert queue.next_state("active", 1, "recover", 3, 100) == ("waiting", 1, 0) and queue.next_state("active", 3, "recover", 3, 100) == ("failed", 3, 0)


def test_job_states(stream):
    schema = "queue string, job_id string, seq int, event string, ts timestamp"
    first = [("q", "a", 1, "add", at(0)), ("q", "a", 3, "log", at(1)), ("q", "a", 2, "start", at(1)), ("q", "b", 1, "add", at(0))]
    second = [("q", "a", 4, "fail", at(2)), ("q", "b", 2, "start", at(2)), ("q", "b", 3, "done", at(3))]
    got = stream([first, second], schema, lambda s: queue.job_states(s, delay_ms=50, late="1 hour"), "update")
    last = {r["job_id"]: (r["state"], r["attempts"], r["log_lines"]) for r in sorted(got, key=lambda r: r["at"])}
    assert last == {"a": ("delayed", 1, 1), "b": ("completed", 1, 0)}


def test_delays_end_and_finished_jobs_are_forgotten(stream):
    """By event time: a delayed job is due when the watermark passes its delay, and a finished one starts anew after its keeping."""
    schema = "queue string, job_id string, seq int, event string, ts timestamp"
    batches = [
        [("q", "a", 1, "add", at(0)), ("q", "a", 2, "start", at(0)), ("q", "a", 3, "fail", at(1)), ("q", "b", 1, "add", at(0)), ("q", "b", 2, "start", at(0)), ("q", "b", 3, "done", at(1)), ("q", "b", 4, "log", at(1))],
        [("q", "c", 1, "add", at(5))], [("q", "c", 2, "log", at(6))], [("q", "a", 4, "start", at(7)), ("q", "b", 5, "done", at(7))], [("q", "c", 3, "log", at(30))], [("q", "c", 4, "log", at(31))], [("q", "b", 6, "log", at(32))],
    ]
    got = stream(batches, schema, lambda s: queue.job_states(s, delay_ms=120_000, keep_ms=600_000, late="0 seconds"), "update")
    told = [(r["job_id"], r["state"], r["attempts"], r["log_lines"]) for r in got]
    assert [t for t in told if t[0] == "a"] == [("a", "delayed", 1, 0), ("a", "waiting", 1, 0), ("a", "active", 2, 0)]
    due = next(r for r in got if r["job_id"] == "a" and r["state"] == "waiting")
    assert due["at"].minute == 3  # a minute after the failure, and two of delay
    assert [t for t in told if t[0] == "b"] == [("b", "completed", 1, 1), ("b", "completed", 1, 1), ("b", "waiting", 0, 1)]


def test_windows_and_flags(stream, spark):
    rows = [[(at(0), "x", 1.0), (at(4), "x", 2.0), (at(6), "y", 5.0)], [(at(40), "x", 1.0)]]
    got = stream(rows, "ts timestamp, event_type string, value double", queue.event_windows)
    assert sorted((r["start"].minute, r["event_type"], r["n"], r["total"]) for r in got) == [(0, "x", 2, 3.0), (5, "y", 1, 5.0)]


def test_flags_join_within_their_time(spark):
    rows = spark.createDataFrame([("k", at(0)), ("k", at(0, 30)), ("k", at(5))], "key string, ts timestamp")
    got = queue.flags(rows, 60).orderBy("since").collect()
    assert [(r.since.minute, r.until.second + 60 * r.until.minute, r.settings) for r in got] == [(0, 90, 2), (5, 360, 1)]


def test_stale(spark):
    targets = spark.createDataFrame([("r", "1"), ("s", "2")], "repo string, sha string")
    done = spark.createDataFrame([("r", "1", 3), ("s", "2", 2)], "repo string, sha string, version int")
    assert [r.repo for r in queue.stale(targets, done, 3).collect()] == ["s"]


def test_only_new_blobs_are_parsed(spark, tmp_path):
    known, folder = f"{tmp_path}/known", f"{tmp_path}/files"
    spark.createDataFrame([("b1", 1)], "blob string, n int").write.parquet(known)
    spark.createDataFrame([("b1", "xx"), ("b2", "yyy"), ("b2", "yyy")], "blob string, text string").write.parquet(folder)
    source = spark.readStream.schema("blob string, text string").parquet(folder)
    parse = lambda df: df.select("blob", F.length("text").alias("n"))
    queue.reparse_new(source, known, parse).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.blob, r.n) for r in spark.read.parquet(known).collect()) == [("b1", 1), ("b2", 3)]
