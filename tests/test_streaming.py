from __future__ import annotations

import datetime

import pandas as pd

from sheaf.streaming import jobs, ledger


def drain(stream, mode="append"):
    name = f"out_{abs(hash(stream)) % 10**8}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.sql(f"select * from {name}")


def events(spark, tmp_path, rows):
    base = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(u, base + datetime.timedelta(seconds=s), k) for u, s, k in rows], "user_id long, ts timestamp, event_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))


def test_throttle_locks_and_clears(spark, tmp_path):
    stream = events(spark, tmp_path, [(1, s, "e") for s in (0, 10, 20, 30, 1000)] + [(2, 0, "e"), (2, 400, "e"), (2, 800, "e")])
    out = drain(jobs.throttle(stream, limit=3, window_s=300, lock_s=900), "update")
    found = {(r["user_id"], r["at"] % 86400): r["allowed"] for r in out.collect()}
    assert [found[1, s] for s in (0, 10, 20, 30, 1000)] == [True, True, True, False, True]
    assert all(found[2, s] for s in (0, 400, 800))


def test_windows_and_duplicates(spark, tmp_path):
    stream = events(spark, tmp_path, [(1, 0, "a"), (1, 10, "a"), (2, 4000, "a"), (3, 90000, "b")])
    counts = {(r["start"].hour, r["event_type"]): r["n"] for r in drain(jobs.windowed_counts(stream)).collect()}
    assert counts[0, "a"] == 2 and counts[1, "a"] == 1
    assert drain(jobs.deduplicated(stream, "user_id")).count() == 3


EVENT = "job_id string, at timestamp, seq long, kind string, done long, total long, error string"
FOLDS = [
    ("a", 0, "queued"), ("a", 10, "running"), ("a", 20, "heartbeat"), ("a", 200, "heartbeat"), ("a", 210, "succeeded"),  # silent for longer than 100 s
    ("b", 0, "running"), ("b", 90, "heartbeat"), ("b", 190, "succeeded"), ("b", 195, "failed"), ("b", 196, "running"),  # final states stay
    ("c", 0, "queued"), ("c", 500, "heartbeat"),  # queued jobs don't go stale
    ("d", 480, "running"), ("e", 100, "running"), ("e", 150, "progress"), ("f", 300, "running"), ("f", 310, "failed"),
]
EXPECTED = {
    "a": ("failed", 120, ledger.SWEPT, "queued>running>failed"), "b": ("succeeded", 190, None, "queued>running>succeeded"), "c": ("queued", None, None, "queued"), "d": ("running", None, None, "queued>running"),
    "e": ("failed", 250, ledger.SWEPT, "queued>running>failed"), "f": ("failed", 310, "e310", "queued>running>failed"),
}


def job_events(spark, folder, rows):
    base = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    made = [(j, base + datetime.timedelta(seconds=s), s, kind, 3 if kind == "progress" else None, None, f"e{s}") for j, s, kind in rows]
    spark.createDataFrame(made, EVENT).coalesce(1).write.mode("append").parquet(folder)


def ledger_of(spark, folder):
    base = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp()
    ms = lambda x: None if x is None else x / 1000 - base
    return {r["job_id"]: (r["status"], ms(r["finished_ms"]), r["error"], r["history"]) for r in ledger.ledger(spark, folder).collect()}


def test_ledger_in_one_run_and_over_restarts(spark, tmp_path):
    """All events at once, or a few at a time with a new stream on the same checkpoint each time, give one ledger."""
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    for name, groups in (("whole", [FOLDS]), ("parts", [[r for r in FOLDS if low <= r[1] < high] for low, high in ((0, 15), (15, 100), (100, 195), (195, 600))])):
        folder = str(tmp_path / f"{name}-in")
        for rows in groups:
            job_events(spark, folder, rows)
            stream = spark.readStream.schema(EVENT).parquet(folder)
            ledger.follow(stream, str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"), stale_s=100)
    assert ledger_of(spark, whole) == EXPECTED
    assert ledger_of(spark, parts) == EXPECTED
    before = spark.read.parquet(parts).count()
    ledger.follow(spark.readStream.schema(EVENT).parquet(str(tmp_path / "parts-in")), parts, str(tmp_path / "parts-checkpoint"), stale_s=100)  # nothing new
    assert spark.read.parquet(parts).count() == before and ledger_of(spark, parts) == EXPECTED
    assert ledger.ledger(spark, parts).where("job_id = 'e'").first()["done"] == 3


def test_ledger_of_jobs_that_share_a_bucket(spark, tmp_path):
    """One bucket for all jobs, over restarts: its timer sweeps each job that fell silent in time, to the millisecond, and large numbers stay exact."""
    base = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    folder, out, most = str(tmp_path / "in"), str(tmp_path / "out"), 2**53 + 1
    edge = [("g", 500_500, "running", None), (None, 500_501, "running", None), ("big", 500_501, "running", most), ("h", 600_501, "queued", None)]
    spark.createDataFrame([(j, base + datetime.timedelta(milliseconds=t), t, kind, done, None, None) for j, t, kind, done in edge], EVENT).coalesce(1).write.parquet(str(tmp_path / "edge"))
    for rows in ([r for r in FOLDS if r[1] < 100], [r for r in FOLDS if r[1] >= 100], None):
        job_events(spark, folder, rows) if rows else spark.read.parquet(str(tmp_path / "edge")).write.mode("append").parquet(folder)
        ledger.follow(spark.readStream.schema(EVENT).parquet(folder), out, str(tmp_path / "checkpoint"), stale_s=100, buckets=1)
    found = ledger_of(spark, out)
    assert {k: found[k] for k in "abcef"} == {k: EXPECTED[k] for k in "abcef"} and found["d"] == ("failed", 580, ledger.SWEPT, "queued>running>failed")
    assert found["g"] == ("failed", 600.5, ledger.SWEPT, "queued>running>failed") and found[None] == found["big"] == ("running", None, None, "queued>running")
    assert ledger.ledger(spark, out).where("job_id = 'big'").first()["done"] == most


def test_calls_to_the_state_store_do_not_follow_the_jobs():
    calls, kept = [], {"open": [], "final": []}

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return iter(kept[self.name])

        def put(self, rows):
            calls.append("put")
            kept[self.name] = rows

        def appendList(self, rows):
            calls.append("append")
            kept[self.name] += rows

        def clear(self):
            self.put([])

    class Handle:
        timers: list = []

        def getListState(self, name, schema):
            return State(name)

        def listTimers(self):
            return iter(self.timers)

        def registerTimer(self, at):
            calls.append("timer")

    jobs = ledger.Ledger(1000)
    jobs.init(Handle())
    for n, step in ((10, 0), (5000, 1)):
        calls.clear()
        rows = pd.DataFrame([(f"{step}-{k // 2}", k % 2, k, ("running", "succeeded")[k % 4 == 3], None, None, None) for k in range(n)], columns=["job_id", "at_ms", "seq", "kind", "done", "total", "error"])
        out = pd.concat(jobs.handleInputRows((0,), iter([rows]), None))
        assert len(out) == n / 2 and len(calls) <= 6
