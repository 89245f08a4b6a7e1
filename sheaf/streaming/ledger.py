"""The ledger of jobs as a stream: each job's state follows its events, and a timer fails it when its worker falls silent."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sheaf.operators.ranks import shared_checkpoints

#: Fixed value: the error of a job whose worker fell silent.
SWEPT = "worker stopped heartbeating; swept as stale"
TERMINAL = ("succeeded", "failed")
SCHEMA = "job_id string, status string, started_ms long, heartbeat_ms long, finished_ms long, done long, total long, error string, changes long, history string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Groups of jobs that share their state; a batch rewrites the open jobs of each bucket that it has events for.
BUCKETS = 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Ledger(StatefulProcessor):
    """Events are (job_id, at, seq, kind, done, total, error); kinds queued, running, heartbeat, progress, succeeded, failed.

    A job that isn't known is queued by its first event. Any event of a running job is a sign of life. Done and total are the last that came. A job that was
    silent for longer than `stale_ms` fails as of the moment that this time was up, whether the next event or the timer shows it, so the ledger doesn't
    depend on how events fall into batches. Succeeded and failed are final: what comes later is ignored.

    The grouping key is a bucket of jobs, not a job: calls to the state store and Python frames cost as much for one job as for thousands. A bucket keeps the
    rows of its open jobs, which each batch that has events for it writes anew, the names of its final ones, which are only added to, and one timer, for the job
    that falls silent first.
    """

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SCHEMA)
        self.final = handle.getListState("final", "job_id string")

    def _move(self, job: dict, status: str, at: int, error: str | None = None) -> None:
        job.update(status=status, error=error, finished_ms=at if status in TERMINAL else None, changes=job["changes"] + 1)
        job["history"] = f"{job['history']}>{status}" if job["history"] else status
        if status == "running":
            job["started_ms"] = at

    def _silent(self, job: dict, now: int) -> bool:
        return job["status"] == "running" and now - job["heartbeat_ms"] > self.stale_ms

    def _keep(self, jobs: dict[str | None, dict], final: list[tuple]) -> None:
        """Store the open jobs, the newly final ones and a timer for the first that will fall silent."""
        if final:
            self.final.appendList(final)
        left = [tuple(job.values()) for job in jobs.values() if job["status"] not in TERMINAL]
        self.open.put(left) if left else self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        beats = [job["heartbeat_ms"] for job in jobs.values() if job["status"] == "running"]
        if beats:
            self.handle.registerTimer(min(beats) + self.stale_ms)

    def _take(self, job: dict, at: int, kind: str, done: str | None, total: str | None, error: str | None) -> None:
        if job["status"] is None:
            self._move(job, "queued", at)
        if self._silent(job, at):
            self._move(job, "failed", job["heartbeat_ms"] + self.stale_ms, SWEPT)
        if job["status"] in TERMINAL:
            return
        job["done"] = int(done) if isinstance(done, str) else job["done"]
        job["total"] = int(total) if isinstance(total, str) else job["total"]
        if kind in TERMINAL:
            self._move(job, kind, at, error if kind == "failed" and isinstance(error, str) else None)
        elif kind == "running" and job["status"] == "queued":
            self._move(job, "running", at)
        job["heartbeat_ms"] = at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        jobs = {row[0]: dict(zip(NAMES, row, strict=True)) for row in self.open.get()}
        gone, touched = {row[0] for row in self.final.get()}, {}
        for name, at, kind, done, total, error in zip(*[events[c].tolist() for c in ("job_id", "at_ms", "kind", "done", "total", "error")], strict=True):
            name = name if isinstance(name, str) else None
            if name not in gone:
                job = touched[name] = jobs.setdefault(name, dict.fromkeys(NAMES) | {"job_id": name, "changes": 0})
                self._take(job, at, kind, done, total, error)
        if touched:
            self._keep(jobs, [(name,) for name, job in touched.items() if job["status"] in TERMINAL])
            yield _frame(touched.values())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        jobs = {row[0]: dict(zip(NAMES, row, strict=True)) for row in self.open.get()}
        swept = {name: job for name, job in jobs.items() if self._silent(job, now)}
        for job in swept.values():
            self._move(job, "failed", job["heartbeat_ms"] + self.stale_ms, SWEPT)
        self._keep(jobs, [(name,) for name in swept])
        if swept:
            yield _frame(swept.values())

    def close(self) -> None:
        pass


def _frame(jobs: Iterable[dict]) -> pd.DataFrame:
    return pd.DataFrame([tuple(job.values()) for job in jobs], columns=NAMES, dtype=object).astype({c: "Int64" for c in NAMES if c.endswith("_ms") or c in ("done", "total", "changes")})


def changes(events: DataFrame, *, stale_s: int = 900, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A row of SCHEMA for each job and batch that changed it. `events` is a stream of (job_id, at timestamp, seq long, kind, done long, total long,
    error); `late` is how far events may come out of order, and how long the timers wait besides. `buckets` stays the same for a checkpoint."""
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket")
    timed = events.withWatermark("at", late).select(bucket, "job_id", "at", F.unix_millis("at").alias("at_ms"), "seq", "kind", *[F.col(c).cast("string").alias(c) for c in ("done", "total")], "error")
    return timed.groupBy("bucket").transformWithStateInPandas(Ledger(stale_s * 1000), SCHEMA, "Append", "EventTime")


def follow(events: DataFrame, path: str, checkpoint: str, *, stale_s: int = 900, late: str = "0 seconds", buckets: int = BUCKETS) -> None:
    """Take all events that are there into the change table at `path`, once each however often this is called or broken off: the checkpoint
    knows what has been taken. Grouped state of this kind needs the RocksDB store, which is set for this stream alone."""
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = changes(events, stale_s=stale_s, late=late, buckets=buckets).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each job in a change table."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != "job_id"]), F.struct("changes", "heartbeat_ms")).alias("last")).select("job_id", "last.*")


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
