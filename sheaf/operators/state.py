"""State of queues and runs as folds of their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("e")).select("e.*")


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The oldest queued jobs."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(n)


def stale(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Running jobs whose heartbeat is older than that."""
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat_at") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))))


def run_status(jobs: DataFrame, run: str, stage_failures: Column) -> DataFrame:
    """awaiting while any job is queued or running; else failed, partial or succeeded by jobs and stage failures."""
    counts = jobs.groupBy(run).agg(F.count_if(F.col("status").isin("queued", "running")).alias("open"), F.count_if(F.col("status") == "succeeded").alias("good"), (F.count_if(F.col("status") == "failed") + F.coalesce(F.max(stage_failures), F.lit(0))).alias("bad"))
    return counts.withColumn("run_status", F.when(F.col("open") > 0, "awaiting_jobs").when((F.col("bad") > 0) & (F.col("good") > 0), "partial").when(F.col("bad") > 0, "failed").otherwise("succeeded"))


def attempts(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Adds how many failures of a key lie within the trailing window, and whether they reach the limit."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("failures", F.count("*").over(w)).withColumn("locked", F.col("failures") >= limit)


def repeats(calls: DataFrame, turn: list[str], order: str, arguments: Column) -> DataFrame:
    """Adds whether a call repeats an earlier one of its turn with the same arguments."""
    return calls.withColumn("repeated", F.row_number().over(Window.partitionBy(*turn, arguments).orderBy(order)) > 1)


def fold_deltas(deltas: DataFrame, key: list[str], order: str) -> DataFrame:
    """Tool calls from streamed pieces: the last id and name that came, and the arguments joined in order."""
    pieces = F.sort_array(F.collect_list(F.struct(order, "arguments")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return deltas.groupBy(*key).agg(last("id").alias("id"), last("name").alias("name"), F.array_join(F.transform(pieces, lambda p: F.coalesce(p.arguments, F.lit(""))), "").alias("arguments"))


def active_attachment(turns: DataFrame, conv: str, turn: str, has: Column) -> DataFrame:
    """Adds active: whether this is the last turn of its conversation that bears an attachment."""
    return turns.withColumn("active", has & (F.col(turn) == F.max(F.when(has, F.col(turn))).over(Window.partitionBy(conv))))


def page_by_budget(lines: DataFrame, by: list[str], order: str, text: str, budget: int) -> DataFrame:
    """Whole lines up to a budget of characters (each and its break); the first line comes in any case, cut if need be."""
    w = Window.partitionBy(*by).orderBy(order)
    used = F.sum(F.length(text) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(w) == 1
    return lines.withColumn("_used", used).withColumn("_first", first).where((F.col("_used") <= budget) | F.col("_first")).withColumn(text, F.when(F.col("_first") & (F.col("_used") > budget), F.substring(text, 1, budget)).otherwise(F.col(text))).drop("_used", "_first")
