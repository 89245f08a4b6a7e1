"""Ranks and running numbers over whole tables without a one-task window: range partitions and prefix sums of their counts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir. Only where that is unset and all runs in one process (tests) is a folder made."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not given and not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="sheaf-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut by a reliable checkpoint."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, order: list[Column], *, groups: list[str] | None = None, name: str = "rank") -> DataFrame:
    """A running number `name` (from 1) in the total order `order`, within each value of the columns `groups` if there are any.

    Rows are dealt by ranges of (groups, order) and sorted within their partition, so a group of any size is spread over
    tasks; what is known of all partitions is one row for each partition and group in it, whose running sums give each partition its
    first number. Ties in `order` get different numbers in no stated order; nulls sort as Spark sorts them; an empty table gives no rows.
    """
    groups = groups or []
    keys = [F.col(f"`{g}`") for g in groups]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = checkpointed(placed.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    sizes = placed.groupBy("__part", *groups).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__part").alias("__p"), *[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)], "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    joined = placed.join(sizes, same)
    return joined.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long").alias(name))


def placed(df: DataFrame, order: list[Column], groups: list[str]) -> DataFrame:
    """Rows with `__part`, the range of (groups, order) that they fall in. Ranges are cut by a sample of the rows, not by even steps of values, so a heavy
    tail is spread like anything else; a checkpoint keeps the cuts from being drawn anew."""
    return checkpointed(df.repartitionByRange(*[F.col(f"`{g}`") for g in groups], *order).select("*", F.spark_partition_id().alias("__part")))


def running(df: DataFrame, order: list[Column], weight: str, *, groups: list[str], name: str = "upto", total: str = "total") -> DataFrame:
    """Adds the running sum of `weight` up to and including each row in `order` within its group, and the group's whole sum.

    Rows are summed by range and group; these few sums give each range what stands before it, and a window runs within a range and
    group only. Rows that tie in `order` come in no stated order, so rows should be distinct by (groups, order).
    """
    rows = placed(df, order, groups)
    keys = [F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(groups)]
    names = [f"__g{i}" for i in range(len(groups))]
    sums = rows.groupBy(F.col("__part").alias("__p"), *keys).agg(F.sum(weight).alias("__s"))
    whole = Window.partitionBy(*(names or [F.lit(0)]))
    sums = sums.select("__p", *names, F.coalesce(F.sum("__s").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__s").over(whole).alias(total))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same &= F.col(f"`{g}`").eqNullSafe(F.col(f"__g{i}"))
    inner = F.sum(weight).over(Window.partitionBy("__part", *[F.col(f"`{g}`") for g in groups]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, same).withColumn(name, F.col("__before") + inner).select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], name, total)
