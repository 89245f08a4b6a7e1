"""Snapshots: distinct rows, upserts, three-way reconciliation, guarded deactivation, supersession and checks of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def differs(old: str, new: str, columns: list[str]) -> Column:
    """Whether any column differs, null being a value."""
    return reduce(lambda a, b: a | b, [~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in columns])


def digest(columns: list[str]) -> Column:
    """A fingerprint of named values, whatever the order of the names."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows of both; a new row replaces the old one of its key, but a null in a `preserve` column keeps the old value."""
    joined = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full")
    rest = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in preserve else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in keys]
    return joined.select(*keys, *rest)


def reconcile(old: DataFrame, new: DataFrame, key: str, compare: list[str], *, active: str = "is_active", complete: bool = True, least_share: float = 0.9, guard_from: int = 100) -> DataFrame:
    """One row per key with its action: insert, update, touch, reactivate, deactivate, retain (guarded) or leave.

    Rows that are missing from the new snapshot are deactivated only after a complete discovery that saw at least `least_share`
    of the active rows, once there are `guard_from` of them. The guard is one scalar beside the full outer join.
    """
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    seen = old.where(active).join(new, key, "left_semi").count() if complete else 0
    known = old.where(active).count()
    may = complete and not (known >= guard_from and seen < least_share * known)
    action = (
        F.when(F.col(f"o.{key}").isNull(), "insert")
        .when(F.col(f"n.{key}").isNull() & ~F.col(f"o.{active}"), "leave")
        .when(F.col(f"n.{key}").isNull(), "deactivate" if may else "retain")
        .when(~F.col(f"o.{active}"), "reactivate")
        .when(differs("o", "n", compare), "update")
        .otherwise("touch")
    )
    return j.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), action.alias("action"))


def apply_actions(old: DataFrame, new: DataFrame, actions: DataFrame, key: str, active: str = "is_active") -> DataFrame:
    """The old snapshot after its actions; applying the same snapshot again changes nothing."""
    columns = [c for c in old.columns if c not in (key, active)]
    j = actions.join(old.alias("o"), key, "left").join(new.alias("n"), key, "left")
    fresh = F.col("action").isin("insert", "update", "reactivate")
    return j.select(key, *[F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns], F.when(fresh | (F.col("action") == "touch"), True).when(F.col("action") == "deactivate", False).otherwise(F.col(f"o.{active}")).alias(active))


def supersede(docs: DataFrame, partition: list[str], *, status: str = "status", order: list[str]) -> DataFrame:
    """Adds `outcome`: of the ready versions of one document the newest is live and older ones archived; pending ones wait."""
    ready = F.col(status) == "ready"
    w = Window.partitionBy(*partition)
    newest = F.max(F.when(ready, F.struct(*order))).over(w)
    return docs.withColumn("outcome", F.when(~ready, F.col(status)).when(F.struct(*order) == newest, "live").otherwise("archived"))


def violations(df: DataFrame, *, unique: dict[str, tuple[list[str], str | None]] = {}, checks: dict[str, str] = {}, foreign: dict[str, tuple[str, DataFrame, str]] = {}) -> DataFrame:  # noqa: B006
    """Per rule, how many rows break it: unique keys (of rows under a condition), conditions, and keys of another table."""
    parts = []
    for name, (keys, where) in unique.items():
        groups = (df.where(where) if where else df).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(name).alias("rule"), "rows"))
    if checks:
        one = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(f"c{i}") for i, c in enumerate(checks.values())])
        parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("rows")) for i, n in enumerate(checks)])).alias("x")).select("x.*"))
    for name, (column, other, key) in foreign.items():
        orphans = df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)).distinct(), column, "left_anti")
        parts.append(orphans.agg(F.count("*").alias("rows")).select(F.lit(name).alias("rule"), "rows"))
    return reduce(DataFrame.unionByName, parts)
