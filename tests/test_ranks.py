"""Running numbers against Python's sort."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf.operators import profile
from sheaf.operators.ranks import placed, ranked, running
from sheaf.sources import files


@pytest.mark.parametrize("parts", [1, 7])
def test_ranked_by_group(spark, parts):
    rows = [(g, v) for g in ("a", "b", None) for v in range(50)] + [("only", 1)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(parts)
    found = {(r["g"], r["v"]): r["rank"] for r in ranked(df, [F.col("v").desc()], groups=["g"]).collect()}
    assert found == {(g, v): (50 - v if g != "only" else 1) for g, v in rows}


def test_ranked_whole_table_and_empty(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert {r["v"] + 1 for r in ranked(df, [F.col("v")], name="n").where("n = v + 1").collect()} == set(range(1, 1001))
    assert ranked(df.where("v < 0"), [F.col("v")]).count() == 0


def test_ranked_ties_get_all_numbers(spark):
    df = spark.createDataFrame([(1,)] * 5 + [(None,)] * 3, "v int")
    found = ranked(df, [F.col("v")]).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 9)) and {r["rank"] for r in found if r["v"] is None} == {1, 2, 3}


def test_running_sums(spark):
    rows = [(g, v, v % 5) for g in ("a", None) for v in range(60)]
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(5)
    found = {(r["g"], r["v"]): (r["upto"], r["total"]) for r in running(df, [F.col("v")], "w", groups=["g"]).collect()}
    assert found == {(g, v): (sum(x % 5 for x in range(v + 1)), 120) for g, v, _ in rows}


def test_heavy_tail_is_spread_evenly(spark):
    """A Pareto column: no range holds more than twice the rows of the median one, and the ranks are exact."""
    n = 200_000
    df = spark.range(n).select(F.pow(1 - (F.col("id") * 7919 % n + 0.5) / n, F.lit(-1.5)).alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = sorted(r["count"] for r in placed(df, [F.col("v")], []).groupBy("__part").count().collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) >= 4 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    values = sorted((1 - (k + 0.5) / n) ** -1.5 for k in range(n))
    row = profile.distribution(df.withColumn("g", F.lit("x")), ["g"], "v").first()
    assert [row[c] for c in ("min", "p25", "median", "p75", "p90", "max")] == [round(values[min(n - 1, int(f * n))], 4) for f in (0, 0.25, 0.5, 0.75, 0.9, 1)]
    assert abs(profile.medians(df.withColumn("g", F.lit("x")), ["g"], "v").first()["median"] - (values[n // 2 - 1] + values[n // 2]) / 2) < 1e-9


def test_medians_of_odd_even_and_null(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 4.0), ("b", None), (None, 5.0), ("c", None)], "g string, v double")
    assert {r["g"]: r["median"] for r in profile.medians(df, ["g"], "v").collect()} == {"a": 2.0, "b": 2.5, None: 5.0}


def test_with_ordinal(spark):
    df = spark.createDataFrame([(i * 7 % 20, "x") for i in range(20)], "k int, `a.b` string").repartition(3)
    out = files.with_ordinal(df, ["a.b", "k"])
    assert sorted((r["k"], r["row_ord"]) for r in out.collect()) == [(i, i + 1) for i in range(20)] and dict(out.dtypes)["row_ord"] == "int"
