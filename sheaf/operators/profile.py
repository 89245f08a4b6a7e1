"""Profiles: distributions, bands, breakdowns, transitions, ordered frequencies and evaluation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.numbers import ratio
from sheaf.operators.ranks import running

#: Bands of a share; zero stands alone, the others are half open.
BANDS = [("0", 0.0, 0.0), (">0-<0.20", 0.0, 0.20), ("0.20-<0.50", 0.20, 0.50), ("0.50-<0.80", 0.50, 0.80), (">=0.80", 0.80, 1.01)]


def distribution(df: DataFrame, by: list[str], value: str, fractions: dict[str, float] | None = None) -> DataFrame:
    """n, min, the values at floor(fraction * n), max and how many are zero, per group; nulls don't count.

    Equal values meet first (in the map-side combine); what is left is ranged by sampled cuts and running sums of the counts give the ranks, so a
    group of any size and shape is dealt over tasks and never collected into an array.
    """
    fractions = fractions or {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    at = lambda f: F.least(F.floor(F.lit(f) * F.col("_n")), F.col("_n") - 1)
    ranks = {name: at(f) for name, f in fractions.items()}
    return values_at(df, by, value, ranks).select(*by, F.col("_n").alias("n"), F.round("_min", 4).alias("min"), *[F.round(name, 4).alias(name) for name in fractions], F.round("_max", 4).alias("max"), F.col("_zero").alias("zero"))


def values_at(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group _n, _min, _max, _zero and the value of each rank (a number from 0, in terms of the column _n), exactly; nulls don't count."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy("_v", *by).agg(F.count("*").alias("_c"))
    placed = running(counts, [F.col("_v")], "_c", groups=by, name="_upto", total="_n")
    here = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
    return placed.groupBy(*by).agg(F.first("_n").alias("_n"), F.min("_v").alias("_min"), *[F.max(F.when(here(r), F.col("_v"))).alias(name) for name, r in ranks.items()], F.max("_v").alias("_max"), F.sum(F.when(F.col("_v") == 0, F.col("_c")).otherwise(0)).alias("_zero"))


def medians(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """The middle value per group, or the mean of the two in the middle; nulls don't count, a group of nulls has no row."""
    n = F.col("_n")
    both = values_at(df, by, value, {"_a": F.floor((n - 1) / 2), "_b": F.floor(n / 2)})
    return both.select(*by, ((F.col("_a") + F.col("_b")) / 2).alias(name))


def band(c: Column) -> Column:
    out = F.when(c <= 0, BANDS[0][0])
    for name, _, high in BANDS[1:-1]:
        out = out.when(c < high, name)
    return out.otherwise(BANDS[-1][0])


def banded(df: DataFrame, value: str) -> DataFrame:
    """Rows per band, also of bands without any."""
    spark = df.sparkSession
    every = spark.createDataFrame([(i, name) for i, (name, _, _) in enumerate(BANDS)], "position int, band string")
    found = df.where(F.col(value).isNotNull()).groupBy(band(F.col(value)).alias("band")).agg(F.count("*").alias("n"))
    return F.broadcast(every).join(found, "band", "left").select("position", "band", F.coalesce("n", F.lit(0)).alias("n"))


def frequencies(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Long form: metric, key and count for each dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), c.cast("string").alias("key")) for name, c in dimensions.items()]))
    return df.select(pairs.alias("p")).groupBy("p.metric", "p.key").agg(F.count("*").alias("n"))


def ordered(counts: DataFrame, preferred: list[str], key: str = "key", n: str = "n") -> DataFrame:
    """Adds position: names of the preferred vocabulary first, in its order, then by count, then by name."""
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(key))
    return counts.withColumn("position", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(F.lit(len(preferred) + 1)), F.desc(n), F.col(key))))


def breakdown(df: DataFrame, dimensions: list[str], blob: str, status: str, ready: str = "ready") -> DataFrame:
    """Files, distinct blobs and those of the status `ready` along each dimension on its own."""
    sets = [[d] for d in dimensions]
    long = df.select(blob, status, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("label")) for (d,) in sets])).alias("x"))
    return long.groupBy("x.dimension", "x.label").agg(F.count("*").alias("files"), F.countDistinct(blob).alias("blobs"), F.count_if(F.col(status) == ready).alias("done"))


def transitions(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.concat(F.coalesce(F.col(a), F.lit("none")), F.lit("->"), F.coalesce(F.col(b), F.lit("none"))).alias("transition")).agg(F.count("*").alias("n"))


def retrieval_scores(outcomes: DataFrame) -> DataFrame:
    """recall_at_k, mrr, abstention_recall, false_refusal_rate and both counts from (answerable, abstained, returned, expected);
    raises over no questions."""
    position = F.when(~F.col("abstained") & F.col("expected").isNotNull(), F.array_position("returned", F.col("expected")))
    hit = F.col("answerable") & (F.coalesce(position, F.lit(0)) > 0)
    one = outcomes.agg(F.count("*").alias("n"), F.count_if("answerable").alias("answerable"), F.count_if(~F.col("answerable")).alias("unanswerable"), F.count_if(hit).alias("hits"), F.sum(F.when(hit, 1.0 / position).otherwise(0.0)).alias("rr"), F.count_if(~F.col("answerable") & F.col("abstained")).alias("right"), F.count_if(F.col("answerable") & F.col("abstained")).alias("wrong"))
    checked = F.when(F.col("n") == 0, F.raise_error(F.lit("no outcomes to score"))).otherwise(F.col("answerable"))
    return one.select(ratio(F.col("hits"), checked, 6).alias("recall_at_k"), ratio(F.col("rr"), F.col("answerable"), 6).alias("mrr"), ratio(F.col("right"), F.col("unanswerable"), 6).alias("abstention_recall"), ratio(F.col("wrong"), F.col("answerable"), 6).alias("false_refusal_rate"), "answerable", "unanswerable")


def longest_runs(df: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Per group the longest run of `legacy` states, which `trusted` ends and anything else doesn't touch."""
    judged = df.where(F.col(state).isin("legacy", "trusted"))
    island = judged.withColumn("_i", F.sum(F.when(F.col(state) == "trusted", 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(order)))
    return island.groupBy(*by, "_i").agg(F.count_if(F.col(state) == "legacy").alias("run")).groupBy(*by).agg(F.max("run").alias("longest_run"))
