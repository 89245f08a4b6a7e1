"""Catalog work: taxonomies, version caches, scopes, closed tallies and checks of batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.ranks import checkpointed
from sheaf.operators.sets import first_rows


def chains(categories: DataFrame, id_col: str, parent: str, name: str) -> DataFrame:
    """(id, chain): names from each category up to its root, nearest first, however deep; a cycle ends the walk where it closes.

    Each round joins every unfinished walk to the walk that begins where it stands, which doubles it, so a tree of depth d takes log2(d) rounds; each
    round is checkpointed, and the rounds end when no walk is unfinished. Ids are unique; a parent that isn't there is a root's.
    """
    here = lambda c: F.col("`" + c.replace("`", "``") + "`")
    now = categories.select(here(id_col).alias("id"), here(parent).alias("up"), F.array(here(name)).alias("chain"), F.array(here(id_col)).alias("seen"))
    while True:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("chain").alias("more"), F.col("seen").alias("behind"))
        joined = now.join(above, "up", "left").select("id", "next", F.when(F.col("behind").isNull(), F.col("chain")).otherwise(F.concat("chain", "more")).alias("chain"), F.when(F.col("behind").isNull(), F.col("seen")).otherwise(F.concat("seen", "behind")).alias("seen"))
        fresh = F.array_distinct("seen")  # one parent each: from the first repeated id on all are repeated
        now = checkpointed(joined.select("id", F.when(F.size(fresh) == F.size("seen"), F.col("next")).alias("up"), F.slice("chain", 1, F.size(fresh)).alias("chain"), fresh.alias("seen")))
        if now.where("up is not null").isEmpty():
            return now.select("id", "chain")


def sections(chained: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds section: of `parent/child` pairs along the chain the first that is named, or else the first single name."""
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    pairs = F.transform(F.sequence(F.lit(1), F.size("chain")), lambda i: F.concat(F.coalesce(F.get(F.col("chain"), i), F.lit("")), F.lit("/"), F.get(F.col("chain"), i - 1)))
    first = lambda keys: F.get(F.filter(F.transform(keys, lambda k: lookup[k]), lambda x: x.isNotNull()), F.lit(0))
    return chained.withColumn("section", F.coalesce(first(pairs), first(F.col("chain"))))


def resolve_cache(wanted: DataFrame, cache: DataFrame, key: str, unit: str, version: str) -> DataFrame:
    """Per key whether its cached units serve the version: cold (none), partial, or warm, and how many are to be done anew."""
    fresh = cache.where(F.col("version") == version).select(key, unit, F.lit(True).alias("hit"))
    j = wanted.join(fresh, [key, unit], "left").groupBy(key).agg(F.count("*").alias("units"), F.count("hit").alias("cached"))
    return j.select(key, "units", (F.col("units") - F.col("cached")).alias("stale"), F.when(F.col("cached") == 0, "cold").when(F.col("cached") < F.col("units"), "partial").otherwise("warm").alias("state"))


def triage(blobs: DataFrame, indexed: DataFrame, content: str, identity: str) -> DataFrame:
    """Adds triage: already_current (this content is indexed), replacement_candidate (the source has other content), new_source."""
    same = indexed.select(content).distinct().withColumn("_c", F.lit(True))
    known = indexed.select(identity).distinct().withColumn("_i", F.lit(True))
    return blobs.join(same, content, "left").join(known, identity, "left").withColumn("triage", F.when(F.col("_c"), "already_current").when(F.col("_i"), "replacement_candidate").otherwise("new_source")).drop("_c", "_i")


def tally(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """Counts of a closed vocabulary, zeros included."""
    one = df.agg(*[F.count_if(F.col(column) == v).alias(f"c{i}") for i, v in enumerate(vocabulary)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(f"c{i}").alias("n")) for i, v in enumerate(vocabulary)])).alias("x")).select("x.*")


def requeue(documents: DataFrame, jobs: DataFrame, key: str, identity: str, order: list[Column]) -> DataFrame:
    """The latest failed document of each identity that no queued or running job has."""
    latest = first_rows(documents, [identity], order).where("status = 'failed'")
    return latest.join(jobs.where(F.col("status").isin("queued", "running")).select(key).distinct(), key, "left_anti")


def pair_category(a: Column, b: Column) -> Column:
    """Two verdicts as one of seven categories."""
    good = lambda c: c == "extracted"
    return F.when(a.isNull() | b.isNull(), "missing").when(good(a) & good(b), "both_good").when(a == b, "same_problem").when(good(a), "second_worse").when(good(b), "second_better").when((a == "failed") | (b == "failed"), "one_failed").otherwise("different_problems")


def batch_order_errors(batch: DataFrame, by: str, index: str) -> DataFrame:
    """Batches whose indexes aren't 0 to n - 1, each once."""
    return batch.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high")).where("d <> n or low <> 0 or high <> n - 1").select(by)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
