"""Queries that run as streams over the given tables until all of them is taken, and walks over paged collections of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.ranks import ranked
from sheaf.plans.registry import query, table
from sheaf.sources import paging
from sheaf.streaming import ledger

STALE_S = 14_400


@query("job_ledger", f"""WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS job_id, event_id, (epoch_us(ts) // 1000) AS t, event_type, row_number() OVER w AS rn, lag((epoch_us(ts) // 1000)) OVER w AS before, max((epoch_us(ts) // 1000)) OVER () AS now FROM events WINDOW w AS (PARTITION BY user_id || '-' || strftime(ts, '%Y-%m-%d') ORDER BY (epoch_us(ts) // 1000), event_id)),
s AS (SELECT *, min(rn) FILTER (event_type = 'click') OVER (PARTITION BY job_id) AS start FROM e),
f AS (SELECT *, coalesce(rn > start AND t - before > {STALE_S * 1000}, false) AS silent FROM s),
d AS (SELECT *, min(rn) FILTER (silent OR event_type IN ('purchase', 'error')) OVER (PARTITION BY job_id) AS term FROM f),
j AS (SELECT job_id, any_value(term) AS term, any_value(start) AS start, any_value(now) AS now, max(t) AS last, bool_or(silent) FILTER (rn = term) AS silent, any_value(event_type) FILTER (rn = term) AS kind, any_value(t) FILTER (rn = term) AS ended, any_value(before) FILTER (rn = term) AS prev, any_value(event_id) FILTER (rn = term) AS ender, any_value(t) FILTER (rn = start) AS began,
  max(event_id) FILTER (event_type = 'view' AND (term IS NULL OR rn < term)) AS done FROM d GROUP BY job_id),
k AS (SELECT *, start IS NOT NULL AND (term IS NULL OR start < term) AS ran, term IS NULL AND start IS NOT NULL AND now - last > {STALE_S * 1000} AS swept FROM j)
SELECT job_id, CASE WHEN silent OR swept THEN 'failed' WHEN kind = 'purchase' THEN 'succeeded' WHEN kind = 'error' THEN 'failed' WHEN ran THEN 'running' ELSE 'queued' END AS status, CASE WHEN ran THEN began END AS started_ms, CASE WHEN silent THEN prev + {STALE_S * 1000} WHEN swept THEN last + {STALE_S * 1000} ELSE ended END AS finished_ms, done,
CASE WHEN silent OR swept THEN '{ledger.SWEPT}' WHEN kind = 'error' THEN 'event ' || ender END AS error FROM k""")
def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs of a user and day. The path is a pattern, so that a file streams like a folder does."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    kinds = F.create_map(*[F.lit(x) for kv in {"signup": "queued", "click": "running", "view": "progress", "purchase": "succeeded", "error": "failed"}.items() for x in kv])
    view = F.col("event_type") == "view"
    told = events.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.coalesce(kinds[F.col("event_type")], F.lit("heartbeat")).alias("kind"), F.when(view, F.col("event_id")).alias("done"), F.lit(None).cast("long").alias("total"), F.concat(F.lit("event "), F.col("event_id")).alias("error"))
    folder = ledger.scratch(spark)
    ledger.follow(told, f"{folder}/changes", f"{folder}/checkpoint", stale_s=STALE_S)
    return ledger.ledger(spark, f"{folder}/changes").select("job_id", "status", "started_ms", "finished_ms", "done", "error")


PAGES = """o AS (SELECT o_orderpriority || ' ' || year(o_orderdate) AS collection, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority || ' ' || year(o_orderdate) ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority || ' ' || year(o_orderdate)) AS total FROM orders),
p AS (SELECT collection, (r - 1) // 20 + 1 AS page, count(*) AS n, any_value(total) AS total, min(o_orderkey) % 13 = 0 AS broken FROM o GROUP BY 1, 2),
s AS (SELECT collection, min(page) FILTER (broken OR n < 20) AS stop, min(page) FILTER (broken) AS bad, max(page) AS last, any_value(total) AS total FROM p GROUP BY 1),
e AS (SELECT *, bad IS NOT DISTINCT FROM stop AND stop IS NOT NULL AS failed FROM s)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority and year as a collection of pages of 20; some pages broke off, and after the last comes a 400."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws(" ", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("collection"), "o_orderkey")
    placed = ranked(o, [F.col("o_orderkey")], groups=["collection"], name="r").withColumn("page", F.expr("cast((r - 1) div 20 + 1 as int)"))
    pages = placed.groupBy("collection", "page").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"))))).alias("body"), F.min("o_orderkey").alias("least"))
    totals = o.groupBy("collection").agg(F.count("*").alias("total"))
    good = pages.join(totals, "collection").select("collection", "page", F.when(F.col("least") % 13 == 0, 500).otherwise(200).alias("status"), "total", F.when(F.col("least") % 13 != 0, F.col("body")).alias("body"))
    after = good.groupBy("collection").agg((F.max("page") + 1).alias("page")).select("collection", "page", F.lit(400).alias("status"), F.lit(None).cast("long").alias("total"), F.lit('{"code":"rest_post_invalid_page_number"}').alias("body"))
    return good.unionByName(after).withColumn("error", F.lit(None).cast("string"))


@query("walked_collections", f"WITH {PAGES} SELECT collection, CASE WHEN failed THEN stop - 1 WHEN stop IS NULL THEN last ELSE stop END AS pages, CASE WHEN failed THEN (stop - 1) * 20 ELSE total END::BIGINT AS items, total, CASE WHEN failed THEN 'error' WHEN stop IS NULL THEN 'past the end' ELSE 'short page' END AS ended, CASE WHEN failed THEN 'page ' || stop || ' status 500' END AS error FROM e")
def walked_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.walk(stored(spark, sf_dir), per_page=20)[1]


@query("collected_items", f"WITH {PAGES} SELECT o.collection, ((r - 1) // 20 + 1)::INT AS page, ((r - 1) % 20)::INT AS pos, o_orderkey AS id FROM o JOIN e USING (collection) WHERE stop IS NULL OR (r - 1) // 20 + 1 < stop OR ((r - 1) // 20 + 1 = stop AND NOT failed)")
def collected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = paging.walk(stored(spark, sf_dir), per_page=20)
    return items.select("collection", "page", "pos", F.get_json_object("item", "$.id").cast("long").alias("id"))
