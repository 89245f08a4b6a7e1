"""Queries over profiles, frequencies and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.numbers import ratio
from sheaf.operators import profile
from sheaf.plans.registry import query, table

AT = "round(list_sort(list(v))[least(floor({f} * count(*)), count(*) - 1)::BIGINT + 1], 4)"
DIST = "count(*) AS n, round(min(v), 4) AS min, " + ", ".join(f"{AT.format(f=f)} AS {n}" for n, f in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + ", round(max(v), 4) AS max, count(*) FILTER (v = 0) AS zero"


@query("distribution", f"SELECT lang, {DIST} FROM (SELECT lang, n_chars::DOUBLE AS v FROM documents) GROUP BY lang")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("speed_summary", "SELECT event_type, count(*) AS n, sum(v) AS total, list_sort(list(v))[least(floor(0.5 * count(*)), count(*) - 1)::BIGINT + 1] AS median, list_sort(list(v))[least(floor(0.95 * count(*)), count(*) - 1)::BIGINT + 1] AS p95 FROM (SELECT event_type, floor(value * 1000)::DOUBLE AS v FROM events) GROUP BY 1")
def speed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 1000).cast("double").alias("v"))
    totals = ms.groupBy("event_type").agg(F.sum("v").alias("total"))
    return profile.distribution(ms, ["event_type"], "v", {"median": 0.5, "p95": 0.95}).join(totals, "event_type").select("event_type", "n", "total", "median", "p95")


BAND_SQL = "CASE WHEN v <= 0 THEN '0' WHEN v < 0.20 THEN '>0-<0.20' WHEN v < 0.50 THEN '0.20-<0.50' WHEN v < 0.80 THEN '0.50-<0.80' ELSE '>=0.80' END"


@query("banded_histogram", f"SELECT b.position, b.band, count(x.v) AS n FROM (VALUES (0, '0'), (1, '>0-<0.20'), (2, '0.20-<0.50'), (3, '0.50-<0.80'), (4, '>=0.80')) b(position, band) LEFT JOIN (SELECT l_discount * 4 AS v, {BAND_SQL.replace('v ', 'l_discount * 4 ')} AS band FROM lineitem) x ON x.band = b.band GROUP BY 1, 2")
def banded_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.banded(table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 4).alias("v")), "v")


@query("frequency_tables", "SELECT 'status' AS metric, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY 2")
def frequency_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequencies(table(spark, sf_dir, "orders"), {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")})


@query("ordered_frequency", "SELECT key, n, row_number() OVER (ORDER BY CASE key WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, n DESC, key)::INT AS position FROM (SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1)")
def ordered_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    return profile.ordered(counts, ["purchase", "signup"])


@query("breakdowns", "WITH x AS (SELECT 'status' AS dimension, o_orderstatus AS label, o_custkey, o_orderstatus FROM orders UNION ALL SELECT 'priority', o_orderpriority, o_custkey, o_orderstatus FROM orders) SELECT dimension, label, count(*) AS files, count(DISTINCT o_custkey) AS blobs, count(*) FILTER (o_orderstatus = 'F') AS done FROM x GROUP BY 1, 2")
def breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_custkey", "o_orderstatus")
    return profile.breakdown(orders, ["status", "priority"], "o_custkey", "o_orderstatus", ready="F")


@query("transitions", "SELECT coalesce(a, 'none') || '->' || coalesce(b, 'none') AS transition, count(*) AS n FROM (SELECT l_linestatus AS a, CASE WHEN l_orderkey % 9 > 0 THEN l_returnflag END AS b FROM lineitem) GROUP BY 1")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("a"), F.when(F.col("l_orderkey") % 9 > 0, F.col("l_returnflag")).alias("b"))
    return profile.transitions(pairs, "a", "b")


@query("filtered_counts", "SELECT count(*) AS files, count(*) FILTER (o_orderstatus = 'F') AS fetched, count(*) FILTER (o_orderstatus = 'P') AS blocked, coalesce(sum(floor(o_totalprice)::BIGINT) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS pending_size, count(DISTINCT o_custkey) AS owners, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS fetched_owners, coalesce(max(o_orderkey), 0) + 1 AS next_seq FROM orders")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    size = F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("files"), F.count_if(done).alias("fetched"), F.count_if(F.col("o_orderstatus") == "P").alias("blocked"), F.coalesce(F.sum(F.when(F.col("o_orderstatus") == "O", size)), F.lit(0)).alias("pending_size"), F.countDistinct("o_custkey").alias("owners"), F.countDistinct(F.when(done, F.col("o_custkey"))).alias("fetched_owners"), (F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_seq"))


@query("distinct_pair_sum", "SELECT coalesce(sum(n), 0)::BIGINT AS bytes, count(*) AS blobs FROM (SELECT DISTINCT sha256(text) AS s, length(text) AS n FROM documents)")
def distinct_pair_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("s"), F.length("text").alias("n")).distinct()
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), F.count("*").alias("blobs"))


@query("duplicate_keys", "SELECT sha256(text) AS content, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n")).where("n > 1")


@query("canonical_merge", "SELECT p_brand, min(p_size) AS year, arg_min(p_type, length(p_type) * 1000000 + p_partkey) AS kind, list_aggregate(list_sort(list(DISTINCT p_type)), 'string_agg', '|') AS owners FROM part GROUP BY 1")
def canonical_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("year"), F.min_by("p_type", F.length("p_type") * 1000000 + F.col("p_partkey")).alias("kind"), F.array_join(F.sort_array(F.collect_set("p_type")), "|").alias("owners"))


@query("true_median", "SELECT source, median(n_chars)::DOUBLE AS median_chars, round(count(*) FILTER (n_chars > 500) / count(*), 4) AS coverage FROM documents GROUP BY 1")
def true_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "n_chars")
    shares = docs.groupBy(F.col("source").alias("s")).agg(ratio(F.count_if(F.col("n_chars") > 500), F.count("*")).alias("coverage"))
    return shares.join(profile.medians(docs, ["source"], "n_chars", "median_chars"), F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), "median_chars", "coverage")


@query("lexicon", "SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS word FROM documents WHERE lang = 'en') WHERE regexp_matches(word, '[aeiou]') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.operators.quality import lexicon as build

    return build(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "text")


@query("agreement", "SELECT count(*) AS n, round(count(*) FILTER (a = b) / count(*), 4) AS status_agreement, round(avg(abs(x - y)), 4) AS mean_delta, CASE WHEN count(*) FILTER (a <> b) > 0 THEN 'differs' ELSE 'same' END AS category FROM (SELECT CASE WHEN n_chars > 800 THEN 'ok' ELSE 'short' END AS a, CASE WHEN length(text) > 900 THEN 'ok' ELSE 'short' END AS b, n_chars::DOUBLE AS x, length(text)::DOUBLE AS y FROM documents)")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") > 800, "ok").otherwise("short").alias("a"), F.when(F.length("text") > 900, "ok").otherwise("short").alias("b"), F.col("n_chars").cast("double").alias("x"), F.length("text").cast("double").alias("y"))
    return d.agg(F.count("*").alias("n"), ratio(F.count_if(F.expr("a = b")), F.count("*")).alias("status_agreement"), F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 4).alias("mean_delta"), F.when(F.count_if(F.expr("a <> b")) > 0, "differs").otherwise("same").alias("category"))


OUTCOMES = "SELECT doc_id AS question, doc_id % 5 > 0 AS answerable, doc_id % 7 = 0 AS abstained, 'd' || (doc_id % 11) AS expected, quality FROM labels"


@query("eval_scores", f"WITH o AS (SELECT *, CASE WHEN NOT abstained THEN list_position(['d1','d4','d2','d9'], expected) END AS pos FROM ({OUTCOMES})) SELECT round(count(*) FILTER (answerable AND pos > 0) / count(*) FILTER (answerable), 6) AS recall_at_k, round(sum(CASE WHEN answerable AND pos > 0 THEN 1.0::DOUBLE / pos ELSE 0 END) / count(*) FILTER (answerable), 6) AS mrr, round(count(*) FILTER (NOT answerable AND abstained) / count(*) FILTER (NOT answerable), 6) AS abstention_recall, round(count(*) FILTER (answerable AND abstained) / count(*) FILTER (answerable), 6) AS false_refusal_rate, count(*) FILTER (answerable) AS answerable, count(*) FILTER (NOT answerable) AS unanswerable FROM o")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select((F.col("doc_id") % 5 > 0).alias("answerable"), (F.col("doc_id") % 7 == 0).alias("abstained"), F.concat(F.lit("d"), (F.col("doc_id") % 11).cast("string")).alias("expected"), F.array(*map(F.lit, ["d1", "d4", "d2", "d9"])).alias("returned"))
    return profile.retrieval_scores(outcomes)


@query("longest_run", "WITH j AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'legacy' WHEN 'purchase' THEN 'trusted' END AS s FROM events), i AS (SELECT *, sum((s = 'trusted')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM j WHERE s IS NOT NULL) SELECT user_id, max(n) AS longest_run FROM (SELECT user_id, g, count(*) FILTER (s = 'legacy') AS n FROM i GROUP BY 1, 2) GROUP BY 1")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "legacy").when(F.col("event_type") == "purchase", "trusted").otherwise("unjudged").alias("s"))
    return profile.longest_runs(states, ["user_id"], "event_id", "s")
