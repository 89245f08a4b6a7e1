"""Queries over units, routes and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import numbers
from sheaf.functions.text import split_lines
from sheaf.operators import catalog, records, units
from sheaf.plans.registry import query, spread, table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("unit_ord", "text"))


@query("unit_kinds")
def unit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(units.assess(F.col("text")).alias("a")).groupBy("a.state", "a.kind").agg(F.count("*").alias("n"))


@query("unit_profiles")
def unit_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.profile(lines(spark, sf_dir))


@query("unit_verdicts")
def unit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.plans.documents import text_verdicts

    return units.classify_units(text_verdicts(spark, sf_dir).join(units.profile(lines(spark, sf_dir)), "doc_id", "left")).select("doc_id", "status2", "reason2", "minority")


@query("page_routes", "SELECT decision, why, count(*) AS n FROM (SELECT CASE WHEN l AND e THEN 'legacy_conversion' WHEN l AND m THEN 'ocr' WHEN l THEN 'native' WHEN c >= 50 AND e THEN 'native' WHEN m THEN 'ocr' ELSE 'native' END AS decision, CASE WHEN l AND e THEN 'embedded_font' WHEN l AND m THEN 'no_font_scan_backed' WHEN l AND c = 0 THEN 'empty_page' WHEN l THEN 'no_font_provenance' WHEN c >= 50 AND e THEN 'page_has_text_layer' WHEN m THEN 'no_text_layer' WHEN c >= 50 THEN 'page_has_text_layer' ELSE 'empty_page' END AS why FROM (SELECT doc_id % 2 = 0 AS l, doc_id % 3 = 0 AS e, doc_id % 5 < 2 AS m, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS c FROM documents)) GROUP BY 1, 2")
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    reason = F.when(k % 2 == 0, "legacy_font_suspected").otherwise("no_text_layer")
    chars = F.when(k % 7 == 0, 0).otherwise(F.col("n_chars"))
    routed = table(spark, sf_dir, "documents").select(units.route(F.lit(True), reason, chars, k % 3 == 0, F.lit(False), k % 5 < 2).alias("r"))
    return routed.groupBy("r.decision", "r.why").agg(F.count("*").alias("n"))


@query("document_plans", "SELECT CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'pages' WHEN k = 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'native' ELSE 'convert' END ELSE 'native' END AS decision, count(*) AS n FROM (SELECT doc_id, doc_id % 4 AS k FROM documents) GROUP BY 1")
def document_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    status = F.when(k == 0, "failed").when(k == 1, "needs_ocr").when(k == 2, "suspicious").otherwise("extracted")
    reason = F.when(k == 0, "parser_error").when(k == 1, "no_text_layer").when(k == 2, "legacy_font_suspected").otherwise("clean")
    planned = units.plan(F.when(k == 1, "pdf").otherwise("text"), status, reason, F.when(F.col("doc_id") % 3 == 0, 0.1).otherwise(0.5))
    return table(spark, sf_dir, "documents").groupBy(planned["decision"].alias("decision")).agg(F.count("*").alias("n"))


@query("taxonomy_chains", "WITH RECURSIVE t AS (SELECT n_nationkey AS id, n_nationkey // 3 AS up, n_name AS name FROM nation), c(id, up, chain) AS (SELECT id, CASE WHEN up <> id THEN up END, name FROM t UNION ALL SELECT c.id, CASE WHEN t.up <> t.id THEN t.up END, c.chain || '>' || t.name FROM c JOIN t ON c.up = t.id) SELECT id, arg_max(chain, length(chain)) AS chain FROM c GROUP BY 1")
def taxonomy_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.floor(F.col("n_nationkey") / 3).cast("int").alias("up"), "n_name")
    return catalog.chains(nation, "n_nationkey", "up", "n_name").select("id", F.array_join("chain", ">").alias("chain"))


@query("cache_states", "SELECT o_custkey, count(*) AS units, count(*) FILTER (o_orderkey % 3 <> 0) AS stale, CASE WHEN count(*) FILTER (o_orderkey % 3 = 0) = 0 THEN 'cold' WHEN count(*) FILTER (o_orderkey % 3 <> 0) > 0 THEN 'partial' ELSE 'warm' END AS state FROM orders GROUP BY 1")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    cache = wanted.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "v2").otherwise("v1").alias("version"))
    return catalog.resolve_cache(wanted, cache, "o_custkey", "o_orderkey", "v2")


@query("scope_triage", "SELECT CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'en') THEN 'already_current' WHEN source || '/' || left(lang, 1) IN (SELECT source || '/e' FROM documents WHERE lang = 'en') THEN 'replacement_candidate' ELSE 'new_source' END AS triage, count(*) AS n FROM documents GROUP BY 1")
def scope_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content"), F.concat("source", F.lit("/"), F.substring("lang", 1, 1)).alias("source"), "lang")
    return catalog.triage(docs, docs.where("lang = 'en'"), "content", "source").groupBy("triage").agg(F.count("*").alias("n"))


@query("closed_tally", "SELECT v AS event_type, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund')) x(v) LEFT JOIN events ON event_type = v GROUP BY 1")
def closed_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tally(table(spark, sf_dir, "events"), "event_type", ["click", "error", "purchase", "refund"])


@query("pair_categories", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'both_good' WHEN o_orderstatus = 'F' THEN 'second_worse' WHEN o_orderkey % 2 = 0 THEN 'second_better' ELSE 'same_problem' END AS category, count(*) AS n FROM orders GROUP BY 1")
def pair_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderstatus") == "F", "extracted").when(F.col("o_orderstatus") == "O", "suspicious")
    b = F.when(F.col("o_orderkey") % 2 == 0, "extracted").otherwise("suspicious")
    return table(spark, sf_dir, "orders").groupBy(catalog.pair_category(a, b).alias("category")).agg(F.count("*").alias("n"))


@query("requeue_failed", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1 AND o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type IN ('signup', 'click'))")
def requeue_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ready").alias("status"))
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("o_orderkey"), F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "click", "running").otherwise("done").alias("status"))
    return catalog.requeue(docs, jobs, "o_orderkey", "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey")


@query("batch_order", "SELECT conv_id FROM conversations GROUP BY 1 HAVING count(DISTINCT turn) <> count(*) OR min(turn) <> 0 OR max(turn) <> count(*) - 1")
def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.batch_order_errors(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("short_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def short_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", numbers.shorten_vector(F.col("embedding"), 16).alias("v"))
    return v.select("vec_id", F.round(numbers.dot(F.col("v"), F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 6).alias("first"))


@query("two_level_counts", "SELECT 'type' AS level, event_type AS a, '' AS b, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'type, large', event_type, (value > 50)::VARCHAR, count(*) FROM events GROUP BY 2, 3")
def two_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("a"), (F.col("value") > 50).cast("string").alias("b")).agg(F.count("*").alias("n"))
    coarse = fine.groupBy("a").agg(F.sum("n").alias("n")).select(F.lit("type").alias("level"), "a", F.lit("").alias("b"), "n")
    return coarse.unionByName(fine.select(F.lit("type, large").alias("level"), "a", "b", "n"))


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post's JSON made of each event: ids of errors are strings, views have no link, and the texts of signups break off."""
    e = table(spark, sf_dir, "events")
    number = F.col("event_id").cast("string")
    text = F.concat(
        F.lit('{"id":'), F.when(F.col("event_type") == "error", F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number), F.lit(',"type":"'), F.col("event_type"), F.lit('","title":{"rendered":"  User &amp; &#8211; '), F.col("user_id").cast("string"), F.lit(' "},"slug":'),
        F.when(F.col("user_id") % 2 == 0, F.lit("null")).otherwise(F.col("user_id").cast("string")), F.when(F.col("event_type") != "view", F.concat(F.lit(',"link":"HTTP://Example.com:80/p/'), number, F.lit('#x"'))).otherwise(F.lit("")), F.lit(',"categories":[1,"x",'), F.col("user_id").cast("string"),
        F.lit(',2.5],"acf":{"amount":'), F.col("user_id").cast("string"), F.lit(',"note":" ","photos":"p","flag":true,"document_redirect_to_file":true,"inner":'), F.col("props"), F.lit("}"), F.when(F.col("event_type") == "signup", F.lit("")).otherwise(F.lit("}")),
    )
    return e.select("event_id", text.alias("json"))


GOOD = "(event_type <> 'signup')"


@query("event_records", f"""SELECT event_id, CASE WHEN {GOOD} AND event_type <> 'error' THEN event_id END AS post_id, CASE WHEN {GOOD} THEN event_type END AS post_type, CASE WHEN {GOOD} THEN 'User & ' || chr(8211) || ' ' || user_id END AS title, CASE WHEN {GOOD} AND event_type <> 'view' THEN 'http://example.com/p/' || event_id END AS url,
CASE WHEN {GOOD} THEN '1,' || user_id ELSE '' END AS category_ids, CASE WHEN {GOOD} THEN 'amount=' || user_id ELSE '' END AS extras, CASE WHEN {GOOD} THEN true END AS redirects_to_file, NOT {GOOD} AS malformed,
concat_ws('; ', CASE WHEN NOT {GOOD} OR event_type = 'view' THEN 'post has no link' END, CASE WHEN event_type = 'error' THEN 'post_id: expected long, found STRING: "' || event_id || '"' END, CASE WHEN {GOOD} AND user_id % 2 = 1 THEN 'slug: expected string, found BIGINT: ' || user_id END) AS warnings FROM events""")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = records.posts(event_posts(spark, sf_dir), "json")
    extras = F.array_join(F.transform(F.array_sort(F.map_keys("extras")), lambda k: F.concat(k, F.lit("="), F.col("extras")[k])), ",")
    return p.select("event_id", "post_id", "post_type", "title", "url", F.array_join(F.transform("category_ids", lambda x: x.cast("string")), ",").alias("category_ids"), extras.alias("extras"), "redirects_to_file", "malformed", F.array_join("warnings", "; ").alias("warnings"))


@query("event_types", f"""WITH g AS (SELECT * FROM events WHERE {GOOD}), n AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type <> 'view') AS l, count(*) FILTER (user_id % 2 = 1) AS o FROM g)
SELECT '$.id' AS path, CASE WHEN n - e >= e THEN 'BIGINT' ELSE 'STRING' END AS type, greatest(e, n - e) AS n, least(e, n - e) AS others FROM n UNION ALL SELECT '$.slug', CASE WHEN o >= n - o THEN 'BIGINT' ELSE 'VOID' END, greatest(o, n - o), least(o, n - o) FROM n UNION ALL SELECT '$.link', 'STRING', l, 0 FROM n
UNION ALL SELECT unnest(['$.type', '$.title.rendered', '$.acf.note', '$.acf.photos']), 'STRING', n, 0 FROM n UNION ALL SELECT unnest(['$.title', '$.acf', '$.acf.inner']), 'OBJECT', n, 0 FROM n UNION ALL SELECT unnest(['$.acf.amount', '$.acf.inner.k']), 'BIGINT', n, 0 FROM n UNION ALL SELECT unnest(['$.acf.flag', '$.acf.document_redirect_to_file']), 'BOOLEAN', n, 0 FROM n UNION ALL SELECT '$.categories', 'ARRAY', n, 0 FROM n""")
def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.column_types(event_posts(spark, sf_dir), "json")
