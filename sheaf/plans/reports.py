"""Queries over catalog reports, paging, budgets and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf import tools
from sheaf.operators import reports, routes
from sheaf.plans.registry import query, table

KEYS = [1, 7, 7, 32, 2, 1, 33, 64, 5, 99_999_999]
RULES = [("^/(news|blog)(/|$)", "news", "listing"), (r"\.(pdf|docx?|xlsx?)$", "files", "file"), ("^/(docs?|help)(/|$)", "docs", "article"), ("^/$", "home", "home")]


@query("key_list", f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN ({', '.join(map(str, KEYS))})")
def key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.in_keys(table(spark, sf_dir, "orders"), "o_orderkey", KEYS).select("o_orderkey", "o_totalprice")


@query("next_turns", "SELECT c_custkey, coalesce((SELECT max(l_linenumber) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey), 0) + 1 AS next_number FROM customer")
def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "l_linenumber")
    return reports.next_numbers(table(spark, sf_dir, "customer"), lines, "c_custkey", "l_linenumber")


@query("newest_orders", "SELECT o_custkey, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders) WHERE place <= 3")
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", 3).select("o_custkey", "o_orderkey", "place")


@query("range_refusals", """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN '2023-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS a, strftime(o_orderdate + (o_orderkey % 50 - 5)::INT * INTERVAL 1 DAY, '%Y-%m-%d') AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' END AS c, o_orderkey % 50 - 4 AS days FROM orders)
SELECT o_orderkey, CASE WHEN a = '' THEN 'missing' WHEN length(a) = 8 THEN 'format' WHEN a = '2023-02-30' THEN 'calendar' WHEN days < 1 THEN 'order' WHEN days > 31 THEN 'length' WHEN c IS NULL AND days > 3 THEN 'length_all' END AS refusal FROM r""")
def range_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    shown = F.date_format("o_orderdate", "yyyy-MM-dd")
    first = F.when(key % 7 == 0, "").when(key % 7 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(key % 7 == 2, "2023-02-30").otherwise(shown)
    last = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (key % 50 - 5).cast("int")), "yyyy-MM-dd")
    return orders.select("o_orderkey", reports.range_refusal(first, last, F.when(key % 2 == 0, "USD")).alias("refusal"))


@query("embedded_texts", "SELECT item_id, 'Instruct: Given a search query, retrieve relevant passages that answer the query' || chr(10) || 'Query: ' || text AS as_query, text AS as_document FROM benchmark")
def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", reports.instructed(F.col("text"), "query").alias("as_query"), reports.instructed(F.col("text"), "document").alias("as_document"))


@query("sizes_shown", "SELECT o_orderkey, format('{:,.1f} MB', round(o_totalprice * 1000 / 1048576, 1)) AS shown FROM orders")
def sizes_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.mebibytes(F.round(F.col("o_totalprice").cast("double") * 1000 / 1048576, 1) * 1048576).alias("shown"))


@query("names_stripped", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_name || ' - Other' ELSE nullif(c_name, '') END AS title, c_name AS font FROM customer")
def names_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    title = F.when(key % 3 == 0, F.concat("c_name", F.lit(" - Site"))).when(key % 3 == 1, F.concat("c_name", F.lit(" - Other"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", reports.without_site(title, F.when(key % 3 < 2, "Site")).alias("title"), reports.without_subset(F.concat(F.lit("/ABCDEF+"), "c_name")).alias("font"))


@query("json_merged", "SELECT o_orderkey, 'a=1;' || CASE WHEN o_orderkey % 2 = 0 THEN 'b=9;c=' || o_orderstatus ELSE 'b=2' END AS pairs, o_orderkey % 2 = 0 AS has_c FROM orders")
def json_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.lit("9").alias("b"), F.col("o_orderstatus").alias("c"))))
    entries = F.array_sort(F.map_entries(reports.merged_json(F.lit('{"a":"1","b":"2"}'), patch)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("pairs"), reports.has_key(patch, "c").alias("has_c"))


@query("passages_in_budget", """WITH p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, trim(text, ' ') AS body, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT *, greatest(1, least(n, 3000 // 240)) AS kept FROM p), s AS (SELECT *, greatest(200, 3000 // kept - 40) AS share FROM k)
SELECT source, place, CASE WHEN length(body) > share THEN rtrim(left(body, (share - 2)::INT), ' ') || ' …' ELSE body END AS passage, length(body) > share AS trimmed FROM s WHERE place <= kept""")
def passages_in_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "documents").select("source", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("place"), "text")
    return reports.budgeted(ranked, query="source", place="place", text="text", budget=3000, fixed=40)


@query("line_pages", """WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS line, text FROM conversations), p AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY line) AS upto FROM l WHERE line BETWEEN 1 AND 5), e AS (SELECT conv_id, max(line) AS ending FROM l GROUP BY 1),
s AS (SELECT * FROM p WHERE upto <= 600 OR line = 1)
SELECT conv_id, min(line) AS first, max(line) AS last, count(*) AS lines, least(max(upto), 600)::BIGINT AS chars, max(CASE WHEN line = 1 AND length(text) + 1 > 600 THEN length(text) END) AS hard_cut, CASE WHEN max(line) < min(ending) THEN max(line) + 1 END AS resume FROM s JOIN e USING (conv_id) GROUP BY 1""")
def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("line"), "text")
    return reports.line_page(lines, doc="conv_id", ordinal="line", text="text", most=5, budget=600)


@query("work_ranks", "SELECT c_custkey, r.rank FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS rank FROM orders GROUP BY 1) r ON r.o_custkey = c_custkey")
def work_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return reports.work_order(table(spark, sf_dir, "customer").select("c_custkey"), manifest, "c_custkey", "o_orderkey")


@query("unfetched_keys", "SELECT count(*) AS wanted, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS missing FROM customer")
def unfetched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unfetched(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("version_counts", "SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS extracted, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'X') AS \"X\", count(*) FILTER (o_orderpriority <> '1-URGENT') AS stale FROM orders")
def version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.version_counts(table(spark, sf_dir, "orders"), version="o_orderpriority", status="o_orderstatus", current="1-URGENT", statuses=["F", "X"])


@query("pass_counters", "SELECT count(*) AS selected, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'Z') AS missing, sum(l_linenumber)::BIGINT AS pages FROM lineitem")
def pass_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pass_counters(table(spark, sf_dir, "lineitem"), {"selected": F.lit(1), "failed": F.col("l_returnflag") == "R", "missing": F.col("l_returnflag") == "Z", "pages": F.col("l_linenumber")})


@query("run_ledger", "SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'error') AS error, 0::BIGINT AS retried, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type NOT IN ('view', 'error'))), ',') AS unknown FROM events GROUP BY 1")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day as what a run counted."""
    counted = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("counter")).agg(F.count("*").alias("n"))
    return reports.run_ledger(counted, ["view", "error", "retried"]).withColumn("unknown", F.array_join("unknown", ","))


@query("cohort_accounts", "SELECT count(*) AS files, count(DISTINCT text) AS blobs, count(DISTINCT text) FILTER (lang = 'en') AS blobs_ready, count(*) - count(DISTINCT text) AS collapsed FROM documents")
def cohort_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cohort_accounts(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("blob"), "lang"), blob="blob", ready=F.col("lang") == "en")


@query("discovered_keys", "SELECT coalesce(c_custkey, o_custkey) AS k, CASE WHEN c_custkey IS NULL THEN 'map' WHEN o_custkey IS NULL THEN 'api' ELSE 'api+map' END AS seen_in, false AS complete FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def discovered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    api, by_map = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return reports.discovered({"api": api, "map": by_map}, "k", {"api": True, "map": False})


@query("file_titles", "SELECT p_partkey, t.title FROM part LEFT JOIN (SELECT l_partkey, arg_min(s_name, (l_linenumber::BIGINT * 1000000000 + l_suppkey)) AS title FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) t ON t.l_partkey = p_partkey")
def file_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_linenumber")
    return reports.titles(table(spark, sf_dir, "part"), links, table(spark, sf_dir, "supplier"), file="p_partkey", source="s_suppkey", ordinal="l_linenumber", title="s_name")


@query("upload_refusals", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'type' WHEN l_quantity > 40 THEN 'too_large' WHEN l_discount = 0 THEN 'expands_too_large' END AS refusal FROM lineitem")
def upload_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    refusal = reports.upload_refusal(F.col("l_returnflag"), F.col("l_quantity"), F.when(F.col("l_discount") == 0, 999).otherwise(1), allowed=["r", "a"], most=40, most_expanded=100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", refusal.alias("refusal"))


@query("download_refusals", "SELECT page_id, CASE WHEN length(html) > 4000 THEN 'too_large' WHEN page_id % 5 = 0 THEN 'truncated' WHEN page_id % 2 = 0 AND regexp_matches(lower(html), '^\\s*(<!doctype html|<html)') THEN 'soft_404' END AS refusal FROM pages")
def download_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.sources import web

    size, n = F.length("html"), F.col("page_id")
    refusal = reports.download_refusal(F.when(n % 5 == 0, size + 1).otherwise(size), size, web.sniff(F.encode("html", "UTF-8")), F.when(n % 2 == 0, "pdf").otherwise("web"), most=4000)
    return table(spark, sf_dir, "pages").select("page_id", refusal.alias("refusal"))


@query("cache_kept", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("version"))
    current = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit("R").alias("version"))
    return reports.kept_cache(cache, current, "l_orderkey", "version").select("l_orderkey", "l_linenumber")


@query("conversion_rates", "SELECT l_shipmode, count(*) FILTER (l_returnflag IN ('R', 'A')) AS attempted, count(*) FILTER (l_returnflag = 'A') AS accepted, round(count(*) FILTER (l_returnflag = 'A')::DOUBLE / count(*) FILTER (l_returnflag IN ('R', 'A')), 4) AS acceptance_rate FROM (SELECT *, l_linestatus AS l_shipmode FROM (SELECT l_returnflag, l_linestatus FROM lineitem)) GROUP BY 1")
def conversion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conversion_summary(table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("l_shipmode"), "l_returnflag"), "l_shipmode", "l_returnflag", accepted=["A"], attempted=["R", "A"])


@query("latest_jobs", "SELECT c_custkey, j.s AS latest_status, coalesce(j.n, 0) AS jobs FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, (epoch(o_orderdate::TIMESTAMP)::BIGINT::HUGEINT * 1000000000 + o_orderkey)) AS s, count(*) AS n FROM orders GROUP BY 1) j ON o_custkey = c_custkey")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return reports.latest_jobs(table(spark, sf_dir, "customer"), jobs, document="c_custkey", at="o_orderdate", job="o_orderkey", status="o_orderstatus")


@query("turn_sources", "SELECT l_orderkey, list(l_partkey ORDER BY seen, l_partkey) AS sources FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def turn_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.turn_sources(table(spark, sf_dir, "lineitem"), turn=["l_orderkey"], document="l_partkey", ordinal="l_linenumber")


_PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '')"
_FIRST = lambda place: "CASE " + " ".join(f"WHEN regexp_matches({_PATH}, '{r[0]}') THEN '{r[place] if place else 'path matches ' + r[0]}'" for r in RULES) + f" ELSE '{('no rule', 'other', 'page')[place]}' END"


@query("classified_urls", f"SELECT page_id, {_FIRST(1)} AS section, {_FIRST(2)} AS kind, {_FIRST(0)} AS evidence FROM pages")
def classified_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", reports.classified(F.col("url"), RULES).alias("c")).select("page_id", "c.*")


@query("attached_files", "SELECT l_orderkey, u AS url, (min(p) - 1)::INT AS place, arg_min(o, p) AS origin FROM (SELECT l_orderkey, unnest(a) AS u, generate_subscripts(a, 1) AS p, CASE WHEN generate_subscripts(a, 1) <= n THEN 'field' ELSE 'body' END AS o FROM (SELECT l_orderkey, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_suppkey::VARCHAR) || list((l_suppkey % 5)::VARCHAR ORDER BY l_linenumber, (l_suppkey % 5)::VARCHAR) AS a, count(*) AS n FROM lineitem GROUP BY 1)) GROUP BY 1, 2")
def attached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", c.cast("string").alias("v")))), lambda x: x["v"])
    records = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered(F.col("l_suppkey")).alias("typed"), ordered(F.col("l_suppkey") % 5).alias("linked"))
    return reports.attachments(records, key="l_orderkey", typed="typed", linked="linked")


@query("recovered_pages", "SELECT l_orderkey, l_returnflag, coalesce(string_agg(l_partkey::VARCHAR, chr(10) ORDER BY l_linenumber, l_partkey::VARCHAR) FILTER (l_discount > 0.02), '') AS text, count(*) AS units, count(*) FILTER (l_discount <= 0.02) AS withheld, count(*) FILTER (l_discount <= 0.02) = 0 AS indexable FROM lineitem GROUP BY 1, 2")
def recovered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", F.col("l_partkey").cast("string").alias("t"), (F.col("l_discount") > 0.02).alias("ok"))
    return reports.recovered_pages(units, document="l_orderkey", page="l_returnflag", ordinal="l_linenumber", text="t", resolved="ok")


@query("tool_aggregate", "SELECT l_returnflag AS \"group\", format('{:,}', count(*)) AS rows, format('{:,}', sum(l_linenumber)::BIGINT) AS sum_l_linenumber, format('{:,}', max(l_partkey)::BIGINT) AS max_l_partkey, (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_linenumber > 2) AS total_groups FROM lineitem WHERE l_linenumber > 2 GROUP BY 1")
def tool_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_returnflag", "l_linenumber", "l_partkey"]
    cells = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("string") for c in columns], (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_ord"))
    request = {"metrics": [{"column": "l_linenumber", "op": "SUM"}, {"column": "l_partkey", "op": "max"}], "filters": [{"column": "L_LINENUMBER", "op": "gt", "value": 2}], "group_by": "l_returnflag"}
    return tools.call("aggregate", cells, request)


ROUTED = """s AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages),
rules AS (SELECT lang AS prefix, 1 AS least, 'site ' || lang AS section, 'front' AS kind, NULL AS deeper_kind, NULL::INT AS owner_at FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT lang || '/*', 2, NULL, 'post', 'reply', 1 FROM (SELECT DISTINCT lang FROM documents) WHERE lang IN ('en', 'fr')
  UNION ALL SELECT 'en/' || n_nationkey || n_regionkey, 2, 'nation ' || n_name, 'nation', NULL, NULL FROM nation UNION ALL SELECT '', 0, 'root', 'landing', 'below', NULL)"""


@query("routed_urls", f"""WITH {ROUTED}, k AS (SELECT page_id, p, n, v, CASE WHEN n = 0 THEN '' WHEN v = 0 THEN array_to_string(p[1:n], '/') ELSE array_to_string(p[1:n - 1] || ['*'], '/') END AS prefix FROM s, (SELECT unnest(range(0, 12)) AS n), (SELECT unnest([0, 2]) AS v) WHERE n <= len(p) AND (n > 0 OR v = 0)),
m AS (SELECT page_id, n, v, r.prefix, section, CASE WHEN len(p) > n AND deeper_kind IS NOT NULL THEN deeper_kind ELSE kind END AS kind, CASE WHEN owner_at IS NOT NULL THEN p[owner_at] END AS code FROM k JOIN rules r ON r.prefix = k.prefix AND len(p) >= least),
b AS (SELECT * FROM m WHERE code IS NULL OR code = 'en' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, v, prefix) = 1)
SELECT s.page_id, section, kind, code AS owner, CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.html?/*$') THEN 'web' ELSE 'unknown' END AS resource_type, 'prefix ' || prefix AS evidence FROM s LEFT JOIN b USING (page_id)""")
def routed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made of the languages and nations; `en` alone is an owner, so posts of others fall back to their site."""
    langs, nation = table(spark, sf_dir, "documents").select("lang").distinct(), table(spark, sf_dir, "nation")
    null = lambda kind: F.lit(None).cast(kind)
    rules = langs.select(F.col("lang").alias("prefix"), F.lit(1).alias("least"), F.concat(F.lit("site "), "lang").alias("section"), F.lit("front").alias("kind"), null("string").alias("deeper_kind"), null("int").alias("owner_at"))
    posts = langs.where("lang in ('en', 'fr')").select(F.concat("lang", F.lit("/*")), F.lit(2), null("string"), F.lit("post"), F.lit("reply"), F.lit(1))
    nations = nation.select(F.concat(F.lit("en/"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")), F.lit(2), F.concat(F.lit("nation "), "n_name"), F.lit("nation"), null("string"), null("int"))
    root = spark.range(1).select(F.lit(""), F.lit(0), F.lit("root"), F.lit("landing"), F.lit("below"), null("int"))
    return routes.classify(table(spark, sf_dir, "pages"), rules.union(posts).union(nations).union(root), langs.where("lang = 'en'").select(F.col("lang").alias("code")), key="page_id", url="url")
