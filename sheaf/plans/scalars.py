"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import dates, numbers, text, urls
from sheaf.functions.calculator import compile_expression
from sheaf.plans.registry import query, table


@query("text_normalize", "SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS norm, CASE WHEN length(p_name || p_type || p_name) > 30 THEN (p_name || p_type || p_name)[1:30] || '…' ELSE p_name || p_type || p_name END AS clipped FROM part")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", numbers.normal(F.concat(F.lit("  "), "p_name", F.lit("\t "))).alias("norm"), text.clip(F.concat("p_name", "p_type", "p_name"), 30).alias("clipped"))


@query("text_preview", r"""WITH s AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '^ $', '') AS s FROM documents)
SELECT doc_id, s[1:300] AS preview, CASE WHEN length(s) <= 80 THEN s ELSE rtrim(s[1:79]) || '…' END AS title FROM s""")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"), text.title(F.col("text")).alias("title"))


@query("text_slug", """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') AS s, sha256(html) AS sha FROM pages) SELECT page_id, CASE WHEN coalesce(s, '') = '' THEN 'misc' ELSE s END AS slug, sha[1:2] || '/' || sha || '.html' AS storage_key FROM s""")
def text_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.storage_key(F.sha2("html", 256), F.lit("html")).alias("storage_key"))


CITED = "text || ' [' || (turn + 1) || '] and [2], [' || (conv_id % 12) || '] [1024] [2]'"


@query("citations", rf"SELECT conv_id, turn, array_to_string(list_distinct_ordered, ',') AS cited FROM (SELECT conv_id, turn, list_reduce(list_prepend([]::INT[], list_transform(f, lambda x: [x])), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE list_concat(a, x) END) AS list_distinct_ordered FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all({CITED}, '\[(\d{{1,3}})\]', 1), lambda s: s::INT), lambda x: x >= 1 AND x <= 8) AS f FROM conversations))")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(CITED).alias("t"))
    return marked.select("conv_id", "turn", F.array_join(F.transform(text.cited(F.col("t"), F.lit(8)), lambda x: x.cast("string")), ",").alias("cited"))


@query("number_format", "SELECT o_orderkey, CASE WHEN v = floor(v) THEN format('{:,}', v::BIGINT) ELSE format('{:,.2f}', v) END AS shown FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE floor(o_totalprice) + 0.25 END AS v FROM orders)")
def number_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.floor("o_totalprice") + 0.25)
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.show_number(v).alias("shown"))


@query("calculator", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, floor(-l_quantity / 7.0) AS floored, -l_quantity - 7.0 * floor(-l_quantity / 7.0) AS modulo, round(sqrt(abs(l_extendedprice)) + greatest(l_tax, 0.05) * pi() + pow(l_discount, 2.0) + ln(l_quantity) / ln(2.0), 6) AS mixed FROM lineitem")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax"), "q": F.col("l_quantity")}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(compile_expression("price * (1 - discount) * (1 + tax)", names), 6).alias("charge"), compile_expression("-q // 7", names).alias("floored"), compile_expression("-q % 7", names).alias("modulo"), F.round(compile_expression("sqrt(abs(price)) + max(tax, 0.05) * pi + discount ** 2 + log(q, 2)", names), 6).alias("mixed"))


@query("date_add", "SELECT o_orderkey, o_orderdate::DATE + INTERVAL 13 MONTH + INTERVAL 17 DAY + INTERVAL 5 HOUR AS later, (o_orderdate::DATE - INTERVAL 1 MONTH)::DATE AS month_before FROM orders")
def date_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    zero = F.lit(0)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.add_calendar(day, F.lit(1), F.lit(1), F.lit(2), F.lit(3), F.lit(5)).alias("later"), dates.add_calendar(day, zero, F.lit(-1), zero, zero).cast("date").alias("month_before"))


@query("date_diff", "WITH d AS (SELECT event_id, abs(date_diff('second', ts, TIMESTAMP '2024-01-15 12:30:00')) AS s FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)) SELECT event_id, s // 86400 AS days, s % 86400 AS seconds, (s // 86400)::VARCHAR || ' days, ' || (s % 86400 // 3600)::VARCHAR || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS shown FROM d")
def date_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.date_trunc("second", "ts").cast("timestamp_ntz"), F.lit("2024-01-15 12:30:00").cast("timestamp_ntz")
    days, seconds = dates.difference(a, b)
    return table(spark, sf_dir, "events").select("event_id", days.alias("days"), seconds.alias("seconds"), dates.human(a, b).alias("shown"))


@query("date_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE::TIMESTAMP + (CASE o_orderkey % 4 WHEN 1 THEN INTERVAL 570 MINUTE WHEN 2 THEN INTERVAL 34215 SECOND ELSE INTERVAL 0 SECOND END) END AS parsed FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, n = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    shown = F.when(n == 0, day).when(n == 1, F.concat(day, F.lit(" 09:30"))).when(n == 2, F.concat(day, F.lit("T09:30:15Z"))).otherwise(F.concat(F.lit("on "), day))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_iso(shown).alias("parsed"))


@query("date_local", "SELECT event_id, ts + INTERVAL 345 MINUTE AS local, (ts + INTERVAL 345 MINUTE)::DATE AS local_day, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 345 MINUTE END AS instant FROM events")
def date_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = dates.local_time(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", local.alias("local"), local.cast("date").alias("local_day"), dates.instant(F.when(F.col("event_id") % 2 == 0, F.col("ts")), F.col("ts")).alias("instant"))


@query("date_year_band", "SELECT CASE WHEN y IS NULL THEN 'unknown' WHEN y <= 2018 THEN '<=2018' WHEN y = 2019 THEN '2019' WHEN y <= 2022 THEN '2020-2022' ELSE '2023-2026' END AS band, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 10 > 0 THEN year(o_orderdate) + 22 END AS y FROM orders) GROUP BY 1")
def date_year_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("o_orderkey") % 10 > 0, F.year("o_orderdate") + 22)
    return table(spark, sf_dir, "orders").groupBy(dates.year_band(year).alias("band")).agg(F.count("*").alias("n"))


_TRACK = "'" + "','".join(urls.TRACKING) + "'"
URL_SQL = rf"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#:]*:(\d+)', 1) AS port,
regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages),
n AS (SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT list_contains([{_TRACK}], lower(split_part(p, '=', 1)))) AS ps FROM u)
"""


@query("url_normalize", URL_SQL + "SELECT page_id, scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS normal FROM n")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal"))


@query("url_keys", URL_SQL + "SELECT page_id, scheme || '://' || host || url_decode(replace(path, '+', '%2B')) || CASE WHEN contains(url, '?') THEN '?' || q ELSE '' END AS comparison_key, regexp_replace(scheme || '://' || host || url_decode(replace(path, '+', '%2B')) || CASE WHEN contains(url, '?') THEN '?' || q ELSE '' END, '/+$', '') AS page_key FROM n")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.comparison_key(F.col("url")).alias("comparison_key"), urls.page_key(F.col("url")).alias("page_key"))


ODD = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'ftp://' || url WHEN 2 THEN replace(url, '://', '://me:pw@') WHEN 3 THEN 'http:///nowhere' ELSE url || '.pdf' END"


@query("url_check", f"SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'scheme' WHEN 2 THEN 'user info' WHEN 3 THEN 'no host' END AS refusal, CASE WHEN page_id % 3 = 0 THEN 'image' WHEN page_id % 5 = 4 AND NOT contains(url, '?') AND NOT contains(url, '#') THEN 'pdf' WHEN page_id % 5 = 4 AND regexp_matches(url, '\\.html?/*[?#]') THEN 'web' ELSE 'unknown' END AS kind FROM pages")
def url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(ODD).alias("url"), F.expr("if(page_id % 3 = 0, 'image/png; q=1', null)").alias("mime"))
    pages = pages.withColumn("kind", F.when(F.col("page_id") % 3 == 0, urls.resource_type(F.col("url"), F.col("mime"))).when(F.col("page_id") % 5 == 4, urls.resource_type(F.col("url"), F.col("mime"))).otherwise(F.lit("unknown")))
    return pages.select("page_id", urls.refusal(F.col("url")).alias("refusal"), "kind")


NAMES = "CASE event_type WHEN 'click' THEN 'getUser' || user_id WHEN 'view' THEN 'list_files-' || user_id WHEN 'purchase' THEN 'deleteRow' || user_id WHEN 'signup' THEN 'get-and-update_' || user_id ELSE 'HTMLParser' || user_id END"


@query("tool_name_kinds", f"SELECT event_id, {NAMES} AS name, CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'write' ELSE 'unknown' END AS kind FROM events")
def tool_name_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.operators.access import tool_kind

    return table(spark, sf_dir, "events").select("event_id", F.expr(NAMES).alias("name")).withColumn("kind", tool_kind(F.col("name")))


@query("clamp_and_ticks", "SELECT p_partkey, least(greatest(coalesce(TRY_CAST(CASE WHEN p_size % 7 = 0 THEN 'many' ELSE p_size::VARCHAR END AS INT), 5), 1), 20) AS top_k, round(CASE WHEN s <= 1 THEN 1.0 WHEN s <= 2 THEN 2.0 WHEN s <= 5 THEN 5.0 ELSE 10.0 END * p, 9) AS step FROM (SELECT *, raw / p AS s FROM (SELECT *, pow(10.0, floor(log10(raw))) AS p FROM (SELECT *, p_retailprice / 5 AS raw FROM part)))")
def clamp_and_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("p_size") % 7 == 0, "many").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.clamp(asked, 5, 1, 20).alias("top_k"), F.round(numbers.nice_step(F.col("p_retailprice")), 9).alias("step"))


@query("json_props", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, round(sum(CAST(value AS DECIMAL(18,4)))::DOUBLE, 4) AS total FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select(k.alias("k"), "value").where("k % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("total"))
