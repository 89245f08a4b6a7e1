"""Queries over untidy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.numbers import PARSE_NUMBER_SQL, parse_number
from sheaf.operators.aggregate import Filter, Metric, accounting, aggregate, filter_skips, scan_flag
from sheaf.plans.registry import query, table

#: An untidy rendering of an amount, by the order's number; valid in both dialects.
DIRTY = """CASE o_orderkey % 12 WHEN 0 THEN '$' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(40)) WHEN 1 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(40)) || ')'
WHEN 2 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(40)) || '%' WHEN 3 THEN '' WHEN 4 THEN 'N/A' WHEN 5 THEN '  ' || CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(40)) || ' ' WHEN 6 THEN '-$1,234.50' WHEN 7 THEN 'see note 3'
ELSE CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR(40)) END"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority")).alias("Priority"), F.expr(DIRTY).alias("Amount"), F.col("o_orderstatus").alias("Status"))


DIRTY_SQL = f"""WITH dirty AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE ' ' || o_orderpriority END AS priority, {DIRTY} AS amount, o_orderstatus AS status FROM orders),
parsed AS (SELECT *, {PARSE_NUMBER_SQL.format(c="amount")} AS n FROM dirty)"""


def lineitem_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("Flag"), F.col("l_quantity").cast("decimal(12,2)").cast("string").alias("Quantity"), F.col("l_extendedprice").cast("decimal(14,2)").cast("string").alias("Price"))


@query(
    "dirty_aggregate",
    """SELECT "group", rows, round(CAST(sum_price AS DOUBLE), 2) AS sum_price, round(CAST(avg_price AS DOUBLE), 4) AS avg_price, CAST(min_q AS DOUBLE) AS min_q, CAST(max_q AS DOUBLE) AS max_q, n_price FROM (
SELECT l_returnflag AS "group", count(*) AS rows, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS sum_price, sum(CAST(l_extendedprice AS DECIMAL(14,2))) / count(*) AS avg_price, min(CAST(l_quantity AS DECIMAL(12,2))) AS min_q, max(CAST(l_quantity AS DECIMAL(12,2))) AS max_q, count(*) AS n_price
FROM lineitem WHERE CAST(l_quantity AS DECIMAL(12,2)) > 10 GROUP BY 1)""",
)
def dirty_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(lineitem_text(spark, sf_dir), ordinal="ord", group_by="flag", filters=[Filter("quantity", "gt", "10")], metrics=[Metric("price", "sum", "sum_price"), Metric("Price", "avg", "avg_price"), Metric("quantity", "min", "min_q"), Metric("quantity", "max", "max_q"), Metric("price", "count", "n_price")])
    return out.select("group", "rows", F.round(F.col("sum_price").cast("double"), 2).alias("sum_price"), F.round(F.col("avg_price").cast("double"), 4).alias("avg_price"), F.col("min_q").cast("double").alias("min_q"), F.col("max_q").cast("double").alias("max_q"), "n_price")


@query(
    "dirty_cells",
    f"""{DIRTY_SQL} SELECT min_by(trim(priority), ord) AS "group", count(*) AS rows, round(CAST(sum(n) AS DOUBLE), 4) AS total, round(CAST(sum(n) AS DOUBLE) / count(n), 3) AS mean, CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS most, count(*) FILTER (trim(amount) <> '') AS present, 5::BIGINT AS total_groups
FROM parsed WHERE status <> 'P' GROUP BY lower(trim(priority))""",
)
def dirty_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate(dirty_orders(spark, sf_dir), ordinal="ord", group_by="PRIORITY", filters=[Filter("status", "ne", "p")], metrics=[Metric("amount", "sum", "total"), Metric("amount", "avg", "mean"), Metric("Amount", "min", "least"), Metric("amount", "max", "most"), Metric("amount", "count", "present")])
    return out.select("group", "rows", F.round(F.col("total").cast("double"), 4).alias("total"), F.round(F.col("mean").cast("double"), 3).alias("mean"), F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"), "present", "total_groups")


@query(
    "dirty_accounting",
    f"""{DIRTY_SQL}, bad AS (SELECT amount, min(ord) AS pos FROM (SELECT trim(amount) AS amount, ord FROM parsed WHERE n IS NULL AND trim(amount) <> '') GROUP BY 1)
SELECT 'Amount' AS "column", count(*) AS matched, count(n) AS parsed, count(*) FILTER (n IS NULL AND trim(amount) <> '') AS skipped, count(*) FILTER (trim(amount) = '') AS blank, (SELECT string_agg(amount, '; ' ORDER BY pos) FROM (SELECT * FROM bad ORDER BY pos LIMIT 3)) AS examples FROM parsed""",
)
def dirty_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting(dirty_orders(spark, sf_dir), ordinal="ord", columns=["amount", "AMOUNT"]).withColumn("examples", F.array_join("examples", "; "))


@query(
    "dirty_filter_skips",
    f"""{DIRTY_SQL}, f AS (SELECT *, coalesce(n > 1000, false) AS k0 FROM parsed)
SELECT 0 AS position, 'amount gt 1,000' AS filter, count(*) FILTER (n IS NULL AND trim(amount) <> '') AS skipped, count(*) AS scanned, count(*) FILTER (k0 AND status = 'O' AND coalesce(n < 200000, false)) AS matched FROM f
UNION ALL SELECT 1, 'status eq o', 0, count(*), count(*) FILTER (k0 AND status = 'O' AND coalesce(n < 200000, false)) FROM f
UNION ALL SELECT 2, 'amount lt $200,000', count(*) FILTER (k0 AND status = 'O' AND n IS NULL AND trim(amount) <> ''), count(*), count(*) FILTER (k0 AND status = 'O' AND coalesce(n < 200000, false)) FROM f""",
)
def dirty_filter_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_skips(dirty_orders(spark, sf_dir), ordinal="ord", filters=[Filter("amount", "gt", "1,000"), Filter("status", "eq", "o"), Filter("amount", "lt", "$200,000")])


@query("dirty_ungrouped", f"{DIRTY_SQL} SELECT '(all)' AS \"group\", count(*) AS rows, round(CAST(sum(n) AS DOUBLE), 4) AS total, 1::BIGINT AS total_groups FROM parsed WHERE contains(lower(priority), 'urgent')")
def dirty_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(dirty_orders(spark, sf_dir), ordinal="ord", filters=[Filter("priority", "contains", " URGENT ")], metrics=[Metric("amount", "sum", "total")]).withColumn("total", F.round(F.col("total").cast("double"), 4))


@query("dirty_top_groups", """SELECT CAST(o_custkey AS VARCHAR) AS "group", count(*) AS rows, sum(CAST(o_totalprice AS DECIMAL(12,2)))::DOUBLE AS total, (SELECT count(DISTINCT o_custkey) FROM orders) AS total_groups FROM orders GROUP BY o_custkey ORDER BY 3 DESC, 1 LIMIT 50""")
def dirty_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").cast("string").alias("cust"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"))
    return aggregate(orders, ordinal="ord", group_by="cust", metrics=[Metric("price", "sum", "total")]).withColumn("total", F.col("total").cast("double"))


@query("dirty_scan_flag", "SELECT 1000::BIGINT AS rows_scanned, count(*) > 1000 AS scan_truncated FROM orders")
def dirty_scan_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_flag(dirty_orders(spark, sf_dir), "ord", 1000)


@query("parse_number", f"{DIRTY_SQL} SELECT ord, amount, CAST(n AS DOUBLE) AS n FROM parsed")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_orders(spark, sf_dir).select("ord", F.col("Amount").alias("amount"), parse_number(F.col("Amount")).cast("double").alias("n"))
