from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sheaf.functions.numbers import parse_number
from sheaf.operators.aggregate import Filter, Metric, UnknownColumn, accounting, aggregate, scan_flag

GOOD = {"£99": "99", "€1,000": "1000", "-$5": "-5", "$-5": "-5", "(500)": "-500", "($1,200.25)": "-1200.25", "12%": "0.12", "(12%)": "-0.12", "1 234": "1234", "1 234": "1234", "1 234": "1234", "1\u00a0234": "1234", "1\u202f234": "1234", "1e3": "1000", "1,5": "15", " 7 ": "7", ".5": "0.5", "1_000": "1000"}
BAD = ["", "  ", "N/A", "see note 3", "TBC", "-", "1.2.3", "$", "%", "nan", "Infinity", "-inf", None, "("]


def test_parse_number(spark):
    rows = spark.createDataFrame([(k,) for k in [*GOOD, *BAD]], "c string")
    found = {r["c"]: r["n"] for r in rows.select("c", parse_number(F.col("c")).alias("n")).collect()}
    assert {k: found[k] for k in GOOD} == {k: Decimal(v).quantize(Decimal("1e-10")) for k, v in GOOD.items()}
    assert [b for b in BAD if found[b] is not None] == []


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [(1, "NSW", "Fixed", "100"), (2, "NSW", "Variable", "$250.50"), (3, "VIC", "Fixed", "(50)"), (4, "VIC", "Variable", "1,000"), (5, "", " ", "")]
    return spark.createDataFrame(rows, "row_ord long, Region string, Product string, Amount string")


def metrics(*ops):
    return [Metric("amount", op, op) for op in ops]


def test_ungrouped(sheet):
    row = aggregate(sheet, ordinal="row_ord", metrics=metrics("sum", "avg", "min", "max", "count")).first()
    assert (row["group"], row["rows"], row["sum"], row["avg"], row["min"], row["max"], row["count"]) == ("(all)", 4, Decimal("1300.5"), Decimal("325.125"), -50, 1000, 4)


def test_grouped_order_and_first_spelling(spark):
    rows = spark.createDataFrame([(1, " nsw", "5"), (2, "NSW ", "6"), (3, "", "1"), (4, "vic", "x")], "o long, r string, a string")
    found = [(r["group"], r["rows"], r["sum"]) for r in aggregate(rows, ordinal="o", group_by="R", metrics=[Metric("a", "sum", "sum")]).collect()]
    assert found == [("nsw", 2, 11), ("(blank)", 1, 1), ("vic", 1, None)]


def test_no_rows(sheet):
    none = sheet.where("false")
    assert aggregate(none, ordinal="row_ord", metrics=metrics("sum")).first()["sum"] is None
    assert aggregate(none, ordinal="row_ord", group_by="region", metrics=metrics("sum")).count() == 0


def test_blank_and_skipped(spark):
    rows = spark.createDataFrame([(1, "a", "100"), (2, "a", "N/A"), (3, "a", ""), (4, "a", "300"), (5, "a", "N/A"), (6, "a", "??")], "o long, r string, Amount string")
    row = accounting(rows, ordinal="o", columns=["amount", "AMOUNT"]).first()
    assert (row["column"], row["matched"], row["parsed"], row["skipped"], row["blank"], row["examples"]) == ("Amount", 6, 2, 3, 1, ["N/A", "??"])


def test_fifty_of_sixty_groups(spark):
    rows = spark.range(60).select(F.col("id").alias("o"), F.concat(F.lit("g"), "id").alias("g"), F.col("id").cast("string").alias("a"))
    found = aggregate(rows, ordinal="o", group_by="g", metrics=[Metric("a", "sum", "s")]).collect()
    assert (len(found), found[0]["group"], found[0]["total_groups"]) == (50, "g59", 60)


def test_sum_beyond_any_window(spark):
    rows = spark.range(1, 1201).select(F.col("id").alias("o"), F.col("id").cast("string").alias("a"))
    assert aggregate(rows, ordinal="o", metrics=[Metric("a", "sum", "s")]).first()["s"] == 720_600


def test_filters(sheet):
    n = lambda *f: aggregate(sheet, ordinal="row_ord", filters=[Filter(*x) for x in f]).first()["rows"]
    assert n(("amount", "eq", "1000")) == 1 and n(("amount", "gte", "$100")) == 3 and n(("region", "ne", " nsw ")) == 2 and n(("product", "contains", "")) == 4 and n(("amount", "gt", "many")) == 0


def test_errors(sheet):
    with pytest.raises(UnknownColumn, match="Region, Product, Amount"):
        aggregate(sheet, ordinal="row_ord", metrics=[Metric("price", "sum")])
    with pytest.raises(ValueError, match="unknown metric"):
        aggregate(sheet, ordinal="row_ord", metrics=[Metric("amount", "median")])
    with pytest.raises(ValueError, match="unknown filter"):
        aggregate(sheet, ordinal="row_ord", filters=[Filter("amount", "like", "x")])


def test_scan_flag(sheet):
    assert scan_flag(sheet, "row_ord", 4).first()["scan_truncated"] and not scan_flag(sheet, "row_ord", 5).first()["scan_truncated"]
