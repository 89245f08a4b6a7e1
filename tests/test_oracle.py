"""Every query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from sheaf.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else f"{float(v):.7g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(shown, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def compare(spark, duck, sf, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, sf, name):
    compare(spark, duck, sf, catalog.QUERIES[name], catalog.SQL[name])


def test_full_join_keeps_every_document_and_label(spark, sf):
    docs, labels = ({r["doc_id"] for r in spark.read.parquet(f"{sf}/{t}.parquet").select("doc_id").collect()} for t in ("documents", "labels"))
    rows = catalog.QUERIES["join_full_outer_whole"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == docs | labels
    assert {r["doc_id"] for r in rows if r["n_chars"] is not None} == docs and {r["doc_id"] for r in rows if r["quality"] is not None} == labels


@pytest.mark.parametrize("name", ["dirty_cells", "dirty_accounting", "distribution", "reconcile", "stratified_sample", "hybrid_search"])
def test_result_does_not_depend_on_partitions(spark, sf, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, catalog.QUERIES[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_give_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
