"""Walks over stored pages, and the source that plans them."""

from __future__ import annotations

import json

import pytest

from sheaf.sources import paging


def told(spark, rows):
    return spark.createDataFrame(rows, paging.RESPONSES)


def page(n, first=0):
    return json.dumps([{"id": first + i} for i in range(n)])


def outcomes(df):
    return {r["collection"]: (r["pages"], r["items"], r["total"], r["ended"], r["error"]) for r in df.collect()}


def test_ends_of_walks(spark):
    rows = [
        ("short", 1, 200, 3, page(2), None), ("short", 2, 200, None, page(1), None), ("short", 3, 200, None, page(2), None),
        ("end", 1, 200, 2, page(2), None), ("end", 2, 400, None, "{}", None), ("early", 1, 200, 9, page(2), None), ("early", 2, 400, None, "{}", None),
        ("object", 1, 200, None, "{}", None), ("broken", 1, 200, None, "[1, ", None), ("empty", 1, 200, 2, page(2), None), ("empty", 2, 200, None, "[]", None),
        ("hole", 1, 200, None, page(2), None), ("hole", 3, 200, None, page(2), None), ("stored", 1, 200, None, page(2), None), ("null", 1, None, None, None, "OSError: x"), ("late", 2, 200, None, page(2), None),
    ]
    items, ended = paging.walk(told(spark, rows), per_page=2)
    assert outcomes(ended) == {
        "short": (2, 3, 3, "short page", None), "end": (1, 2, 2, "past the end", None), "early": (1, 2, 9, "error", "page 2 status 400"), "object": (0, 0, None, "malformed", "page 1 malformed"), "broken": (0, 0, None, "malformed", "page 1 malformed"),
        "empty": (2, 2, 2, "empty", None), "hole": (1, 2, None, "missing page", "page 3 missing page"), "stored": (1, 2, None, "last stored page", None), "null": (0, 0, None, "error", "page 1 OSError: x"), "late": (0, 0, None, "missing page", "page 2 missing page"),
    }
    assert items.where("collection = 'short'").count() == 3 and items.where("collection in ('object', 'late')").count() == 0


def test_limits_and_repeated_pages(spark):
    rows = [("a", p, 200, None, page(2, 2 * p), None) for p in (1, 2, 2, 3, 4)]
    items, ended = paging.walk(told(spark, rows), per_page=2, max_items=5)
    assert outcomes(ended)["a"] == (3, 5, None, "enough items", None) and sorted(r["item"] for r in items.collect()) == [f'{{"id":{i}}}' for i in range(2, 7)]
    assert outcomes(paging.walk(told(spark, rows), per_page=2, max_pages=2)[1])["a"][:4] == (2, 4, None, "too many pages")
    assert paging.walk(told(spark, rows).where("false"))[1].count() == 0


def test_source_plans_pages_and_pushes_filters(spark, tmp_path):
    folder = tmp_path / "posts"
    folder.mkdir()
    for n, size in ((1, 2), (2, 2), (3, 1)):
        (folder / f"{n}.json").write_text(json.dumps({"status": 200, "headers": {"X-WP-Total": "7"} if n == 1 else {}, "body": json.loads(page(size))}))
    (folder / "3.json").write_text("no json")
    spark.dataSource.register(paging.CollectionSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = lambda: spark.read.format("collection").option("path", str(folder / "{page}.json")).option("per_page", "2").load()
    assert read().rdd.getNumPartitions() == 4  # ceil(7 / 2)
    found = {r["page"]: r for r in read().collect()}
    assert [found[n]["status"] for n in (1, 2, 3, 4)] == [200, 200, 0, 0] and "ValueError" in found[3]["error"] or "JSONDecodeError" in found[3]["error"]
    assert read().where("page > 1 and page <= 3").rdd.getNumPartitions() == 2
    assert outcomes(paging.walk(read(), per_page=2)[1])["posts"][:4] == (2, 4, 7, "error")
    reader = paging.CollectionReader({"path": str(folder / "{page}.json"), "per_page": "2"})
    left = list(reader.pushFilters([paging.GreaterThan(("page",), 1), paging.LessThanOrEqual(("page",), 3), paging.EqualTo(("status",), 200)]))
    assert [p.number for p in reader.partitions()] == [2, 3] and left == [paging.EqualTo(("status",), 200)]
    with pytest.raises(ValueError):
        paging.CollectionReader({"path": "x"})
