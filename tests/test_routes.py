"""Pages by path rules: longest prefix, plain before vague, owners, decoding."""

from __future__ import annotations

from sheaf.operators import routes


def test_rules(spark):
    rules = [
        ("", 0, "other", "landing", "page", None), ("news", 1, "news", "list", "post", None), ("news/archive", 2, "old news", "list", "post", None), ("<year>", 3, None, "dated", "dated", None),
        ("offices/*", 2, None, "office list", "office post", 2), ("offices", 1, "offices", "office page", None, None), ("सूचना", 1, "notices", "list", "post", None), ("*", 4, "deep", "any", None, None),
    ]
    urls = [
        "https://x.org", "https://x.org/", "https://x.org/news/", "https://x.org/news/a", "https://x.org/news/archive/1.pdf?x=1", "https://x.org/2023/05/slug", "https://x.org/2023/05", "https://x.org/offices/bfr", "https://x.org/offices/bfr/a",
        "https://x.org/offices/zzz/a", "https://x.org/%E0%A4%B8%E0%A5%82%E0%A4%9A%E0%A4%A8%E0%A4%BE/a", "https://x.org/a/b/c/d", None,
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = routes.classify(pages, spark.createDataFrame(rules, routes.RULES), spark.createDataFrame([("bfr",), ("bfr",)], "code string"), key="page_id", url="url")
    out = [(r["section"], r["kind"], r["owner"]) for r in sorted(found.collect(), key=lambda r: r["page_id"])]
    assert out == [
        ("other", "landing", None), ("other", "landing", None), ("news", "list", None), ("news", "post", None), ("old news", "post", None), (None, "dated", None), ("other", "page", None), (None, "office list", "bfr"), (None, "office post", "bfr"),
        ("offices", "office page", None), ("notices", "post", None), ("deep", "any", None), ("other", "landing", None),
    ]
    assert {r["page_id"]: r["resource_type"] for r in found.collect()}[4] == "pdf"


def test_without_rules(spark):
    pages = spark.createDataFrame([(1, "https://x.org/a/b")], "page_id int, url string")
    row = routes.classify(pages, spark.createDataFrame([], routes.RULES), spark.createDataFrame([], "code string"), key="page_id", url="url").first()
    assert (row["section"], row["kind"], row["owner"], row["evidence"]) == ("other", "page", None, "no rule for a")
