"""Nested documents into flat records."""

from __future__ import annotations

import json

from sheaf.operators import records
from sheaf.operators.records import Rule


def test_types_count_as_they_stand(spark):
    rules = [Rule("n", "$.a.n", "long"), Rule("x", "$.x", "double"), Rule("s", "$.s", "string"), Rule("b", "$.b", "boolean"), Rule("l", "$.l", "array")]
    docs = [{"a": {"n": 5}, "x": 1, "s": "t", "b": False, "l": [1, "2"]}, {"a": {"n": "5"}, "x": "1", "s": 3, "b": 1, "l": {}}, {"a": {"n": 5.5}, "x": 2.5, "s": None}, {"a": 7}]
    df = spark.createDataFrame([(i, json.dumps(d), "kept") for i, d in enumerate(docs)] + [(10, "{broken", "kept"), (11, None, "kept"), (12, "[1]", "kept"), (13, '{"a": {"n": null}}', "kept")], "i int, json string, `a.b` string")
    out = {r["i"]: r for r in records.flatten(df, "json", rules).collect()}
    assert (out[0]["n"], out[0]["x"], out[0]["s"], out[0]["b"], [v.toPython() for v in out[0]["l"]], out[0]["evidence"], out[0]["a.b"]) == (5, 1.0, "t", False, [1, "2"], [], "kept")
    assert [out[1][c] for c in "nxsbl"] == [None] * 5
    assert out[1]["evidence"] == ['n: expected long, found STRING: "5"', 'x: expected double, found STRING: "1"', "s: expected string, found BIGINT: 3", "b: expected boolean, found BIGINT: 1", "l: expected array, found OBJECT: {}"]
    assert (out[2]["x"], out[2]["n"], out[2]["s"], out[2]["evidence"]) == (2.5, None, None, ["n: expected long, found DECIMAL: 5.5"])
    assert out[3]["evidence"] == [] and not out[3]["malformed"]
    assert [out[i]["malformed"] for i in (10, 11, 12, 13)] == [True, True, True, False] and out[13]["evidence"] == []


def test_posts(spark):
    full = {"id": 4, "type": "news", "link": "https://Example.com:443/a?utm_source=x#f", "title": {"rendered": " A &amp; B\n&#8211; &nope; "}, "categories": [3, "4", 5, None, 1.5], "acf": {"year": "2082", "no": 7, "rate": 1.5, "blank": " ", "photos": "p", "flag": True, "deep": {"a": 1}, "document_redirect_to_file": False}}
    df = spark.createDataFrame([(1, json.dumps(full)), (2, "{}"), (3, json.dumps({"title": "plain", "link": ""})), (4, "nonsense")], "i int, json string")
    out = {r["i"]: r for r in records.posts(df, "json").collect()}
    assert (out[1]["title"], out[1]["url"], out[1]["category_ids"], out[1]["redirects_to_file"], out[1]["warnings"]) == ("A & B – &nope;", "https://example.com/a", [3, 5], False, [])
    assert out[1]["extras"] == {"year": "2082", "no": "7", "rate": "1.5"}
    assert (out[2]["warnings"], out[2]["category_ids"], out[2]["extras"]) == (["post has no link"], [], {})
    assert out[3]["warnings"] == ["post has no link"] and out[3]["title"] is None and out[4]["malformed"]


def test_paths_and_types(spark):
    docs = ['{"a": 1, "o": {"k": "x", "p": {"q": {"r": 1}}}}', '{"a": "s", "o": 5}', '{"a": 2}', "[1, 2]", "no json", None, "{}"]
    df = spark.createDataFrame([(d,) for d in docs], "json string")
    assert {(r["path"], r["kind"]): r["n"] for r in records.paths(df, "json").collect()} == {("$.a", "BIGINT"): 2, ("$.a", "STRING"): 1, ("$.o", "OBJECT"): 1, ("$.o", "BIGINT"): 1, ("$.o.k", "STRING"): 1, ("$.o.p", "OBJECT"): 1, ("$.o.p.q", "OBJECT"): 1}
    assert {r["path"]: (r["type"], r["n"], r["others"]) for r in records.column_types(df, "json", 1).collect()} == {"$.a": ("BIGINT", 2, 1), "$.o": ("BIGINT", 1, 1)}
