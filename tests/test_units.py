from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf.operators import catalog, units


@pytest.mark.parametrize(
    ("text", "state", "kind"),
    [
        ("", "unjudged", "empty"), ("नेपाल राष्ट्र बैंक", "trusted", "unicode_devanagari"), ("two words", "unjudged", "too_short"), ("12 34 56 78 total", "unjudged", "numeric_table_like"), ("१ | | - -- 5", "trusted", "unicode_devanagari"),
        ("the bank has issued a notice", "trusted", "english_like"), ("FIU-Nepal and AML/CFT and F/Y rules apply", "trusted", "english_like"), ("ljQLo k|fKt q_fie( g]kfn xfd|f]", "legacy", "legacy_shape"),
    ],
)
def test_units(spark, text, state, kind):
    row = spark.createDataFrame([(text,)], "t string").select(units.assess(F.col("t")).alias("a")).first()["a"]
    assert (row["state"], row["kind"]) == (state, kind)


def test_profile_and_region(spark):
    lines = ["the bank has issued a notice"] * 60 + ["ljQLo k|fKt q_fie( g]kfn xfd|f]"] * 5 + [""] + ["ljQLo k|fKt q_fie( g]kfn xfd|f]"] * 6
    p = units.profile(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, unit_ord int, text string"))
    row = p.select("*", units.region().alias("region"), units.by_share().alias("share")).first()
    assert (row["legacy"], row["longest_run"], row["trusted"], row["region"], row["share"]) == (11, 11, 60, True, False)


@pytest.mark.parametrize(("text", "n"), [("नेपाल", 0), ("ानेपाल", 1), ("कााा", 2), ("्", 1), ("अ्", 1), ("क़", 0), ("राष्ट्र", 0), ("२ा", 1)])
def test_illegal_clusters(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(units.illegal_clusters(F.col("t"))).first()[0] == n


def test_conversion(spark):
    rows = spark.createDataFrame([("g]kfn /fi6« a}+s", "नेपाल राष्ट्र बैंक", 6, 10), ("abcdef", "x", 0, 1), ("abcdef", "abcdef", 9, 9), ("abcdef", "नेपाल", 1, 100)], "s string, c string, k int, w int")
    out = rows.select(units.conversion_verdict(F.col("s"), F.col("c"), F.col("k"), F.col("w")).alias("v")).collect()
    assert [r["v"] for r in out] == [None, "length", "no_script", "vocabulary"]


def test_routes_and_plans(spark):
    route = lambda *a: tuple(spark.range(1).select(units.route(*[F.lit(x) for x in a]).alias("r")).first()["r"])
    assert route(False, "legacy_font_suspected", 10, True, True, True) == ("native", "provenance_unavailable")
    assert route(True, "legacy_font_suspected", 10, False, True, True) == ("legacy_conversion", "legacy_font_referenced")
    assert route(True, "no_text_layer", 0, False, False, True) == ("ocr", "no_text_layer")
    plan = lambda *a: tuple(spark.range(1).select(units.plan(*[F.lit(x) for x in a]).alias("r")).first()["r"])
    assert plan("image", "needs_ocr", "image_file", 0.0) == ("none", "image_ocr_not_enabled")
    assert plan("text", "suspicious", "legacy_font_suspected", 0.1) == ("native", "below_conversion_gate")
    assert plan("text", "suspicious", "legacy_font_suspected", 0.2) == ("convert", "legacy_font_suspected")


def test_chains_and_sections(spark):
    rows = spark.createDataFrame([(1, 0, "root"), (2, 1, "tenders"), (3, 2, "old"), (4, 5, "a"), (5, 4, "b")], "id int, up int, name string")
    out = {r["id"]: (r["chain"], r["section"]) for r in catalog.sections(catalog.chains(rows, "id", "up", "name"), {"tenders/old": "Archive", "tenders": "Tenders"}).collect()}
    assert out[3] == (["old", "tenders", "root"], "Archive") and out[2][1] == "Tenders" and out[4] == (["a", "b"], None)


def test_cache_and_tally(spark):
    wanted = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 1)], "k string, u int")
    cache = spark.createDataFrame([("x", 1, "v2"), ("x", 2, "v1"), ("z", 1, "v2")], "k string, u int, version string")
    assert {r["k"]: (r["state"], r["stale"]) for r in catalog.resolve_cache(wanted, cache, "k", "u", "v2").collect()} == {"x": ("partial", 1), "y": ("cold", 1), "z": ("warm", 0)}
    assert [tuple(r) for r in catalog.tally(wanted, "k", ["x", "q"]).collect()] == [("x", 2), ("q", 0)]


def test_deep_chains_and_cycles(spark):
    rows = spark.createDataFrame([(i, i - 1, f"n{i}") for i in range(40)] + [(100, 101, "a"), (101, 102, "b"), (102, 100, "c"), (103, 100, "d"), (200, 200, "self"), (300, 999, "orphan")], "id long, up long, name string")
    out = {r["id"]: r["chain"] for r in catalog.chains(rows, "id", "up", "name").collect()}
    assert out[39] == [f"n{i}" for i in range(39, -1, -1)] and out[0] == ["n0"]
    assert (out[100], out[102], out[103], out[200], out[300]) == (["a", "b", "c"], ["c", "a", "b"], ["d", "a", "b", "c"], ["self"], ["orphan"])
    assert catalog.chains(rows.where("false"), "id", "up", "name").count() == 0


def test_documents_are_assessed_once(spark):
    """The assessment stands once in the plan of a profile, and one shuffle serves counts and runs; runs of a document without an id count too."""
    lines = ["ljQLo k|fKt q_fie( g]kfn xfd|f]"] * 2 + ["the bank has issued a notice"] + ["ljQLo k|fKt q_fie( g]kfn xfd|f]"] * 3 + [""] + ["ljQLo k|fKt q_fie( g]kfn xfd|f]"]
    given = spark.createDataFrame([(d, i, t) for d in (7, None) for i, t in enumerate(lines)], "doc_id long, unit_ord int, text string")
    found = units.profile(given)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("too_short") == 1
    assert [(r["units"], r["legacy"], r["longest_run"]) for r in found.collect()] == [(8, 6, 4)] * 2


@pytest.mark.parametrize(("text", "symbols", "switches"), [("AML/CFT and a/b x", 0.25, 0.0), ("FIU-Nepal bcd-fgh iPhone one", 0.25, 0.25), ("(word), plain. Text! x", 0.0, 0.0), ("12-34 ab-cd 中a中 é|é", 0.0, 0.0)])
def test_shares_of_odd_tokens(spark, text, symbols, switches):
    row = spark.createDataFrame([(text,)], "t string").select(units.assess(F.col("t")).alias("a")).first()["a"]
    assert (row["symbol_ratio"], row["case_switch_ratio"]) == (symbols, switches)
