"""Chunks of recovered pages: pages apart, units named, details by route."""

from __future__ import annotations

import random

from sheaf.operators import recovered

UNITS, PAGES = "doc_id long, page_number int, unit_ord int, text string", "doc_id long, page_number int, route string, reason string, label string, converter string, mapping string, ocr_engine string"


def test_pages_units_and_metadata(spark):
    units = spark.createDataFrame([(1, 1, 1, "alpha beta"), (1, 1, 2, ""), (1, 1, 3, "  gamma delta  "), (1, 2, 4, "epsilon"), (1, 3, 5, " \t"), (1, 4, 6, None), (2, 1, 1, "a | b"), (3, 1, 1, "not indexed")], UNITS)
    pages = spark.createDataFrame([(1, 1, "legacy_conversion", "embedded_font", None, "c2", None, "no"), (1, 2, "ocr", "image", None, "no", "m", "tess"), (1, 3, "native", "x", None, None, None, None), (1, 4, "native", "x", None, None, None, None), (2, 1, "native", "sheet", "Rates", None, None, None)], PAGES)
    out = {(r["doc_id"], r["chunk_index"]): r for r in recovered.chunks(units, pages, max_chars=16, overlap=0, version="v7").collect()}
    shown = {k: (r["page_number"], r["content"], r["units"]) for k, r in out.items()}
    # a chunk that ends early still moves on by max_chars - overlap, so the next one starts within "gamma"
    assert shown == {(1, 0): (1, "alpha beta", [1]), (1, 1): (1, "mma delta", [3]), (1, 2): (2, "epsilon", [4]), (2, 0): (1, "a | b", [1])}
    assert out[1, 0]["metadata"] == {"route": "legacy_conversion", "route_reason": "embedded_font", "extractor_version": "v7", "converter": "c2"}
    assert out[1, 2]["metadata"] == {"route": "ocr", "route_reason": "image", "extractor_version": "v7", "ocr_engine": "tess", "authoritative": "false"}
    assert (out[2, 0]["section"], out[2, 0]["element_type"], out[1, 0]["element_type"]) == ("Rates", "table", "text")


def test_units_of_each_chunk_against_a_plain_search(spark, monkeypatch):
    monkeypatch.setattr(recovered, "STEP", 7)
    rng = random.Random(2)
    rows = [(d, p, u, "".join(rng.choices("ab .\n", k=rng.randrange(0, 30)))) for d in range(4) for p in range(2) for u in range(15)]
    pages = spark.createDataFrame([(d, p, "native", "r", None, None, None, None) for d in range(4) for p in range(2)], PAGES)
    out = recovered.chunks(spark.createDataFrame(rows, UNITS), pages, max_chars=40, overlap=10).collect()
    for d in range(4):
        own = [r for r in out if r["doc_id"] == d]
        assert sorted(r["chunk_index"] for r in own) == list(range(len(own)))
        for p in range(2):
            places, text = {}, ""
            for _, _, u, t in sorted(r for r in rows if r[:2] == (d, p)):
                places[u] = (len(text), len(text) + len(t))
                text += t + "\n"
            for r in (r for r in own if r["page_number"] == p):
                starts = [i for i in range(len(text)) if text.startswith(r["content"], i)]
                fits = [[u for u, (a, b) in places.items() if b > a and a < i + len(r["content"]) and b > i] for i in starts]
                assert r["units"] in fits


def test_no_pages_no_chunks(spark):
    units = spark.createDataFrame([(1, 1, 1, "text")], UNITS)
    assert recovered.chunks(units, spark.createDataFrame([], PAGES)).count() == 0
    assert recovered.chunks(units.where("false"), spark.createDataFrame([(1, 1, "native", "r", None, None, None, None)], PAGES)).count() == 0
