"""Reports, refusals and budgets on small inputs stated in full."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf import tools
from sheaf.operators import chunking, reports, sampling
from sheaf.plans import registry


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(("first", "last", "currency", "why"), [("2024-01-01", "2024-01-31", "USD", None), ("2024-01-01", "2024-02-01", "USD", "length"), ("2024-01-01", "2024-01-04", None, "length_all"), ("2024-01-02", "2024-01-01", "USD", "order"), ("20240101", "2024-01-02", "USD", "format"), ("2024-02-30", "2024-03-01", "USD", "calendar"), (" ", "2024-01-02", "USD", "missing")])
def test_range_refusal(spark, first, last, currency, why):
    assert one(spark, reports.range_refusal(F.lit(first), F.lit(last), F.lit(currency))) == why


def test_texts(spark):
    assert one(spark, reports.without_site(F.lit("Report - the Site"), F.lit("the Site"))) == "Report"
    assert one(spark, reports.without_site(F.lit(" - the Site"), F.lit("the Site"))) is None
    assert one(spark, reports.without_subset(F.lit("/ABCDEF+Arial"))) == "Arial"
    assert one(spark, reports.mebibytes(F.lit(1_572_864_000))) == "1,500.0 MB"
    with pytest.raises(ValueError, match="mode"):
        reports.instructed(F.lit("x"), "other")


def test_orthography(spark):
    row = one(spark, reports.orthography(F.lit("राष्ट्र बैंक ऐन " * 12)))
    assert row["letters"] == 12 * 13 and row["halant_per_letter"] == pytest.approx(24 / 156, abs=1e-4) and one(spark, reports.orthography(F.lit("ऐन"))) is None


def test_budget_drops_and_cuts(spark):
    rows = spark.createDataFrame([("q", i, "x" * 500) for i in range(1, 6)], "q string, place int, t string")
    out = reports.budgeted(rows, query="q", place="place", text="t", budget=700, fixed=0).orderBy("place").collect()
    assert [len(r["passage"]) for r in out] == [233, 233, 233] and all(r["trimmed"] and r["passage"].endswith(" …") for r in out)
    assert [r["passage"] for r in reports.budgeted(rows, query="q", place="place", text="t", budget=10).collect()] == ["x" * 198 + " …"]


def test_line_page_resumes_and_cuts(spark):
    lines = spark.createDataFrame([(1, i, "y" * 9) for i in range(1, 21)] + [(2, 1, "z" * 300)], "d int, n int, t string")
    out = {r["d"]: r for r in reports.line_page(lines, doc="d", ordinal="n", text="t", budget=100).collect()}
    assert (out[1]["last"], out[1]["resume"], out[1]["hard_cut"]) == (10, 11, None) and (out[2]["last"], out[2]["resume"], out[2]["hard_cut"]) == (1, None, 300)
    assert reports.line_page(lines.where("d = 1"), doc="d", ordinal="n", text="t", start=11, budget=100).first()["resume"] is None


def test_lists_and_ledgers_refuse(spark):
    with pytest.raises(ValueError, match="at most 2"):
        reports.in_keys(spark.range(3), "id", [1, 2, 3], cap=2)
    with pytest.raises(ValueError, match="unknown counters: b"):
        reports.ledger(1, {"b": 1}, ["a"], spark.createDataFrame([], "run_id long, a long"))


def test_sheet_chunks(spark):
    rows = [("f", 0, "one", i, [f"r{i}", "v"]) for i in range(20)] + [("f", 1, "two", i, ["h" if i == 0 else "w" * 90, None]) for i in range(3)]
    out = chunking.sheet_chunks(spark.createDataFrame(rows, "file_id string, sheet_ord int, sheet_name string, row_ord int, cells array<string>"), max_chars=80).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in out] == list(range(len(out))) and out[0]["content"].startswith("Sheet: one\nr0 | v\nr1 | v\n")
    assert [r["content"] for r in out[-2:]] == ["Sheet: two\nh | \n" + "w" * 90 + " | "] * 2 and {r["element_type"] for r in out} == {"table"}


def test_fill_is_by_slots():
    limits = {("a",): 5, ("b",): 1, ("c",): 3}
    order = [("c",), ("a",), ("b",)]
    for budget in range(12):
        slots = sorted((j, order.index(s), s) for s, n in limits.items() for j in range(n))[:budget]
        assert sampling.fill(limits, budget, order) == {s: sum(x[2] == s for x in slots) for s in limits}


def test_sample_bound_holds_few_rows(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("c"))
    whole = sampling.draw(rows, ["c"], "k", 10, namespace="v1", seed="seed")
    assert {r["k"] for r in sampling.stratified(rows, ["c"], "k", 20, floor=10).collect()} == {r["k"] for r in whole.collect()}


def test_chunks_cover_every_text(spark, sf):
    """Chunk counts and sizes of every document against a plain search for breaks."""

    def plain(text, most, overlap):
        out, at, text = [], 0, (text or "").strip()
        while at < len(text):
            end = min(len(text), at + most)
            if len(text) - at > most:
                for b in ("\n\n", ". ", "\n", " "):
                    found = [p for p in range(at, at + most - len(b) + 1) if text.startswith(b, p) and p - at > most // 2]
                    if found:
                        end = found[-1] + len(b)
                        break
            out.append(text[at:end].strip())
            at = len(text) if end == len(text) and len(text) - at <= most else at + max(end - at - overlap, most - overlap, 1)
        return [c for c in out if c]

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {}
    for r in chunking.chunk(docs, max_chars=1000, overlap=100).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r["doc_id"], []).append(r["content"])
    assert found == {r["doc_id"]: c for r in docs.collect() if (c := plain(r["text"], 1000, 100))}


def test_spread_leaves_large_tables(spark):
    wide = spark.range(100).repartition(9)
    assert registry.spread(wide).rdd.getNumPartitions() == 9 and registry.spread(spark.range(5).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_tools_refuse_and_run(spark):
    cells = spark.createDataFrame([(1, "a", "1,234.5"), (2, "a", "n/a"), (3, "b", "")], "row_ord int, k string, v string")
    out = {r["group"]: (r["rows"], r["sum_v"]) for r in tools.call("aggregate", cells, {"metrics": [{"column": "V", "op": "sum"}], "group_by": "k"}).withColumnRenamed("sum_V", "sum_v").collect()}
    assert out == {"a": ("2", "1,234.50"), "b": ("1", "—")}
    for name, arguments, why in [("nothing", {}, "no tool"), ("rows", {}, "needs 'columns'"), ("aggregate", {"metrics": "x"}, "a list"), ("aggregate", {"metrics": [{"op": "sum"}]}, "a column"), ("aggregate", {"filters": [{"column": "k", "op": "like"}]}, "unknown op")]:
        with pytest.raises(tools.BadArgument, match=why):
            tools.call(name, cells, arguments)
    assert tools.call("calculate", spark.createDataFrame([(7.0,)], "x double"), {"expression": "x // 2"}).first()["result"] == 3
    assert tools.call("rows", cells, {"columns": ["K", "nope"], "start": 2, "rows": 1}).collect()[0]["k"] == "a"
