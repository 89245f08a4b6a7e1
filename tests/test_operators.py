from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sheaf.functions import dates, text, urls
from sheaf.functions.calculator import BadExpression, compile_expression
from sheaf.operators import access, chunking, profile, quality, retrieval, sampling, sets, state
from sheaf.sources import files, sinks, web


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("expression", "value"), [("-7 // 2", -4.0), ("-7 % 3", 2.0), ("2 ** 10", 1024.0), ("max(1, 2, sqrt(16)) + pi - pi", 4.0), ("log(8, 2)", 3.0), ("round(2.345, 1)", 2.3)])
def test_calculator(spark, expression, value):
    assert one(spark, compile_expression(expression)) == pytest.approx(value)


@pytest.mark.parametrize("expression", ["1/0", "a.b", "'x'", "2 ** 5000", "__import__('os')", "1 +", "x", "True", "[1]", "1" * 501])
def test_calculator_refuses(expression):
    with pytest.raises(BadExpression):
        compile_expression(expression)


def test_dates(spark):
    day = F.lit("2026-01-31").cast("timestamp_ntz")
    zero = F.lit(0)
    assert str(one(spark, dates.add_calendar(day, zero, F.lit(1), zero, zero))) == "2026-02-28 00:00:00"
    assert one(spark, dates.human(F.lit("2026-01-02 01:00:00").cast("timestamp_ntz"), F.lit("2026-01-01").cast("timestamp_ntz"))) == "1 days, 1:00:00"
    assert one(spark, dates.parse_iso(F.lit("31/01/2026"))) is None


def test_text(spark):
    assert one(spark, text.cited(F.lit("[2] and [1], [9] [2024] [2]"), F.lit(3))) == [2, 1]
    assert one(spark, text.split_lines(F.lit("a\r\nb\x1cc\n"))) == ["a", "b", "c"]
    assert one(spark, text.slug(F.lit("..Ä Report (1).pdf"))) == "report-1-.pdf"
    assert one(spark, text.title(F.lit("x " * 100))).endswith("…")


def test_urls(spark):
    assert one(spark, urls.normalize_url(F.lit("HTTPS://Ex.org:443/A?utm_source=x&b=1#f"))) == "https://ex.org/A?b=1"
    assert one(spark, urls.comparison_key(F.lit("https://u:p@Ex.org:8080/a%20b+c?q=1#f"))) == "https://ex.org/a b+c?q=1"
    assert one(spark, urls.refusal(F.lit("ftp://x"))) == "scheme" and one(spark, urls.refusal(F.lit("https://x/y"))) is None
    assert one(spark, urls.resource_type(F.lit("https://x/y.PDF?z"), F.lit(None).cast("string"))) == "pdf"


def test_access(spark):
    names = ("caller", "admin", "wanted", "held", "own")
    refuse = lambda *a: one(spark, access.refusal(access.MEMBERSHIP, **{k: F.lit(x) for k, x in zip(names, a, strict=True)}))
    assert refuse("viewer", True, "owner", "owner", False) is None
    assert refuse("editor", False, "viewer", None, False) == "Owner access to this department is required"
    assert refuse("owner", False, "owner", None, False) == access.MAKES_OWNER
    assert refuse("owner", False, None, "owner", False) == access.TOUCHES_OWNER
    assert refuse("owner", False, None, "owner", True) is None
    assert refuse(None, None, "viewer", None, None) == access.NEEDS_OWNER
    close = lambda own, admin, n: one(spark, access.refusal(access.DEACTIVATION, own=F.lit(own), admin=F.lit(admin), admins=F.lit(n)))
    assert [close(True, False, 3), close(False, True, 1), close(False, True, 2), close(False, False, 1)] == [access.OWN_ACCOUNT, access.LAST_ADMIN, None, None]
    assert [one(spark, access.standing(F.lit(g), F.lit(a))) for g, a in (("viewer", True), ("editor", False), ("boss", False))] == ["owner", "editor", None]
    assert not one(spark, access.reaches(F.lit("owner"), F.lit("boss"))) and not one(spark, access.reaches(F.lit(None), F.lit("viewer")))


def test_another_users_row_is_as_absent_as_none(spark):
    rows = spark.createDataFrame([(1, 7, "mine"), (2, 8, "other")], "id int, user_id int, text string")
    out = {r["id"]: (r["found"], r["text"]) for r in access.owned(rows, spark.createDataFrame([(1,), (2,), (3,)], "id int"), 7, key="id").collect()}
    assert out == {1: (True, "mine"), 2: (False, None), 3: (False, None)}


def test_chunks():
    body = ("word " * 30 + ". ") * 40
    found = chunking.pieces(body, 300, 50)
    assert all(len(c) <= 300 for c in found) and chunking.pieces("  ") == [] and chunking.pieces(None) == []
    assert "".join(chunking.pieces("x" * 1000, 100, 0)) == "x" * 1000
    assert len(chunking.pieces("x" * 1000, 100, 500)) < 30
    assert found[1][:10] in found[0]


def test_merge_blocks(spark):
    rows = [(1, 0, "a" * 30, "S", 1, "text"), (1, 1, "b" * 30, "S", 1, "text"), (1, 2, "t", "S", 1, "table"), (1, 3, "short", "S", 2, "text"), (1, 4, " ", "S", 2, "text")]
    df = spark.createDataFrame(rows, "doc_id long, block_ord int, text string, section string, page_number int, element_type string")
    assert [r["text"] for r in chunking.merge_blocks(df).orderBy("block_ord").collect()] == ["a" * 30 + "\n" + "b" * 30, "t"]


def test_table_chunks(spark):
    rows = spark.createDataFrame([("s", i, [str(i), "x" * 20]) for i in range(20)] + [("s", 99, ["y" * 500])], "sheet_name string, row_ord int, cells array<string>")
    found = [r["content"] for r in chunking.table_chunks(rows, ["n", "v"], max_chars=120).orderBy("chunk_index").collect()]
    assert all(c.startswith("Sheet: s\nn | v\n") for c in found) and any("y" * 500 in c for c in found)


def test_headings_and_boxes(spark):
    items = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, None, "x"), (1, 3, 1, "C")], "doc_id long, ord int, level int, text string")
    assert [r["section"] for r in chunking.heading_paths(items).orderBy("ord").collect()] == ["A", "A > B", "A > B", "C"]
    boxes = spark.createDataFrame([(1, 50.0, 0.0, 10.0, "world", 0.9), (1, 0.0, 1.0, 11.0, "hello", 0.9), (1, 0.0, 30.0, 40.0, "next", 0.9), (1, 0.0, 0.0, 5.0, "noise", 0.1)], "page_id long, x double, top double, bottom double, text string, score double")
    assert [r["text"] for r in chunking.box_lines(boxes).orderBy("line").collect()] == ["hello world", "next"]


def test_verdicts(spark):
    prose = "the bank of the people was not to be in this for all that is on it by any law such as we have been in from at an end of it " * 4
    glyph = "ljQLo k|fKt q_fie g]kfn /fi6« xfd|f] cGt/f{li6«o sfof{no\n" * 20
    rows = spark.createDataFrame([("prose", prose), ("glyph", glyph), ("empty", ""), ("broken", "�" * 50 + prose)], "k string, text string")
    none = F.lit(None)
    out = quality.classify(quality.text_metrics(rows), family=F.lit("text"), error=none.cast("string"), parsed=F.lit(True), cells=none.cast("int"), coverage=none.cast("double"), page_chars=none.cast("int"))
    assert {r["k"]: (r["status"], r["reason"], r["warnings"]) for r in out.collect()} == {
        "prose": ("extracted", "clean", []), "glyph": ("suspicious", "legacy_font_suspected", []), "empty": ("suspicious", "low_printable_ratio", ["insufficient_text"]), "broken": ("suspicious", "replacement_characters", []),
    }


def test_longest_run(spark):
    states = spark.createDataFrame([(1, i, s) for i, s in enumerate(["legacy", "unjudged", "legacy", "trusted", "legacy"])], "d long, i int, s string")
    assert profile.longest_runs(states, ["d"], "i", "s").first()["longest_run"] == 2


def test_distribution_index(spark):
    row = profile.distribution(spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)], "g int, v double"), ["g"], "v").first()
    assert (row["p25"], row["median"], row["p90"]) == (2, 3, 4)


def test_scores(spark):
    rows = [(True, False, ["a", "b"], "b"), (True, False, ["a"], "z"), (True, True, [], "a"), (False, True, [], None)]
    row = profile.retrieval_scores(spark.createDataFrame(rows, "answerable boolean, abstained boolean, returned array<string>, expected string")).first()
    assert (row["recall_at_k"], row["mrr"], row["abstention_recall"], row["false_refusal_rate"]) == (0.333333, 0.166667, 1.0, 0.333333)
    with pytest.raises(Exception, match="no outcomes"):
        profile.retrieval_scores(spark.createDataFrame([], "answerable boolean, abstained boolean, returned array<string>, expected string")).collect()


def test_decide(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.4), (2, 1, 0.1)], "q int, rrf_rank int, score double")
    out = {(r["q"], r["rrf_rank"]): (r["kept"], r["abstained"]) for r in retrieval.decide(rows, threshold=0.5, top_k=0, by=["q"]).collect()}
    assert out == {(1, 1): (True, False), (1, 2): (False, False), (1, 3): (False, False), (2, 1): (False, True)}


def test_search_scope(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    rows = [(1, 1, "alpha beta", unit(0)), (2, 1, "gamma", unit(1)), (3, 2, "alpha beta", unit(0))]
    chunks = spark.createDataFrame(rows, "chunk_id long, department_id int, content string, embedding array<float>")
    found = {r["id"] for r in retrieval.search(chunks, unit(1), "alpha", department=1).collect()}
    assert found == {1, 2} and retrieval.search(chunks, unit(1), "alpha", department=9).count() == 0


def test_allocation():
    capacity = {("2019", "a"): 9000, ("2019", "b"): 400, ("2021", "a"): 600, ("2025", "c"): 3}
    given = sampling.allocate(capacity, 100, floor=5, share="0.4", namespace="n", seed="s")
    assert given[("2025", "c")] == 3 and given[("2019", "a")] + given[("2019", "b")] <= 40 and given[("2019", "b")] >= 5
    assert sum(given.values()) == 40 + 40 + 3
    assert sampling.allocate({("x",): 3}, 10, floor=1, share="1", namespace="n", seed="s") == {("x",): 3}
    assert sampling.allocate(capacity, 100, floor=5, share="0.4", namespace="n", seed="s") == given


def test_sample_excludes_and_repeats(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("c"))
    first = sampling.stratified(rows, ["c"], "k", 30, share="0.5")
    keys = {r["k"] for r in first.collect()}
    again = {r["k"] for r in sampling.stratified(rows.repartition(7), ["c"], "k", 30, share="0.5").collect()}
    other = {r["k"] for r in sampling.stratified(rows, ["c"], "k", 30, share="0.5", exclude=first).collect()}
    assert keys == again and len(keys) == 30 and not keys & other


def test_second_run_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", False), (4, "d", True)], "k long, v string, is_active boolean")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (5, "e")], "k long, v string")
    actions = sets.reconcile(old, new, "k", ["v"])
    assert {r["k"]: r["action"] for r in actions.collect()} == {1: "touch", 2: "update", 3: "reactivate", 4: "deactivate", 5: "insert"}
    after = sets.apply_actions(old, new, actions, "k")
    assert {r["action"] for r in sets.reconcile(after, new, "k", ["v"]).collect()} == {"touch", "leave"}
    assert {r["action"] for r in sets.reconcile(old, new, "k", ["v"], complete=False).collect()} >= {"retain"}


def test_upsert_preserves(spark):
    old = spark.createDataFrame([(1, "editor", "x")], "k long, role string, v string")
    new = spark.createDataFrame([(1, None, None), (2, "viewer", "y")], "k long, role string, v string")
    assert sorted(map(tuple, sets.upsert(old, new, ["k"], preserve=["role"]).collect())) == [(1, "editor", None), (2, "viewer", "y")]


def test_run_status(spark):
    jobs = spark.createDataFrame([("a", "queued"), ("b", "succeeded"), ("b", "failed"), ("c", "failed"), ("d", "succeeded")], "run string, status string")
    assert {r["run"]: r["run_status"] for r in state.run_status(jobs, "run", F.lit(0)).collect()} == {"a": "awaiting_jobs", "b": "partial", "c": "failed", "d": "succeeded"}
    assert {r["run"]: r["run_status"] for r in state.run_status(jobs, "run", F.lit(1)).collect()}["d"] == "partial"


def test_page(spark):
    html = "<html><head><title>T  x</title><meta property='og:description' content='d'><style>no</style></head><body><p>One <b>two</b></p><script>no</script><div>three</div><a href='#x'>skip</a><a href='/y'> go  on </a><a href='mailto:a@b'>m</a></body>"
    page = web.read_page(html, "https://h/z")
    assert page["text"] == "One two\nthree\nskip go on m" and page["title"] == "T x" and page["description"] == "d"
    assert page["links"] == [{"url": "https://h/y", "href": "/y", "text": "go on"}]
    assert web.read_page(None)["text"] == ""


def test_sitemap(spark):
    maps = spark.createDataFrame([("r", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc>b</loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>u1</loc><lastmod>2024</lastmod></url><url><loc>u2</loc></url></urlset>"), ("b", "<urlset><url><loc>u1</loc></url></urlset>"), ("zz", "<urlset><url><loc>never</loc></url></urlset>")], "url string, xml string")
    assert [r["loc"] for r in web.sitemap(maps, "r").collect()] == ["u1", "u2"]


def test_sitemap_cycles_depth_and_limits(spark):
    index = lambda *to: "<sitemapindex>" + "".join(f"<sitemap><loc> {t} </loc></sitemap>" for t in to) + "</sitemapindex>"
    leaf = lambda *to: "<urlset>" + "".join(f"<url><loc>{t}</loc></url>" for t in to) + "</urlset>"
    maps = spark.createDataFrame([("r", index("a", "b", "r")), ("a", index("c", "r")), ("b", leaf("p1")), ("c", index("d")), ("d", index("e")), ("e", leaf("deep")), ("x", leaf("apart"))], "url string, xml string")
    found = lambda **o: [r["loc"] for r in web.sitemap(maps, "r", **o).collect()]
    assert found() == ["p1"] and found(depth=4) == ["deep", "p1"]
    assert found(depth=4, max_maps=2) == [] and found(depth=4, max_maps=3) == ["p1"] and found(depth=4, max_urls=1) == ["deep"]
    assert found(depth=0) == []


def test_forex(spark):
    day = '{"date":"2024-01-01","rates":[{"currency":{"iso3":"USD","unit":1},"buy":"132.5","sell":"133.1"},{"currency":{"iso3":"XXX","unit":1},"buy":null,"sell":null},{"currency":{"iso3":"YYY","unit":1},"buy":"oops","sell":"1"}]}'
    good, bad = web.forex(spark.createDataFrame([(0, day), (1, day.replace("132.5", "999")), (2, "nonsense")], "ord int, json string"))
    assert [(r["currency"], float(r["buy"])) for r in good.collect()] == [("USD", 132.5)]
    assert {r["currency"]: r["reason"] for r in bad.collect()} == {"XXX": "unquoted", "YYY": "unreadable"}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Name;Amount\nx;1\ny;2\n")
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert [c.strip("﻿") for c in df.columns] == ["Name", "Amount"] and df.count() == 2
    assert files.project(df, ["AMOUNT", "nothing"]).columns == ["Amount"]
    assert files.sniff_separator("a") == ","
    sinks.write_csv(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def workbook() -> bytes:
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Head</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="2"><c r="A2" t="b"><v>1</v></c></row><row r="3"/></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{ns}"><sheetData/></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(workbook())
    spark.dataSource.register(files.WorkbookSource)
    rows = spark.read.format("workbook").option("path", str(tmp_path / "w.xlsx")).option("sheet", "one").load().orderBy("row_ord").collect()
    assert [r["cells"] for r in rows] == [["Head", "", "5"], ["TRUE"]]
    found = files.workbook_tables(spark.read.format("binaryFile").load(str(tmp_path / "w.xlsx")))
    assert found.where("sheet = 'One'").count() == 3
    with pytest.raises(ValueError, match="One, Two"):
        files.resolve_sheet(["One", "Two"], "three")


def test_lines_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo\xff\n")
    assert [r["text"] for r in files.read_lines(spark, str(tmp_path / "a.txt")).orderBy("line").collect()] == ["one", "two�"]
    rows = files.read_json_document(spark.createDataFrame([("{\"a\": 1}",), ("{oops",)], "j string"), "j").collect()
    assert [r["kind"] for r in rows] == ["JSON", "JSON (unparsed)"]


def test_blobs(spark, tmp_path):
    rows = spark.createDataFrame([(b"x", "pdf"), (b"x", "pdf"), (b"y", "")], "content binary, extension string")
    sinks.store_blobs(rows, str(tmp_path / "b"))
    stored = spark.read.parquet(str(tmp_path / "b"))
    assert stored.count() == 2 and sinks.unverified(stored).count() == 0
    assert sinks.selection_digest(rows.select("extension"), "extension") == sinks.selection_digest(rows.repartition(5).select("extension"), "extension")


def test_replace_chunks(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, c string")
    new = spark.createDataFrame([(2, "B"), (2, "C")], "doc_id long, c string")
    once = chunking.replace_chunks(old, new)
    assert sorted(map(tuple, chunking.replace_chunks(once, new).collect())) == [(1, "a"), (2, "B"), (2, "C")]
