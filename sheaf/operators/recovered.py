"""Recovered pages into chunks that know their page, the units that they are made of and how far their text can be trusted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators.chunking import spans

#: The names of the routes, and what a chunk of each keeps of its page's details.
LEGACY, OCR = "legacy_conversion", "ocr"
DETAILS = {LEGACY: ["converter", "mapping", "converted_units", "unresolved_units"], OCR: ["ocr_engine", "ocr_model", "ocr_version"]}
#: Characters to a bucket of the range join.
STEP = 1000


def placed(units: DataFrame) -> DataFrame:
    """Units (doc_id, page_number, unit_ord, text) with start and end in their page's text, which joins them by line feeds: prefix sums of lengths
    over one page. A null text is empty."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("unit_ord").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    return units.select("doc_id", "page_number", "unit_ord", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.sum(size + 1).over(w), F.lit(0)).alias("start")).withColumn("end", F.col("start") + F.length("text"))


def page_texts(units: DataFrame) -> DataFrame:
    """(doc_id, page_number, text): the units of each page joined in order."""
    ordered = F.sort_array(F.collect_list(F.struct("unit_ord", F.coalesce("text", F.lit("")).alias("text"))))
    return units.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(ordered, lambda u: u["text"]), "\n").alias("text"))


def cut(text: Column, max_chars: int, overlap: int) -> Column:
    """Array of (start, end, content) of a page's chunks, places counted in the page's own text."""

    @F.pandas_udf("array<struct<start:long,end:long,content:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[dict]:
            lead, body, found = len(t) - len(t.lstrip()), t.strip(), []
            for a, b in spans(body, max_chars, min(max(overlap, 0), max_chars // 2)):
                content = body[a:b].strip()
                start = lead + a + len(body[a:b]) - len(body[a:b].lstrip())
                if content:
                    found.append({"start": start, "end": start + len(content), "content": content})
            return found

        return texts.map(one)

    return run(text)


def metadata(pages: DataFrame, version: str) -> Column:
    """Map of what every chunk of a page keeps: route, reason and extractor, and by route its converter or its recogniser; recognised text is never
    authoritative. Details that are null or that the table doesn't have are left out."""
    entries = [("route", F.col("route")), ("route_reason", F.col("reason")), ("extractor_version", F.lit(version))]
    entries += [(c, F.when(F.col("route") == route, F.col(c).cast("string"))) for route, names in DETAILS.items() for c in names if c in pages.columns]
    entries.append(("authoritative", F.when(F.col("route") == OCR, F.lit("false"))))
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*[v for _, v in entries])), lambda _, v: v.isNotNull())


def chunks(units: DataFrame, pages: DataFrame, *, max_chars: int = 2000, overlap: int = 200, version: str = "native-2") -> DataFrame:
    """(doc_id, chunk_index, page_number, section, element_type, content, units, metadata) of all pages with text.

    `pages` has doc_id, page_number, route, reason, label (a sheet's name, which makes its chunks tables) and any details; a page
    without a row there isn't indexed. A chunk never spans pages; `units` are the unit_ords whose text it shares, found by a range
    join of chunks and units within a page: both are dealt into buckets of STEP characters, so a page of many units and chunks isn't a product of
    them. Numbers go through all pages of a document. Blank pages have no chunks.
    """
    texts = page_texts(units).join(pages, ["doc_id", "page_number"])
    made = texts.select("doc_id", "page_number", F.col("label").alias("section"), F.when(F.col("label").isNotNull(), "table").otherwise("text").alias("element_type"), metadata(pages, version).alias("metadata"), F.posexplode(cut(F.col("text"), max_chars, overlap)).alias("n", "c"))
    made = made.select("doc_id", "page_number", "n", "section", "element_type", "metadata", "c.start", "c.end", "c.content")

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.explode(F.sequence(F.expr(f"start div {STEP}"), F.expr(f"(end - 1) div {STEP}"))))

    left = dealt(made.select("doc_id", "page_number", "n", "start", "end"))
    right = dealt(placed(units).where("end > start").select("doc_id", "page_number", "unit_ord", F.col("start"), F.col("end"))).withColumnsRenamed({"start": "from", "end": "to"})
    met = left.join(right, ["doc_id", "page_number", "bucket"]).where("from < end and to > start")
    named = met.groupBy("doc_id", "page_number", "n").agg(F.sort_array(F.collect_set("unit_ord")).alias("units"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "n")) - 1
    return made.join(named, ["doc_id", "page_number", "n"], "left").select("doc_id", index.alias("chunk_index"), "page_number", "section", "element_type", "content", F.coalesce("units", F.array().cast("array<int>")).alias("units"), "metadata")
