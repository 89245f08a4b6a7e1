"""Tables and documents in files: delimited text with a sniffed separator, workbooks, plain text and JSON."""

from __future__ import annotations

import csv
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from sheaf.functions.text import split_lines
from sheaf.operators.ranks import ranked

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sniff_separator(head: str) -> str:
    """Comma, semicolon, tab or bar, by the start of a file; a comma where that doesn't tell."""
    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file as text columns, its separator found in the first 8 KB (read by Spark, so any store will do)."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 8192).alias("h")).first()["h"]
    separator = sniff_separator(bytes(head).decode("utf-8-sig", "replace"))
    return spark.read.csv(path, header=True, inferSchema=False, sep=separator, multiLine=True, quote='"', escape='"', enforceSchema=False)


def with_ordinal(df: DataFrame, order: list[str], name: str = "row_ord") -> DataFrame:
    """Adds a row number from 1 by columns that order the rows totally, over range partitions; row order is never taken from partitions as they come."""
    return ranked(df, [F.col("`" + c.replace("`", "``") + "`") for c in order], name=name).withColumn(name, F.col(name).cast("int"))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by header, case and outer blanks aside, in the order asked; unknown ones are passed over, missing cells are empty."""
    at = {c.strip().lower(): c for c in df.columns}
    found = [at[c.strip().lower()] for c in columns if c.strip().lower() in at]
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in found])


def inspect(df: DataFrame, sample: int = 10) -> DataFrame:
    """One row: the header, the number of rows and columns, and the first rows."""
    head = df.limit(sample).agg(F.collect_list(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])).alias("sample"))
    return df.agg(F.count("*").alias("rows")).crossJoin(head).select(F.array(*map(F.lit, df.columns)).alias("headers"), "rows", F.lit(len(df.columns)).alias("columns"), "sample")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files; bytes that aren't UTF-8 are replaced."""
    whole = spark.read.format("binaryFile").load(path).select("path", F.expr("cast(content as string)").alias("t"))
    clean = F.regexp_replace(F.expr("validate_utf8(make_valid_utf8(t))"), "^﻿", "")
    return whole.select("path", F.posexplode(split_lines(clean)).alias("line", "text"))


def read_json_document(df: DataFrame, column: str) -> DataFrame:
    """Adds kind and shown: a readable document is written out evenly, another stays as it is."""
    parsed = F.try_parse_json(F.col(column))
    return df.withColumn("kind", F.when(parsed.isNull(), "JSON (unparsed)").otherwise("JSON")).withColumn("shown", F.coalesce(F.to_json(parsed), F.col(column)))


def resolve_sheet(names: list[str], wanted: str | int | None) -> str:
    """A sheet by name (case aside) or number from 1; the first by default."""
    if wanted is None or wanted == "":
        return names[0]
    if str(wanted).isdigit() and 1 <= int(wanted) <= len(names):
        return names[int(wanted) - 1]
    for name in names:
        if name.strip().lower() == str(wanted).strip().lower():
            return name
    raise ValueError(f"no sheet {wanted!r}; sheets: {', '.join(names)}")


def sheet_names(content: bytes) -> list[tuple[str, str, bool]]:
    """(name, member, hidden) of a workbook's sheets."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ET.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets")
        return [(s.get("name"), "xl/" + targets[s.get(f"{_REL}id")].removeprefix("/xl/"), s.get("state", "visible") != "visible") for s in sheets]


def sheet_rows(content: bytes, member: str) -> Iterator[list[str]]:
    """Rows of cached values as text; formulas are never evaluated; gaps are empty cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        with z.open(member) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_NS}c"):
                    letters = re.match("[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [""] * (at - len(cells))
                    v, kind = c.find(f"{_NS}v"), c.get("t")
                    if kind == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_NS}t")))
                    elif v is None or v.text is None:
                        cells.append("")
                    else:
                        cells.append(shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[v.text] if kind == "b" else v.text)
                yield cells
                row.clear()


class WorkbookSource(DataSource):
    """spark.read.format("workbook").option("path", ...).option("sheet", ...): (row_ord, cells) of one sheet, for files on a shared mount."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "row_ord int, cells array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)

        class Reader(DataSourceReader):
            def read(self, partition):
                with open(options["path"], "rb") as f:
                    content = f.read()
                names = sheet_names(content)
                wanted = resolve_sheet([n for n, _, _ in names], options.get("sheet"))
                rows = list(sheet_rows(content, next(m for n, m, _ in names if n == wanted)))
                while rows and not any(c.strip() for c in rows[-1]):
                    rows.pop()
                for i, cells in enumerate(rows):
                    yield i, cells

        return Reader()


def workbook_tables(files: DataFrame) -> DataFrame:
    """(path, sheet, hidden, row_ord, cells) of all sheets of workbooks given as (path, content); one task per file, rows streamed."""

    def read(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for name, member, hidden in sheet_names(bytes(content)):
                    rows = [(path, name, hidden, i, cells) for i, cells in enumerate(sheet_rows(bytes(content), member))]
                    yield pd.DataFrame(rows, columns=["path", "sheet", "hidden", "row_ord", "cells"])

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, hidden boolean, row_ord int, cells array<string>")
