"""Documents into overlapping, traceable chunks. The greedy steps look back at what they have cut, so they run per document in Python."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Where a chunk is best cut, in order of preference.
BREAKS = ("\n\n", ". ", "\n", " ")
_BREAKS = [(re.compile(f"(?={re.escape(b)})"), len(b)) for b in BREAKS]


def spans(body: str, max_chars: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk. All places where a break ends are listed once, by kind; a chunk ends at the last one of the best kind
    that stands in its later half, or at its limit, and the next begins `overlap` before that, but goes on by at least max_chars - overlap."""
    tables = [[m.start() + size for m in pattern.finditer(body)] for pattern, size in _BREAKS]
    least = max(1, max_chars - overlap)
    start = 0
    while len(body) - start > max_chars:
        limit = start + max_chars
        ends = [(table[k - 1], size) for table, (_, size) in zip(tables, _BREAKS, strict=True) if (k := bisect_right(table, limit))]
        end = next((at for at, size in ends if at - size - start > max_chars // 2), limit)
        yield start, end
        start += max(least, end - start - overlap)
    if start < len(body):
        yield start, len(body)


def pieces(text: str | None, max_chars: int = 2000, overlap: int = 200) -> list[str]:
    """Chunks of at most max_chars, overlapping by at most half of that; blank ones are left out."""
    body = (text or "").strip()
    cut = (body[a:b].strip() for a, b in spans(body, max_chars, min(max(overlap, 0), max_chars // 2)))
    return [c for c in cut if c]


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_chars: int = 2000, overlap: int = 200, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, chunk_index, content) of every text, and the columns to carry (section, page_number, element_type); null, empty and
    blank texts have no chunks."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t, max_chars, overlap))

    return docs.select(F.col(id_col), F.posexplode(cut(text_col)).alias("chunk_index", "content"), *carry)


def renumbered(chunks: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Chunks of several blocks of a document, numbered from 0 through all of them."""
    return chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy(id_col).orderBy(*order, "chunk_index")) - 1)


def sheet_chunks(cells: DataFrame, *, max_chars: int = 2000) -> DataFrame:
    """Chunks of every sheet of every workbook, from (file_id, sheet_ord, sheet_name, row_ord, cells) with the header in the first row of
    a sheet: each chunk repeats the sheet's name and header, and numbers go on through the sheets of a workbook."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row_ord")
        lines = [" | ".join("" if c is None else str(c) for c in cells) for cells in group["cells"]]
        top = f"Sheet: {group['sheet_name'].iloc[0]}\n{lines[0]}\n"
        found = [top + "\n".join(part) for part in packed(lines[1:], len(top), max_chars)]
        return pd.DataFrame({"file_id": group["file_id"].iloc[0], "sheet_ord": group["sheet_ord"].iloc[0], "section": group["sheet_name"].iloc[0], "element_type": "table", "chunk_index": range(len(found)), "content": found})

    kind = cells.schema["file_id"].dataType.simpleString()
    found = cells.groupBy("file_id", "sheet_ord").applyInPandas(pack, f"file_id {kind}, sheet_ord int, section string, element_type string, chunk_index int, content string")
    return renumbered(found, "file_id", ["sheet_ord"]).drop("sheet_ord")


def packed(lines: list[str], head: int, room: int) -> Iterator[list[str]]:
    """Neighbouring lines in runs that fit behind a head; a line that is too wide alone stays whole."""
    run, size = [], head
    for line in lines:
        if run and size + len(line) + 1 > room:
            yield run
            run, size = [], head
        run.append(line)
        size += len(line) + 1
    if run:
        yield run


def merge_blocks(blocks: DataFrame, *, max_chars: int = 2000, min_chars: int = 40) -> DataFrame:
    """Neighbouring blocks of one section and page joined up to a budget; tables stand alone; what is then still shorter than
    min_chars goes, unless it is a table. From and to (doc_id, block_ord, text, section, page_number, element_type)."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        room = 0
        for row in group.sort_values("block_ord").to_dict("records"):
            if not (row["text"] or "").strip():
                continue
            size, last = len(row["text"]) + 1, out[-1] if out else None
            joins = last is not None and "table" not in (row["element_type"], last["element_type"]) and (last["section"], last["page_number"]) == (row["section"], row["page_number"]) and room + size <= max_chars
            if joins:
                last["text"] += "\n" + row["text"]
                room += size
            else:
                out.append(dict(row))
                room = size
        kept = [r for r in out if r["element_type"] == "table" or len(r["text"].strip()) >= min_chars]
        return pd.DataFrame(kept, columns=group.columns)

    return blocks.groupBy("doc_id").applyInPandas(merge, blocks.schema)


def table_chunks(rows: DataFrame, headers: list[str], *, max_chars: int = 2000) -> DataFrame:
    """Rows (sheet_name, row_ord, cells) packed into chunks that each repeat the sheet and the header; a row that is too wide alone
    stays whole."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        sheet = group["sheet_name"].iloc[0]
        top = f"Sheet: {sheet}\n{' | '.join(headers)}\n"
        lines = [" | ".join("" if c is None else str(c) for c in cells) for cells in group.sort_values("row_ord")["cells"]]
        found = [top + "\n".join(part) for part in packed(lines, len(top), max_chars)]
        return pd.DataFrame({"sheet_name": sheet, "chunk_index": range(len(found)), "content": found})

    return rows.groupBy("sheet_name").applyInPandas(pack, "sheet_name string, chunk_index int, content string")


def heading_paths(items: DataFrame) -> DataFrame:
    """Adds `section`, the path of headings above each item (doc_id, ord, level, text); level is null for body text."""

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, str]] = []
        paths = []
        group = group.sort_values("ord").drop(columns="section", errors="ignore")
        for level, text in zip(group["level"], group["text"], strict=True):
            if pd.notna(level):
                stack = [s for s in stack if s[0] < level] + [(int(level), text)]
            paths.append(" > ".join(t for _, t in stack))
        return group.assign(section=paths)

    return items.groupBy("doc_id").applyInPandas(walk, StructType([*items.drop("section").schema.fields, StructField("section", StringType())]))


def box_lines(boxes: DataFrame, *, min_score: float = 0.5) -> DataFrame:
    """Lines of recognised boxes (page_id, x, top, bottom, text, score): boxes join a line while their centre lies above its bottom."""

    def group_lines(group: pd.DataFrame) -> pd.DataFrame:
        good = group[group["score"] >= min_score].assign(centre=lambda g: (g["top"] + g["bottom"]) / 2).sort_values(["centre", "x"])
        lines: list[list] = []
        bottom = float("-inf")
        for row in good.itertuples():
            if not lines or row.centre > bottom:
                lines.append([])
                bottom = float("-inf")
            lines[-1].append(row)
            bottom = max(bottom, row.bottom)
        text = [" ".join(r.text for r in sorted(line, key=lambda r: r.x)) for line in lines]
        return pd.DataFrame({"page_id": group["page_id"].iloc[0], "line": range(len(text)), "text": text})

    return boxes.groupBy("page_id").applyInPandas(group_lines, "page_id long, line int, text string")


def replace_chunks(old: DataFrame, new: DataFrame, document: str = "doc_id") -> DataFrame:
    """Old chunks of documents that have no new ones, and the new ones: written to a staged folder, this swaps in one step."""
    return old.join(new.select(document).distinct(), document, "left_anti").unionByName(new)

