"""Benchmark decontamination: one Aho-Corasick automaton over the words of normalised test questions, offsets mapped to the original.

The automaton's letters are word numbers, and its keys are blocks of seven words, side by side in each item, so it has about one node to a word
of the benchmark: every window of 13 words holds a whole block. An occurrence of a block is extended along its item to both sides,
and what agrees on 13 words or more is made of occurring windows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.bpe import Numbered
from sheaf.llm.common import ORIGINAL_WORD, WORD_TABLE, arrow_limits, built, slices, token, whole_row, with_fields


class Automaton:
    """Of (item, text) pairs: word numbers, the items' words, and blocks with the places where they stand."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width, self.numbers = width, Numbered()
        self.numbers[b""] = 0  # no word; the number of words that no item has
        self.names = [name for name, _ in items]
        self.items = [array("I", map(self.numbers.__getitem__, text.translate(WORD_TABLE).split())) for _, text in items]
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        size = (width + 1) // 2
        for k, words in enumerate(self.items):
            for i in range(0, len(words) - size + 1, size) if len(words) >= width else [0] * (len(words) > 0):
                places.setdefault(tuple(words[i : i + size] if len(words) >= width else words), []).append((k, i))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, found in places.items():
            self.automaton.add_word(block, (len(block), found))
        self.least = min(map(len, places), default=0)
        if places:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of the text, the merged word ranges inside occurrences, the items that occur."""
        words = text.translate(WORD_TABLE).split()
        known = self.numbers.get
        own = tuple([known(w, 0) for w in words])
        if not self.least or len(own) - own.count(0) < self.least:
            return len(words), [], set()
        found, items, ends = [], set(), {}
        for last, (size, places) in self.automaton.iter(own):
            at = last - size + 1
            for k, i in places:
                if ends.get((k, at - i), 0) > at:  # inside a run of the same item that is known
                    continue
                a, b = self.extend(self.items[k], i, own, at, size)
                ends[k, at - i] = b
                if b - a >= min(self.width, len(self.items[k])):
                    found.append((a, b))
                    items.add(self.names[k])
        return len(words), merged(found), items

    @staticmethod
    def extend(item: array, i: int, own: tuple[int, ...], at: int, size: int) -> tuple[int, int]:
        """The longest run of the text around a block at which the item agrees."""
        left, right = 0, size
        while left < i and left < at and item[i - left - 1] == own[at - left - 1]:
            left += 1
        while i + right < len(item) and at + right < len(own) and item[i + right] == own[at + right]:
            right += 1
        return at - left, at + right


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20, carry: bool = False) -> DataFrame:
    """Find benchmark windows of `width` words in every document, in one pass over the documents.

    Returns a row per input row: the id, n_words, n_hit (words inside an occurrence), n_items, items (sorted),
    items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words) and spans (character offsets of the hit runs in
    the original text). There is no shuffle. A benchmark of up to `block_bytes` of text is one automaton (about 25 bytes to a
    byte of text, in each Python worker); a larger one is dealt, by hash, into several of about that size, each
    collected and broadcast by itself, which scan the text one after another.

    A null or empty text has no words and isn't contaminated; a null id stays null; repeated rows give repeated results;
    items with null or wordless text never occur; items that share an id count once; a null item id counts as the id "".
    Empty tables are fine. Other columns are ignored, whatever their names, or come along, as `text` and the struct `row`, if `carry`.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<int>)").alias("ranges"), F.expr("cast(array() as array<string>)").alias("items"), *whole_row(docs.drop(text_col), carry))
    id_type = frame.schema["id"].dataType.simpleString()
    more = frame.schema.fields[5:]
    schema = with_fields(f"id {id_type}, text string, n_words long, ranges array<int>, items array<string>", more)

    size, n = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    blocks = max(1, min(n, -(-(size or 0) // block_bytes)))
    for k in range(blocks):
        block = [(r["item"], bytes(r["text"])) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]  # about block_bytes
        shared, key = spark.sparkContext.broadcast(block), token()
        if k < blocks - 1:
            frame = frame.mapInArrow(_pass(shared, key, width), schema)

    spans = "array<struct<start:int,end:int>>"
    schema = with_fields(f"id {id_type}, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, spans {spans}", [frame.schema["text"], *more] if carry else more)
    return frame.mapInArrow(_last(_pass(shared, key, width), share, carry), schema).withColumnRenamed("id", id_col)


def _pass(block, key: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = built(key, lambda: Automaton(block.value, width))  # type: ignore[assignment]
        for batch, texts in slices(batches):
            counts, ranges, items = [], [], []
            old_ranges, old_items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, text in enumerate(texts):
                n, found, names = automaton.scan(text)
                counts.append(n)
                if found:
                    flat = old_ranges[i]
                    ranges.append([x for r in merged([*zip(flat[::2], flat[1::2], strict=True), *found]) for x in r])
                    items.append(sorted({*old_items[i], *names}))
                else:
                    ranges.append(old_ranges[i])
                    items.append(old_items[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), *batch.columns[5:]], names=batch.schema.names)

    return run


def _last(scan, share: int, carry: bool):
    """The last automaton's pass, and the figures that follow from all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in scan(batches):
            texts, words, ranges, items = (batch.column(i) for i in range(1, 5))
            words, ranges, items = words.to_pylist(), ranges.to_pylist(), items.to_pylist()
            hits = [sum(r[1::2]) - sum(r[::2]) for r in ranges]
            spans = []
            for i, flat in enumerate(ranges):
                if not flat:
                    spans.append([])
                    continue
                at = [(m.start(), m.end()) for m in ORIGINAL_WORD.finditer(texts[i].as_py())]
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(flat[::2], flat[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([h > 0 and share * h >= n for h, n in zip(hits, words, strict=True)], pa.bool_()), pa.array(spans, kind), *[batch.column(1)] * carry, *batch.columns[5:]],
                names=["id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans", *["text"] * carry, *batch.schema.names[5:]],
            )

    return run


#: The operator's figures per document from lists of words, for documents with distinct ids.
DECONTAMINATE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS words FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS words FROM (SELECT d.doc_id, d.w, s.size, unnest(range(1, greatest(0, len(d.w) - s.size + 1) + 1)) AS k FROM d, sizes s)),
found AS (SELECT r.doc_id, r.k, r.size, x.item FROM runs r JOIN windows x ON x.size = r.size AND x.words = r.words),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM (SELECT DISTINCT doc_id, k, size FROM found)) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits h USING (doc_id) LEFT JOIN names n USING (doc_id)
"""
