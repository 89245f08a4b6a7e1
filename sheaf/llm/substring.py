"""Substring dedup by words: level-wise doubling of repeated windows, up to the length that is asked for.

Level 1 counts windows of a quarter of the length, sampled without loss: every full window sends the one of the smallest hash
that it holds (the leftmost of equals), its anchor; equal windows have theirs at the same place. Only what occurs again there is extended
to twice the length, to the right of the anchor for full windows that start shortly before it, to the left for the others. What occurs
again at that level is extended to twice its length once more, which is the full window (or a little more than it, then cut to it): consecutive full windows
of one anchor and one side form a segment, whose words are counted as a whole by digests. A segment that occurs again as a whole has repeated
windows only; a segment that stands alone while its half-length window is shared sends its full windows one by one, each counted by
a 128-bit key, beside those of one elected copy of every other segment that shares it. The levels end when no candidate is left or at the full length.

Between levels only hashes are shuffled; bitmaps of bounded size (as in suffix.py) tell the texts what survived. A bitmap that
is too full lets more candidates through to the next level and never changes the result, which rests on counts of 128-bit keys.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sheaf.llm.common import arrow_limits, built, checkpointed, give_back, slices, token, whole_row, with_fields
from sheaf.llm.suffix import LEAST_BITS, MOST_BITS, SlotMaps, _powers, empty_map, slot_maps, votes

#: Texts are split into words in pieces of about this size, and windows are hashed in blocks of this many starts.
PIECE_BYTES, BLOCK = 1 << 20, 1 << 17
_PLACE = np.uint64((1 << 20) - 1)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, a piece of it at a time."""
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, start + PIECE_BYTES) if start + PIECE_BYTES < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[start:end].split()
        start = end


def word_hashes(text: bytes) -> np.ndarray:
    """Two independent 64-bit hashes of each word, as rows."""
    digest = xxhash.xxh3_128_digest
    parts = [np.frombuffer(b"".join(map(digest, words)), np.uint64).reshape(-1, 2) for words in word_pieces(text)]
    return np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


class Sums:
    """Hashes of runs of words from running sums of one block."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _powers(len(hashes))
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, i] * up, dtype=np.uint64)]) for i in (0, 1)]

    def run(self, which: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of words [start, start + length)."""
        return mixed((self.sums[which][start + length] - self.sums[which][start]) * self.down[start] + np.uint64(1) * np.asarray(length, np.uint64))


@dataclass(frozen=True)
class Segments:
    """Runs of full windows (starts first to last) that share an anchor and a side of it, as columns."""

    anchor: np.ndarray  # hash at level 1
    key: np.ndarray  # hash at level 2
    digest: np.ndarray  # of all words of its windows
    first: np.ndarray
    last: np.ndarray

    def take(self, rows: np.ndarray) -> Segments:
        return Segments(self.anchor[rows], self.key[rows], self.digest[rows], self.first[rows], self.last[rows])


def blocks(hashes: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, max(0, len(hashes) - length + 1), BLOCK):
        yield start, hashes[start : start + BLOCK + length - 1]


def together(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[bytes]]]:
    """The word hashes of runs of texts, the bounds of each text among them, the number of the first, and the texts. A run is one block, unless it is one
    text of more words: so the blocks of a text, and its segments, are the same beside whatever others it comes."""
    own: list[np.ndarray] = []
    run: list[bytes] = []
    begin = held = 0
    for i, text in enumerate(texts):
        h = word_hashes(text)
        if own and held + len(h) > BLOCK:
            yield np.concatenate(own), np.cumsum([0, *map(len, own)]), begin, run
            own, run, begin, held = [], [], i, 0
        own.append(h)
        run.append(text)
        held += len(h)
    if own:
        yield np.concatenate(own), np.cumsum([0, *map(len, own)]), begin, run


def within(bounds: np.ndarray, length: int) -> np.ndarray:
    """At which words a window starts that lies within one text."""
    return np.repeat(bounds[1:], np.diff(bounds)) - np.arange(bounds[-1]) >= length


def anchors(own: np.ndarray, length: int, inside: np.ndarray | None = None) -> tuple[Sums, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: sums, anchor places, first and last window starts that each serves (of those `inside`), hashes of the anchors."""
    gram = -(-length // 4)
    sums, width, n = Sums(own), length - gram + 1, len(own) - length + 1
    h = sums.run(0, np.arange(len(own) - gram + 1), gram)
    keys = h & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    full = np.full(-(-len(h) // width) * width, ~np.uint64(0), np.uint64)
    full[: len(h)] = keys
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)
    mine = np.arange(n) if inside is None else np.flatnonzero(inside[:n])
    at = at[mine]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
    last = np.append(first, len(at))[1:] - 1
    return sums, at[first], mine[first], mine[last], h[at[first]].view(np.int64)


def segments(hashes: np.ndarray, length: int, known, inside: np.ndarray | None = None) -> Segments:
    """The segments whose anchors pass `known` (a test of an array of hashes), of windows that start `inside`."""
    gram = -(-length // 4)
    near = (length - gram) // 2
    double = min(2 * gram, length - near)
    out: list[list[np.ndarray]] = []
    for start, own in blocks(hashes, length):
        sums, at, first, last, g = anchors(own, length, None if inside is None else inside[start : start + len(own)])
        mine = np.flatnonzero(known(g))
        at, first, last, g = at[mine], first[mine], last[mine], g[mine]
        for side in (0, 1):
            has = np.flatnonzero(last >= at - near) if side == 0 else np.flatnonzero(first < at - near)
            if not len(has):
                continue
            p = at[has]
            a, b = (np.maximum(first[has], p - near), last[has]) if side == 0 else (first[has], np.minimum(last[has], p - near - 1))
            key = sums.run(0, p if side == 0 else p + gram - double, double) ^ np.uint64(side)
            digest = sums.run(1, a, b - a + length) ^ np.uint64(side)
            out.append([g[has], key.view(np.int64), digest.view(np.int64), a + start, b + start])
    return Segments(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else Segments(*[np.zeros(0, np.int64)] * 5)


def windows(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 128-bit keys (as two columns) of all full windows of the segments, and their starts."""
    sizes = last - first + 1
    starts = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    a, b = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for start, own in blocks(hashes, length):
        mine = np.flatnonzero((starts >= start) & (starts < start + BLOCK))
        if len(mine):
            sums = Sums(own)
            a[mine], b[mine] = (sums.run(i, starts[mine] - start, length).view(np.int64) for i in (0, 1))
    return a, b, starts


class Levels(SlotMaps):
    """Anchors that occur again; segments alone; half-length windows that occur again; those with different
    segments of which some are alone; documents elected to send segments that aren't alone."""

    NAMES = ("anchors", "alone", "again", "mixed", "elected")

    def segments(self, hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[Segments, np.ndarray, np.ndarray]:
        """Segments that survive level 1; of each, whether it may be alone and which of the texts it lies in."""
        found = segments(hashes, length, lambda g: self.has("anchors", g), within(bounds, length))
        alone = self.has("alone", found.digest) if "alone" in self.packed else np.ones(len(found.digest), bool)
        return found, alone, np.searchsorted(bounds, found.first, "right") - 1


def survey(docs: DataFrame, length: int) -> tuple[dict[str, bytes], int]:
    """The bitmaps of levels 1 and 2, from counts of anchors, half-length windows and digests, and their bits."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / 3 + 1))))

    def level1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            found = [anchors(own, length, within(bounds, length)[start : start + len(own)])[4] for hashes, bounds, *_ in together(texts) for start, own in blocks(hashes, length)]
            if found:
                value, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["value", "n"])

    twice = docs.select("text").mapInArrow(level1, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where("n > 1")
    packed, _ = slot_maps(twice.select(F.lit("anchors").alias("name"), "value", F.lit(0).cast("long").alias("sent")), bits)
    packed.setdefault("anchors", empty_map(bits))
    shared, key = docs.sparkSession.sparkContext.broadcast(packed), token()

    def level2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: Levels = built(key, lambda: Levels(shared.value, bits))  # type: ignore[assignment]
        for batch, texts in slices(batches):
            rows, k1 = [], batch.column(0).to_numpy()
            for hashes, bounds, begin, _ in together(texts):
                s, _, doc = levels.segments(hashes, bounds, length)
                rows.append(np.stack([s.key, s.digest, k1[begin + doc] >> 32]))
            table = np.concatenate(rows, axis=1)
            if table.shape[1]:
                table = table[:, np.lexsort((table[2], table[1], table[0]))]
                first = np.flatnonzero(np.concatenate([[True], (table[:2, 1:] != table[:2, :-1]).any(0)]))
                yield pa.RecordBatch.from_arrays([pa.array(table[0][first]), pa.array(table[1][first]), pa.array(table[2][first].astype(np.int32)), pa.array(np.diff(np.append(first, table.shape[1])), pa.int64())], names=["h", "c", "k", "n"])

    counted = docs.select("k1", "text").mapInArrow(level2, "h long, c long, k int, n long").groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("k").alias("k")).where("k is not null")  # always; so all that follow read the same columns of one exchange
    keys = counted.groupBy("h").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"), F.sum("n").alias("n")).where("n > 1")
    named = lambda frame, name, value: frame.select(F.lit(name).alias("name"), F.expr(value).alias("value"), F.lit(0).cast("long").alias("sent"))
    every = named(counted.where("n = 1"), "alone", "c").union(named(counted.where("n > 1"), "elected", "xxhash64(c, k)")).union(named(keys, "again", "h")).union(named(keys.where("kinds > 1 and single > 0"), "mixed", "h"))
    more, _ = slot_maps(every, bits)
    return {name: empty_map(bits) for name in Levels.NAMES} | packed | more, bits


def repeated_starts(docs: DataFrame, known, key: str, bits: int, length: int) -> DataFrame:
    """Level 3: documents (k1, k2) and starts of full windows that occur again, of segments that are alone."""

    def level3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: Levels = built(key, lambda: Levels(known.value, bits))  # type: ignore[assignment]
        for batch, texts in slices(batches):
            parts, k1, k2 = [], batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for hashes, bounds, begin, _ in together(texts):
                found, alone, doc = levels.segments(hashes, bounds, length)
                send = np.where(alone, levels.has("again", found.key), levels.has("mixed", found.key))
                several = np.flatnonzero(send & ~alone)
                if len(several):
                    send[several] = levels.has("elected", votes(found.digest[several].view(np.uint64).tolist(), (k1[begin + doc[several]] >> 32).tolist()))
                for single in (True, False):
                    rows = np.flatnonzero(send & (alone == single))
                    if len(rows):
                        mine = found.take(rows)
                        a, b, starts = windows(hashes, mine.first, mine.last, length)
                        own = np.repeat(doc[rows], mine.last - mine.first + 1)
                        parts.append((a, b, np.full(len(a), 1 if single else 2), k1[begin + own], k2[begin + own], starts - bounds[own] if single else np.full(len(a), -1)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)], names=["a", "b", "n", "k1", "k2", "start"])

    sent = checkpointed(docs.select("k1", "k2", "text").mapInArrow(level3, "a long, b long, n long, k1 long, k2 long, start long"))
    again = checkpointed(sent.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1").select("a", "b"))
    return sent.where("start >= 0").join(again, ["a", "b"], "left_semi").select("k1", "k2", "start")


def covered(first: np.ndarray, last: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts between one of `first` and its `last`."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, last + length, -1)
    return np.cumsum(edges[:-1]) > 0


def dedup(docs: DataFrame, *, length: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Remove from every whole text each word covered by a window of `length` words whose word sequence also starts anywhere
    else in the documents: the id column, n_words, n_removed, n_spans, spans (first and behind-last words of the removed runs) and kept (the words
    that stay, joined by one blank).

    Words are runs of anything but ASCII white space, compared as they are; windows are judged on the input, never cross documents and may
    overlap. A null text has no words; a text of fewer than `length` words loses nothing; repeated rows are copies of each other;
    a null id stays null; an empty table gives no rows; other columns are ignored, or come along as the struct `row` if `carry`. Copies
    of any number cost one row each task in every count; a task holds one slice of texts and, of one text or some short ones, 16 bytes a word.
    """
    if length < 1:
        raise ValueError("a window has at least one word")
    arrow_limits(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(name, text).alias("k1"), F.xxhash64(text, name).alias("k2"), text.alias("text"), *whole_row(docs.drop(text_col), carry))
    given = rows.select("k1", "k2", "text")
    packed, bits = survey(given, length)
    context = docs.sparkSession.sparkContext
    known, known_key = context.broadcast(packed), token()
    starts = checkpointed(repeated_starts(given, known, known_key, bits, length))
    by_doc = starts.groupBy("k1", "k2").agg(F.collect_set("start").alias("starts"))  # a set: a document's own words bound it however often its row is repeated
    joined, _ = slot_maps(starts.select(F.lit("docs").alias("name"), F.col("k1").alias("value"), F.lit(0).cast("long").alias("sent")), bits)
    # keys of their own: what repeated_starts() has unpacked goes
    shared, key, cut_key = context.broadcast({"docs": empty_map(bits)} | joined), token(), token()

    def kept_back(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        levels: SlotMaps = built(key, lambda: SlotMaps(shared.value, bits), 1 if wanted else 2)  # type: ignore[assignment]
        for batch in batches:
            yield batch.filter(pa.array(levels.has("docs", batch.column(1).to_numpy()) == wanted))

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in kept_back(batches, True):
            yield batch.set_column(3, "text", pa.array([packer.compress(t.as_py()) for t in batch.column(3).cast(pa.binary())], pa.binary()))
        give_back()

    def unshuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kept_back(batches, False):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.nulls(batch.num_rows, pa.list_(pa.int64())), *batch.columns[4:]], names=["id", "text", "starts", *batch.schema.names[4:]])

    def cut(packed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels: Levels = built(cut_key, lambda: Levels(known.value, bits), 1 if packed else 2)  # type: ignore[assignment]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for batch, texts in slices(batches if packed else unshuffled(batches)):
                out: list[tuple[int, int, list[dict[str, int]], str]] = []
                known_starts = batch.column(2).to_pylist()
                for hashes, bounds, begin, run_texts in together(map(zstandard.decompress, texts) if packed else texts):
                    found, alone, _ = levels.segments(hashes, bounds, length)
                    whole = found.take(np.flatnonzero(~alone))
                    single = np.concatenate([np.zeros(0, np.int64), *[np.array(known_starts[begin + i], np.int64) + bounds[i] for i in range(len(bounds) - 1) if known_starts[begin + i]]])
                    every = covered(np.append(whole.first, single), np.append(whole.last, single), length, len(hashes))
                    for t, a, b in zip(run_texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                        gone = every[a:b]
                        if not gone.any():
                            out.append((b - a, 0, [], b" ".join(b" ".join(piece) for piece in word_pieces(t) if piece).decode()))
                            continue
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                        words, at = [], 0
                        for piece in word_pieces(t):
                            words.append(b" ".join([piece[j] for j in np.flatnonzero(~gone[at : at + len(piece)]).tolist()]))
                            at += len(piece)
                        out.append((b - a, int(gone.sum()), [{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()], b" ".join(filter(None, words)).decode()))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(map(len, columns[2]), pa.int64()), pa.array(columns[2], kind), pa.array(columns[3], pa.string()), *batch.columns[3:]],
                    names=["id", "n_words", "n_removed", "n_spans", "spans", "kept", *batch.schema.names[3:]],
                )

        return run

    hit = rows.mapInArrow(shuffled, StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema.fields])).join(by_doc, ["k1", "k2"], "left").select("id", "text", "starts", *["row"] * carry)
    schema = with_fields(f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept string", hit.schema.fields[3:])
    return hit.mapInArrow(cut(True), schema).unionByName(rows.mapInArrow(cut(False), schema)).withColumnRenamed("id", id_col)


#: The query by a table of all windows.
DEDUP_SQL = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
places as (select doc_id, unnest(w) word, generate_subscripts(w, 1) p, len(w) n from words),
windows as (select p.doc_id, p.p, array_to_string(w.w[p.p : p.p + 34], ' ') s from places p join words w using (doc_id) where p.p + 34 <= p.n),
again as (select doc_id, p from (select doc_id, p, count(*) over (partition by s) c from windows) where c > 1),
gone as (select l.doc_id, l.p, l.word, coalesce(max(a.p) over (partition by l.doc_id order by l.p rows between 34 preceding and current row), 0) > 0 g from places l left join again a using (doc_id, p)),
cut as (select doc_id, count(*) filter (where g) n_removed, string_agg(word, ' ' order by p) filter (where not g) kept from gone group by doc_id)
select w.doc_id, len(w.w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from words w left join cut using (doc_id)
"""


def brute(texts: list[bytes], length: int) -> list[list[bool]]:
    """Which words go, by a table of all windows; for tests."""
    words = [t.split() for t in texts]
    counts = Counter(hashlib.sha1(b" ".join(w[i : i + length])).digest() for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if counts[hashlib.sha1(b" ".join(w[i : i + length])).digest()] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out
