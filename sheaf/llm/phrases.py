"""Phrase collocation mining: exact weighted n-gram counts by hash bucket, each counted out-of-core by DuckDB.

Equal pieces of text are first merged into one piece with a multiplicity. Their n-grams are summed by DuckDB in the map task, sent to hash buckets
and summed there again, so a common n-gram reaches its bucket once from each task. The database of a task has a memory limit and spills into a private scratch
folder that goes with the task; nothing else reads it. Only n-grams of the least count or more are of use, as candidates or as parts of candidates
(a part is at least as frequent as the whole). So hashes are counted first, in slots that add up all n-grams that fall into them: of words and pairs, then
of longer ones whose words and pairs all passed. Bitmaps of the slots that reach the least count, bounded in size, say which n-grams are spelt out at
all; what they let through in vain (more, once the corpus has many n-grams to a slot) is dropped by its exact count.

A candidate's cuts are scored by lookup requests: each asks for the count of one part and is shuffled to where that count is; the
answers are gathered by candidate. Containment in longer candidates goes the same way. Ranks come from range partitions and prefix sums.
"""

from __future__ import annotations

import itertools
import math
import shutil
import tempfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import arrow_limits, built, checkpointed, give_back, slices, token, written
from sheaf.llm.substring import mixed
from sheaf.llm.suffix import LEAST_BITS, MOST_BITS
from sheaf.operators.ranks import ranked

#: Lower-cases A-Z, turns the marks that end a piece into line feeds and tabs into blanks.
_PIECES = bytes.maketrans(bytes(range(0x41, 0x5B)) + b".,;:!?\x0b\x0c\r\t", bytes(range(0x61, 0x7B)) + b"\n" * 9 + b" ")
#: Memory of a task's database; pieces' bytes whose n-grams one bucket counts, about.
MEMORY, BUCKET_BYTES = "192MB", 16 << 20
#: Characters of pieces whose words are hashed together.
STRETCH = 4 << 20


def pieces(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): the different pieces of each language (null: `und`), words joined by one blank, and how often each occurs."""
    arrow_limits(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found: Counter[tuple[str, bytes]] = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found.update((lang, b" ".join(words)) for p in text.translate(_PIECES).split(b"\n") if (words := p.split()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["lang", "piece", "n"])

    return given.mapInArrow(split, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def summed(batches: Iterator[pa.RecordBatch], least: int = 0) -> Iterator[pa.RecordBatch]:
    """Sums of n by (bucket, lang, gram), at least `least`, in order of buckets, by a DuckDB of this task: what passes its memory limit goes to a scratch
    folder that ends with it."""
    folder = tempfile.mkdtemp(prefix="counts-")
    con = duckdb.connect(":memory:", config={"memory_limit": MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": False})
    try:
        con.execute("create table rows (bucket bigint, lang varchar, gram varchar, n bigint)")
        for batch in batches:
            if batch.num_rows:
                con.register("batch", pa.Table.from_batches([batch]))
                con.execute("insert into rows select bucket, lang, gram, n from batch")
                con.unregister("batch")
        for out in con.sql(f"select bucket, lang, gram, sum(n)::bigint n from rows group by bucket, lang, gram having sum(n) >= {least} order by bucket").to_arrow_reader(200_000):
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(out.columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["bucket", "lang", "gram", "n"])
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)
        give_back()


class Words:
    """The words of some pieces in a row, each with two independent hashes."""

    def __init__(self, langs: list[str], pieces: list[str], times: list[int]):
        sizes = np.fromiter((p.count(" ") + 1 for p in pieces), np.int64, len(pieces))
        self.langs, self.words = langs, "\n".join(pieces).encode().split()  # no other ASCII white space is left in a piece
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.words))  # words from here to the piece's end
        self.times = np.array(times, np.int64)[self.piece]
        seeds = {lang: xxhash.xxh3_64_intdigest(lang, 1) for lang in {*langs}}
        self.seed = np.array([seeds[lang] for lang in langs], np.uint64)[self.piece]
        self.hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), np.uint64).reshape(-1, 2)

    def levels(self, sketch: Sketch, most: int, lanes: int = 1) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each length up to `most`: where n-grams begin that may be frequent as far as the sketched shorter ones and their own length say, and their
        hashes, language included, each made of the one a word shorter."""
        h = [self.seed.copy() for _ in range(lanes)]
        starts, good = np.arange(len(self.words)), np.ones(len(self.words) + 1, bool)
        for size in range(1, most + 1):
            starts = starts[(self.left[starts] >= size) & good[starts] & good[np.minimum(starts + 1, len(self.words))]] if size > 1 else starts
            for lane in range(lanes):
                h[lane][starts] = mixed(h[lane][starts] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[starts + size - 1, lane])
            if size in sketch.maps:
                starts = starts[sketch.passed(size, h[0][starts])]
            yield size, starts, [x[starts] for x in h]
            good = np.zeros(len(self.words) + 1, bool)
            good[starts] = True


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Pieces (lang, piece, n) of any number of batches in stretches of about STRETCH characters; a longer piece ends its stretch."""
    held: tuple[list[str], list[str], list[int]] = ([], [], [])
    size = 0
    for batch in batches:
        for lang, piece, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for values, value in zip(held, (lang, piece, n), strict=True):
                values.append(value)
            size += len(piece)
            if size > STRETCH:
                yield Words(*held)
                held, size = ([], [], []), 0
    if held[0]:
        yield Words(*held)


class Sketch:
    """By length of n-grams, a bitmap of the slots whose n-grams together occur often enough."""

    def __init__(self, packed: dict[int, bytes], bits: int):
        self.bits, self.maps = bits, {size: np.frombuffer(zlib.decompress(m), np.uint8) for size, m in packed.items()}

    def passed(self, size: int, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.bits)
        return (self.maps[size][slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sketched(found: DataFrame, lengths: tuple[int, ...], bits: int, least: int, known: Callable[[], Sketch]) -> dict[int, bytes]:
    """Packed bitmaps of the slots, of each length, whose occurrences add up to `least` or more; n-grams that `known` rules out aren't counted.

    A task sends sorted (slot, count) lists, packed, by range of slots; a range is summed as one array of at most 2**18 counters.
    """
    ranges = 1 << max(6, bits - 18)
    width = bits - ranges.bit_length() + 1

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = known()
        for words in stretches(batches):
            parts, blobs = [], []
            for size, starts, hashes in words.levels(sketch, max(lengths)):
                if size not in lengths:
                    continue
                slots = (hashes[0] >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(slots, kind="stable")
                slots, times = slots[order], words.times[starts][order]
                first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, np.int64)
                slots, times = slots[first], np.add.reduceat(times, first) if len(first) else times
                edges = np.searchsorted(slots, np.arange(ranges + 1) << width)
                for r in np.flatnonzero(np.diff(edges)).tolist():
                    own = slice(edges[r], edges[r + 1])
                    parts.append(size * ranges + r)
                    blobs.append(zstandard.compress(np.diff(slots[own], prepend=r << width).astype("<u4").tobytes() + times[own].astype("<i8").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters = None, np.zeros(0, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(counters >= least, bitorder="little").tobytes(), 1)], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield done()
                    now, counters = part, np.zeros(1 << width, np.int64)
                data = zstandard.decompress(blob)
                n = len(data) // 12
                counters[np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64)] += np.frombuffer(data, "<i8", n, 4 * n)
        if now is not None:
            yield done()

    lists = found.mapInArrow(sent, "part int, blob binary").repartition("part").sortWithinPartitions("part")
    maps = {size: bytearray(1 << bits - 3) for size in lengths}
    for row in lists.mapInArrow(added, "part int, bits binary").collect():  # 2**bits bits of each length, less what packing saves
        size, r = divmod(row["part"], ranges)
        maps[size][r << width - 3 : r + 1 << width - 3] = zlib.decompress(bytes(row["bits"]))
    return {size: zlib.compress(bytes(m), 1) for size, m in maps.items()}


def counts(found: DataFrame, *, most: int, least: int) -> DataFrame:
    """(lang, gram, n) of the n-grams of up to `most` words that occur `least` times or more, exactly.

    Sketches of one and two words, then of three and more where those passed, say which n-grams may be frequent; those alone are spelt out,
    summed and counted. A sketch loses none: a slot holds at least what each of its n-grams has.
    """
    spark = found.sparkSession
    facts = found.agg(F.sum(F.octet_length("piece")).alias("size"), F.sum(F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1).alias("words")).first()
    buckets = max(spark.sparkContext.defaultParallelism, -(-(facts["size"] or 0) // BUCKET_BYTES))
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2((facts["words"] or 0) + 1))))

    def shared(packed: dict[int, bytes]) -> Callable[[], Sketch]:
        sent, key = spark.sparkContext.broadcast(packed), token()
        return lambda: built(key, lambda: Sketch(sent.value, bits))  # type: ignore[return-value]

    packed = sketched(found, tuple(range(1, min(2, most) + 1)), bits, least, lambda: Sketch({}, bits))
    if most > 2:
        packed |= sketched(found, tuple(range(3, most + 1)), bits, least, shared(packed))
    known = shared(packed)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, lang, gram, n): equal n-grams of a stretch, told by 128 bits, are one row."""
        sketch = known()
        for words in stretches(batches):
            for size, starts, (a, b) in words.levels(sketch, most, lanes=2):
                order = np.argsort(a, kind="stable")
                if np.any((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])):
                    order = np.lexsort((b, a))
                a, b, starts = a[order], b[order], starts[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
                times = np.add.reduceat(words.times[starts], first) if len(first) else np.zeros(0, np.int64)
                own = starts[first]
                grams = [words.words[i] for i in own.tolist()] if size == 1 else [b" ".join(words.words[i : i + size]) for i in own.tolist()]
                langs = pa.DictionaryArray.from_arrays(pa.array(words.piece[own], pa.int32()), pa.array(words.langs, pa.string())).dictionary_decode()
                yield pa.RecordBatch.from_arrays([pa.array((a[first] % np.uint64(buckets)).astype(np.int64), pa.int64()), langs, pa.array(grams, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["bucket", "lang", "gram", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the task, packed by bucket: shuffled as blocks of columns, not as rows."""
        for batch in summed(spelt(batches)):
            edges = np.flatnonzero(np.concatenate([[True], np.diff(batch.column(0).to_numpy()) != 0, [True]]))
            parts, blobs = [], []
            for x, y in itertools.pairwise(edges.tolist()):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(x, y - x))
                parts.append(batch.column(0)[x].as_py())
                blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (own for batch in batches for blob in batch.column(1) for own in pa.ipc.open_stream(blob.as_py()))
        for batch in summed(rows, least):
            yield batch.select(["lang", "gram", "n"])

    return found.mapInArrow(merged, "bucket long, rows binary").repartition(buckets, "bucket").mapInArrow(total, "lang string, gram string, n long")


def _part(start: str, size: str) -> Column:
    return F.expr(f"array_join(slice(words, {start}, {size}), ' ')")


def best_cuts(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, phrase, a, cut: score, k, l, r): of each candidate (lang, phrase, a, words) the lowest-scoring cut, the first of equals.

    Each cut asks for the counts of its two parts; a request is shuffled to where the table `known` (lang, gram, a) has that count, and the
    answers come back to the candidate.
    """
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    parts = F.array(F.struct(F.lit(0).alias("side"), _part("1", "k").alias("gram")), F.struct(F.lit(1).alias("side"), _part("k + 1", "size(words) - k").alias("gram")))
    requests = cuts.select("lang", "phrase", "a", "k", F.explode(parts).alias("ask")).select("lang", "phrase", "a", "k", "ask.side", "ask.gram")
    answers = requests.join(known.select("lang", "gram", F.col("a").alias("f")), ["lang", "gram"])
    scored = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("cast(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    return scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))


def collocations(docs: DataFrame, *, most: int = 4, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's first `top` phrases of 2 to `most` words by score: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and the two parts of its lowest-scoring cut, n all words of the language. Phrases
    that stand in a longer candidate at least 80 % as frequent are left out. A null text is empty, a null language `und`; a piece
    without words counts for nothing; repeated rows count as often as they occur; ties fall to the smaller phrase in byte order, so ranks are
    total; other columns are ignored; an empty table gives no rows. Arithmetic is in decimals of 38 digits.
    """
    found = written(pieces(docs, text_col=text_col, lang_col=lang_col))
    sizes = found.select("lang", (F.size(F.split("piece", " ")) * F.col("n")).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    known = checkpointed(counts(found, most=most, least=least).select("lang", "gram", F.col("n").alias("a")))
    candidates = known.select("lang", F.col("gram").alias("phrase"), "a", F.split("gram", " ").alias("words")).where(F.size("words") > 1)
    best = best_cuts(candidates, known)

    # the largest count of a longer candidate around each phrase
    inner = candidates.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")).select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("start"))
    held = inner.select("lang", _part("start", "size").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = best.join(held, ["lang", "phrase"], "left").where("outer is null or cast(outer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80")
    ranks = ranked(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], groups=["lang"]).where(F.col("rank") <= top)
    return ranks.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The query, n-grams spelt out.
PHRASES_SQL = """
with pieces as (
  select lang, regexp_extract_all(p, '[^\\x20\\x09]+') w
  from (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) p from documents)),
counted as (select lang, w, count(*)::hugeint m from pieces where len(w) > 0 group by lang, w),
sizes as (select lang, sum(len(w) * m) n from counted group by lang),
places as (select lang, w, m, unnest(generate_series(1, len(w))) i from counted),
grams as (select lang, array_to_string(w[i : i + k - 1], ' ') g, k, sum(m) f from places, unnest([1, 2, 3, 4]) t(k) where i + k - 1 <= len(w) group by 1, 2, 3 having sum(m) >= 30),
cands as (select lang, g, f a, string_split(g, ' ') w from grams where k > 1),
cuts as (select lang, g, a, k, array_to_string(w[1 : k], ' ') x, array_to_string(w[k + 1 :], ' ') y from cands, unnest([1, 2, 3]) t(k) where k < len(w)),
scored as (select c.lang, c.g, c.a, c.k, x.f l, y.f r, 2000000 * c.a // (x.f + y.f) score from cuts c join grams x on x.lang = c.lang and x.g = c.x join grams y on y.lang = c.lang and y.g = c.y),
best as (select * from scored qualify row_number() over (partition by lang, g order by score, k) = 1),
inner_parts as (select c.lang, array_to_string(w[i : i + s - 1], ' ') g, max(a) f from cands c, unnest([2, 3]) t(s), unnest([1, 2, 3]) u(i) where s < len(w) and i + s - 1 <= len(w) group by 1, 2),
kept as (select b.* from best b left join inner_parts p on p.lang = b.lang and p.g = b.g where p.f is null or 100 * p.f < 80 * b.a),
ranks as (select *, row_number() over (partition by lang order by score desc, a desc, encode(g)) rank from kept)
select r.lang, rank::bigint rank, g phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from ranks r join sizes using (lang) where rank <= 2000
"""
