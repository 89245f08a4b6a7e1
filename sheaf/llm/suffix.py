"""Suffix-array dedup: sorted, front-coded suffix runs are exchanged and merged by loser trees that keep common prefixes.

A full suffix array has an entry of hundreds of bytes for each byte of the corpus. Here the suffixes are sampled, without
loss: every string of `length` bytes holds a `gram`-byte substring of the smallest hash (the leftmost of equals), its anchor,
and equal strings have their anchors at the same place. A string that starts near its anchor agrees with its copies on a long
stretch to the right of the anchor, any other one on a long stretch to the left; so each anchor counts as two halves, the
right one for the near strings and the left one, read backwards, for the others, and each half has a key: the hash of the stretch
that all its strings share. Copies of a string are halves with equal keys.

A half's surroundings are all bytes of its strings. Keys and digests of surroundings are counted first, so no bytes move for
halves whose surroundings occur again as a whole (all their strings are repeated) or whose key doesn't. Only where a key has
different surroundings, some of them alone, suffixes are sorted and merged: neighbours' common prefixes say how far suffixes
agree to the right, the order of the reversed bytes before the anchors how far they agree to the left; a string at distance d before its
anchor occurs again where another half of the key agrees on d bytes to the left and on length - d bytes to the right.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sheaf.llm.common import arrow_limits, built, checkpointed, give_back, slices, token, whole_row, with_fields

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Texts are hashed in pieces of this size; a place within a piece fits in PLACE_BITS.
PIECE, PLACE_BITS = 1 << 18, 20
RUN_BYTES = 12 << 20
#: What the runs of one part may hold when unpacked, about.
PART_BYTES = 32 << 20
#: Bitmaps have 2**20 to 2**28 bits (32 MB), about eight to an anchor of the input; fuller ones let more bytes through, with the same result.
LEAST_BITS, MOST_BITS = 20, 28
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        tables = []
        for base in (_BASE, _UNBASE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            tables.append(np.multiply.accumulate(out))
        _POWERS[size] = tuple(tables)  # type: ignore[assignment]
    return tuple(x[:n] for x in _POWERS[size])  # type: ignore[return-value]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of each run of `gram` bytes."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, length: int, gram: int) -> list[np.ndarray]:
    """Anchor places, the first and last starts of the strings that each serves, and the grams' hashes."""
    width, out = length - gram + 1, []
    for start in range(0, max(0, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - start), start)
        h = gram_hashes(data, gram)
        mask = np.uint64((1 << PLACE_BITS) - 1)
        keys = h & ~mask | np.arange(len(h), dtype=np.uint64)
        n = len(h) - width + 1
        full = np.full(-(-len(h) // width) * width, ~np.uint64(0), np.uint64)
        full[: len(h)] = keys
        blocks = full.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], n) - 1
        out.append(np.stack([at[first] + start, first + start, last + start, h[at[first]].view(np.int64)]))
    return list(np.concatenate(out, axis=1)) if out else [np.zeros(0, np.int64)] * 4


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that `known` bytes agree."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def pack_run(entries: list[tuple[bytes, bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, bytes before it, occurrences), front-coded: each suffix as the length of the prefix that it
    shares with the one before, and the rest."""
    parts, before = [], b""
    for suffix, left, places in entries:
        lcp = common(before, suffix)
        parts.append(struct.pack("<HHHI", lcp, len(suffix) - lcp, len(left), len(places)))
        parts += [suffix[lcp:], left, places]
        before = suffix
    return zstandard.compress(b"".join(parts), 10)


def read_run(data: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(common prefix with the one before, suffix, bytes before it, occurrences)."""
    data, at, before = zstandard.decompress(data), 0, b""
    while at < len(data):
        lcp, rest, left, places = struct.unpack_from("<HHHI", data, at)
        at += 10
        before = before[:lcp] + data[at : at + rest]
        at += rest
        yield lcp, before, data[at : at + left], data[at + left : at + left + places]
        at += left + places


class LoserTree:
    """Merges sorted runs. Every candidate knows the prefix it shares with the last suffix that came out: of two candidates the
    one that shares more is the smaller, and only equals are compared, from there on."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes, bytes]]]):
        self.runs, n = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs]
        self.shared = [0] * n
        size = 1 << (n - 1).bit_length()
        self.size, self.losers = size, [-1] * size
        winners = [-1] * size + [i if i < len(runs) else -1 for i in range(size)]
        for node in range(size - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix becomes that with the winner."""
        x, y = self.heads[a] if a >= 0 else None, self.heads[b] if b >= 0 else None
        if x is None or y is None:
            return (a, b) if y is None else (b, a)
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        lcp = common(x[1], y[1], p)
        if x[1][lcp:] <= y[1][lcp:]:
            self.shared[b] = lcp
            return a, b
        self.shared[a] = lcp
        return b, a

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """All entries in order, each with the prefix that it shares with the one before."""
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            own = self.winner
            yield self.shared[own], head[1], head[2], head[3]
            self.heads[own] = after = next(self.runs[own], None)
            self.shared[own] = after[0] if after else 0
            node = (self.size + own) // 2
            while node:
                own, self.losers[node] = self._match(own, self.losers[node])
                node //= 2
            self.winner = own


def repeated(group: list[tuple[int, bytes, bytes, bytes]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """For entries of one gram in sorted order, the distances d (first, last) before the anchor at which strings occur again,
    by (occurrences, first d, last d); an entry that itself occurs more than once is repeated at every distance."""
    n = len(group)
    rights = np.array([g[0] for g in group])
    lefts = [g[2] for g in group]
    order = sorted(range(n), key=lefts.__getitem__)
    shared = np.array([0] + [common(lefts[a], lefts[b]) for a, b in zip(order[:-1], order[1:], strict=True)])
    reach = [(max(0, length - len(g[1])), len(g[2])) for g in group]
    single = [len(g[3]) == OCCURRENCE for g in group]
    for g, (a, b), alone in zip(group, reach, single, strict=True):
        if not alone:
            yield g[3], a, b
    if not any(single) or n < 2:
        return
    if n == 2:
        right, left = int(rights[1]), int(shared[1])
        for g, (a, b), alone in zip(group, reach, single, strict=True):
            if alone and max(a, length - right) <= min(b, left):
                yield g[3], max(a, length - right), min(b, left)
        return
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    low, high = min(a for a, _ in reach), max(b for _, b in reach)
    again = np.zeros((high - low + 1, n), bool)
    step = max(1, (1 << 20) // n)
    for d0 in range(low, high + 1, step):
        d = np.arange(d0, min(high + 1, d0 + step))
        right = np.cumsum(rights[None, :] < (length - d)[:, None], axis=1)
        left = np.cumsum(shared[None, :] < d[:, None], axis=1)[:, place]
        keys = right * (n + 1) + left
        by = np.argsort(keys, axis=1, kind="stable")
        keys = np.take_along_axis(keys, by, 1)
        same = keys[:, 1:] == keys[:, :-1]
        hit = np.zeros(keys.shape, bool)
        hit[:, 1:] |= same
        hit[:, :-1] |= same
        np.put_along_axis(again[d0 - low : d0 - low + len(d)], by, hit, 1)
    for j in range(n):
        if single[j]:
            a, b = reach[j]
            row = np.concatenate([[False], again[a - low : b - low + 1, j], [False]])
            edges = np.flatnonzero(row[1:] != row[:-1])
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                yield group[j][3], a + x, a + y - 1


#: An occurrence: the two keys of the document and the anchor's place in it (a left half's end, negative).
_PLACE = "<qqq"
OCCURRENCE = struct.calcsize(_PLACE)
#: What an elected document sends for surroundings that occur more than once, whose documents all know it: never one occurrence.
SEVERAL = struct.pack(_PLACE, 0, 0, 1 << 62) * 2


@dataclass(frozen=True)
class Half:
    key: int
    digest: int
    side: int  # 0: right, 1: left
    place: int
    start: int  # all bytes of its strings
    end: int
    suffix: bytes
    left: bytes


def halves(text: bytes, at: list[int], first: list[int], last: list[int], length: int, gram: int) -> Iterator[Half]:
    """The halves of anchors: strings that start at most (length - gram) / 2 bytes before it, and the mirror image of the others."""
    near = (length - gram) // 2
    for p, a, b in zip(at, first, last, strict=True):
        if b >= p - near:
            yield _half(0, p, max(a, p - near), b + length, text[p : b + length], text[max(a, p - near) : p][::-1], length - near)
        if a < p - near:
            end, e = min(b, p - near - 1) + length, p + gram
            yield _half(1, -e, a, end, text[a:e][::-1], text[e:end], length - near)


def _half(side: int, place: int, start: int, end: int, suffix: bytes, left: bytes, shared: int) -> Half:
    digest = xxhash.xxh3_64_intdigest(len(left).to_bytes(4, "little") + left + suffix, side)
    return Half(xxhash.xxh3_64_intdigest(suffix[:shared], side), digest, side, place, start, end, suffix, left)


def slot_maps(rows: DataFrame, bits: int) -> tuple[dict[str, bytes], int]:
    """Packed bitmaps, by `name`, of the top `bits` bits of the column `value`, collected as at most 2**bits bits each; the sum of `sent`."""
    slots = rows.select("name", "sent", F.shiftrightunsigned("value", 64 - bits).alias("slot"))
    found = slots.groupBy("name", F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"), F.sum("sent").alias("sent"))
    maps: dict[str, np.ndarray] = {}
    sent = 0
    for row in found.toLocalIterator():
        out = maps.setdefault(row["name"], np.zeros(map_bytes(bits), np.uint8))
        at = (row["bucket"] - 1) * 4096  # buckets count from 1; slot 0 alone is in bucket 0, kept at the end
        piece = np.frombuffer(bytes(row["bits"]), np.uint8)
        out[at if at >= 0 else len(out) - 4096 :][: len(piece)] = piece
        sent += row["sent"]
    return {name: zlib.compress(out.tobytes(), 1) for name, out in maps.items()}, sent


def map_bytes(bits: int) -> int:
    return ((1 << bits) // 32768 + 2) * 4096


def empty_map(bits: int) -> bytes:
    return zlib.compress(bytes(map_bytes(bits)), 1)


def in_slot_map(known: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    slot = (values.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    bit = np.where(slot > 0, slot - 1, (len(known) - 4096) * 8)
    return (known[bit >> 3] >> (bit & 7) & 1).astype(bool)


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


class SlotMaps:
    """Bitmaps as broadcast; a worker unpacks those that it asks for, when it first does: each may take 32 MB."""

    def __init__(self, packed: dict[str, bytes], bits: int):
        self.packed, self.bits = packed, bits
        self.maps: dict[str, np.ndarray] = {}

    def has(self, name: str, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return np.zeros(0, bool)
        if name not in self.maps:
            self.maps[name] = np.frombuffer(zlib.decompress(self.packed[name], bufsize=map_bytes(self.bits)), np.uint8)
        return in_slot_map(self.maps[name], values, self.bits)


class Maps(SlotMaps):
    """Grams that occur again; surroundings that are alone; keys that occur again; keys with different
    surroundings of which some are alone; documents elected to send surroundings that aren't alone."""

    NAMES = ("grams", "alone", "again", "mixed", "elected")

    def halves(self, text: bytes, length: int, gram: int) -> tuple[list[Half], list[bool]]:
        """The halves of anchors whose gram may occur again; of each, whether its surroundings may be alone."""
        at, first, last, g = anchors(text, length, gram)
        mine = np.flatnonzero(self.has("grams", g)) if len(at) else at
        found = list(halves(text, at[mine].tolist(), first[mine].tolist(), last[mine].tolist(), length, gram))
        return found, self.has("alone", signed([h.digest for h in found])).tolist() if found and "alone" in self.packed else [True] * len(found)


def votes(digests: list[int], keys: list[int]) -> np.ndarray:
    """Spark's xxhash64(c, k) of longs and ints: XXH64 of each value, seeded by the one before."""
    return signed([xxhash.xxh64_intdigest((k & 0xFFFFFFFF).to_bytes(4, "little"), xxhash.xxh64_intdigest(d.to_bytes(8, "little"), 42)) for d, k in zip(digests, keys, strict=True)])


def survey(docs: DataFrame, length: int, gram: int) -> tuple[dict[str, bytes], int, int]:
    """The packed bitmaps, their bits and how many surroundings will be sent, from counts of grams, keys and digests."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * size / length + 1))))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchors(t, length, gram)[3] for t in texts]), pa.int64())], names=["value"])

    twice = docs.select("text").mapInArrow(grams, "value long").groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("grams").alias("name"), "value", F.lit(0).cast("long").alias("sent"))
    packed, _ = slot_maps(twice, bits)
    packed.setdefault("grams", empty_map(bits))
    shared, key = spark.sparkContext.broadcast(packed), token()

    def ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: Maps = built(key, lambda: Maps(shared.value, bits))  # type: ignore[assignment]
        for batch, texts in slices(batches):
            h, c, k = [], [], []
            for k1, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found = maps.halves(text, length, gram)[0]
                h += [x.key for x in found]
                c += [x.digest for x in found]
                k += [k1 >> 32] * len(found)
            if h:
                table = np.stack([signed(h), signed(c), np.array(k, np.int64)])
                table = table[:, np.lexsort((table[2], table[1], table[0]))]
                first = np.flatnonzero(np.concatenate([[True], (table[:2, 1:] != table[:2, :-1]).any(0)]))
                yield pa.RecordBatch.from_arrays([pa.array(table[0][first]), pa.array(table[1][first]), pa.array(table[2][first].astype(np.int32)), pa.array(np.diff(np.append(first, len(h))), pa.int64())], names=["h", "c", "k", "n"])

    counted = docs.select("k1", "text").mapInArrow(ballots, "h long, c long, k int, n long").groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("k").alias("k")).where("k is not null")  # always; so all that follow read the same columns of one exchange
    keys = counted.groupBy("h").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"), F.sum("n").alias("n")).where("n > 1")
    named = lambda frame, name, value, sent="0L": frame.select(F.lit(name).alias("name"), F.expr(value).alias("value"), F.expr(sent).alias("sent"))
    every = named(counted.where("n = 1"), "alone", "c").union(named(counted.where("n > 1"), "elected", "xxhash64(c, k)")).union(named(keys, "again", "h")).union(named(keys.where("kinds > 1 and single > 0"), "mixed", "h", "kinds"))
    more, sent = slot_maps(every, bits)
    return {name: empty_map(bits) for name in Maps.NAMES} | packed | more, bits, sent


def duplicate_ranges(docs: DataFrame, known, key: str, bits: int, sent: int, *, length: int, gram: int) -> DataFrame:
    """Byte ranges (k1, k2, start, end) covered by strings of `length` bytes that also start elsewhere, of halves whose surroundings
    are alone, from documents given as (k1, k2, text). Ranges may overlap."""
    # as many parts as keep what one of them sorts within PART_BYTES: larger runs share longer prefixes
    parts = max(8, -(-sent * 2 * length // PART_BYTES))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: Maps = built(key, lambda: Maps(known.value, bits))  # type: ignore[assignment]
        held: dict[int, dict[tuple[bytes, bytes], list[bytes]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(part, pack_run([(s, left, b"".join(o)) for (s, left), o in sorted(entries.items())])) for part, entries in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "run"])

        for batch, texts in slices(batches):
            for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                found, alone = maps.halves(text, length, gram)
                if not found:
                    continue
                h = signed([x.key for x in found])
                send = np.where(alone, maps.has("again", h), maps.has("mixed", h))
                if len(several := np.flatnonzero(send & ~np.array(alone))):
                    send[several] = maps.has("elected", votes([found[j].digest for j in several.tolist()], [k1 >> 32] * len(several)))
                for j in np.flatnonzero(send).tolist():
                    x = found[j]
                    entries = held.setdefault(x.key % parts * 2 + x.side, {})
                    if (x.suffix, x.left) not in entries:
                        size += len(x.suffix) + len(x.left) + 200
                    entries.setdefault((x.suffix, x.left), []).append(struct.pack(_PLACE, k1, k2, x.place) if alone[j] else SEVERAL)
                    size += 100
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = length - (length - gram) // 2
        for own in _by_part(batches):
            group: list[tuple[int, bytes, bytes, bytes]] = []
            out: list[tuple[int, int, int, int]] = []

            def done() -> None:
                if len(group) == 1 and len(group[0][3]) == OCCURRENCE:
                    return
                for places, d0, d1 in repeated(group, length):
                    for k1, k2, p in struct.iter_unpack(_PLACE, places):
                        if p < 0:  # a left half: distances count to the right of its end
                            out.append((k1, k2, -p + d0 - length, -p + d1))
                        elif p < 1 << 62:
                            out.append((k1, k2, p - d1, p - d0 + length))

            for entry in LoserTree([read_run(r) for r in own]):
                if group and entry[0] < shared:
                    done()
                    group = []
                    if len(out) > 50_000:
                        yield _ranges(out)
                        out = []
                if group and entry[0] == len(entry[1]) == len(group[-1][1]) and entry[2] == group[-1][2]:
                    group[-1] = (*group[-1][:3], group[-1][3] + entry[3])  # the same entry from another run
                    continue
                group.append(entry)
            done()
            group = []
            if out:
                yield _ranges(out)
        give_back()

    exchanged = docs.select("k1", "k2", "text").mapInArrow(runs, "part int, run binary")
    return exchanged.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(merge, "k1 long, k2 long, start long, end long")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The runs of each part, from rows sorted by part."""
    now, own = None, []
    for batch in batches:
        for part, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now and own:
                yield own
                own = []
            now = part
            own.append(run)
    if own:
        yield own


def _ranges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["k1", "k2", "start", "end"])


def dedup(docs: DataFrame, *, length: int = 400, gram: int = 48, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Remove from every whole text, as UTF-8 bytes, each byte covered by a `length`-byte string that also starts anywhere
    else in the documents: the id column, n_bytes, n_removed, n_spans, spans (start and end bytes of the removed runs) and kept.

    Strings are judged on the input, never cross documents, and may overlap themselves. What a task holds are the runs of its
    part of the keys. A null text is empty; a text shorter
    than `length` loses nothing; repeated rows are copies of each other; a null id stays null; an empty table gives no rows;
    other columns are ignored, or come along as the struct `row` if `carry`, beside the column
    `text` with what is left of the text (whole characters only).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    others = whole_row(docs.drop(text_col), carry)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(name, text).alias("k1"), F.xxhash64(text, name).alias("k2"), text.alias("text"), *others)
    given = rows.select("k1", "k2", "text")
    packed, bits, sent = survey(given, length, gram)
    context = docs.sparkSession.sparkContext
    known, known_key = context.broadcast(packed), token()
    ranges = checkpointed(duplicate_ranges(given, known, known_key, bits, sent, length=length, gram=gram))
    by_doc = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    # only texts that may have ranges go through the join
    joined, _ = slot_maps(ranges.select(F.lit("docs").alias("name"), F.col("k1").alias("value"), F.lit(0).cast("long").alias("sent")), bits)
    # keys of their own: what duplicate_ranges() has unpacked goes
    shared, key, cut_key = context.broadcast({"docs": empty_map(bits)} | joined), token(), token()

    def kept_back(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        maps: SlotMaps = built(key, lambda: SlotMaps(shared.value, bits), 1 if wanted else 2)  # type: ignore[assignment]
        for batch in batches:
            yield batch.filter(pa.array(maps.has("docs", batch.column(1).to_numpy()) == wanted))

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        for batch in kept_back(batches, True):
            texts = batch.column(3).cast(pa.binary())
            yield batch.set_column(3, "text", pa.array([packer.compress(t.as_py()) for t in texts], pa.binary()))
        give_back()

    def unshuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.list_(pa.int64())
        for batch in kept_back(batches, False):
            no = pa.nulls(batch.num_rows, none)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), no, no, *batch.columns[4:]], names=["id", "text", "starts", "ends", *batch.schema.names[4:]])

    def cut(packed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = batches if packed else unshuffled(batches)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            maps: Maps = built(cut_key, lambda: Maps(known.value, bits), 1 if packed else 2)  # type: ignore[assignment]
            for batch, texts in slices(batches):
                texts = [zstandard.decompress(t) for t in texts] if packed else texts
                spans, kept = [], []
                for t, a, b in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    found: list[list[int]] = []
                    whole = [(h.start, h.end) for h, alone in zip(*maps.halves(t, length, gram), strict=True) if not alone]
                    for x, y in sorted([*zip(a or [], b or [], strict=True), *whole]):
                        if found and x <= found[-1][1]:
                            found[-1][1] = max(found[-1][1], y)
                        else:
                            found.append([x, y])
                    cuts = [0, *(x for r in found for x in r), len(t)]
                    kept.append(b"".join(t[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
                    spans.append([{"start": x, "end": y} for x, y in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), *[pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] * carry, *batch.columns[4:]],
                    names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", *["text"] * carry, *batch.schema.names[4:]],
                )

        return run

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary" + ", text string" * carry
    binary = StructType([StructField("text", BinaryType()) if f.name == "text" else f for f in rows.schema.fields])
    hit = rows.mapInArrow(shuffled, binary).join(by_doc, ["k1", "k2"], "left").select("id", "text", F.col("ranges.start").alias("starts"), F.col("ranges.end").alias("ends"), *["row"] * carry)
    schema = with_fields(schema, hit.schema.fields[4:])
    return hit.mapInArrow(cut(True), schema).unionByName(rows.mapInArrow(cut(False), schema)).withColumnRenamed("id", id_col)


def brute(texts: list[bytes], length: int) -> list[list[bool]]:
    """What is covered, by a table of all strings; for tests."""
    counts: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            k = hashlib.sha1(t[i : i + length]).digest()
            counts[k] = counts.get(k, 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if counts[hashlib.sha1(t[i : i + length]).digest()] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out
