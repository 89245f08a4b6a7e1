"""Byte-level BPE on padded numpy matrices: every row merges its leftmost minimum-rank pair each round."""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import arrow_limits, built, slices

NONE = np.int32(0x7FFFFFFF)
#: A worker forgets the words it has encoded beyond this many bytes, counted as their characters and KEPT_EACH bytes to a word.
KEPT_BYTES, KEPT_EACH = 16 << 20, 160


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


class Numbered(dict):
    """Numbers each key by the order in which keys were first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of the pattern. For texts within the basic plane, letters, numbers and white space are spelled out as
    ranges, which the plain re module scans faster; other texts, or a pattern with other classes, run as they are."""
    spelled, whole = pattern, regex.compile(pattern).findall
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        ranges = "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(name + "+", every))
        spelled = re.sub(r"\[\^?[^\]]*\]", lambda m, n=name, r=ranges: m[0].replace(n, r), spelled)
        spelled = spelled.replace(name, f"[{ranges}]")
        if name == r"\s":
            spelled = spelled.replace(r"\S", f"[^{ranges}]")
    if re.search(r"\\[pPX]", spelled):
        return whole
    plain, beyond = re.compile(spelled).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: whole(text) if beyond(text) else plain(text)


class PairTable:
    """Open addressing from (left id, right id) to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        bits = max(4, int(len(pairs) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        at = self._slot(keys)
        while len(keys):  # each slot takes one of those that want it, the others go on to the next slot
            free = self.keys[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NONE where a pair doesn't merge or an id is padding (below 0)."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) << 32 | right[todo]
        at = self._slot(keys)
        while len(todo):
            here = self.keys[at]
            hit = here == keys
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (here >= 0)
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.table = PairTable(self.ranks)
        self.bytes_ = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.split = splitter(pattern)
        size = max(self.ranks.values()) + 1
        self.pieces: list[bytes | None] = [None] * size
        for word, rank in self.ranks.items():
            self.pieces[rank] = word
        self._forget()

    def _forget(self) -> None:
        self.known, self.held = Numbered(), 0
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after another, and how many each word has, by rounds over length-bucketed matrices."""
        sizes = np.ones(len(words), np.int64)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.int32))]
        todo = np.flatnonzero(whole < 0)
        bucket = np.ceil(np.log2(np.maximum(lengths[todo], 4))).astype(np.int64)
        for power in np.unique(bucket):
            rows = todo[bucket == power]
            step = max(1, (1 << 19) >> int(power))
            for k in range(0, len(rows), step):
                self._merge_bucket(words, rows[k : k + step], lengths, sizes, parts)
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        for rows, ids in parts:
            flat[spread(starts[rows], sizes[rows])] = ids
        return flat, sizes

    def _merge_bucket(self, words: list[bytes], rows: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, parts: list) -> None:
        lengths = lengths[rows]
        width = int(lengths.max())
        ids = np.full((len(rows), width + 1), -1, np.int32)
        inside = np.arange(width + 1)[None, :] < lengths[:, None]
        ids[inside] = self.bytes_[np.frombuffer(b"".join(words[i] for i in rows.tolist()), np.uint8)]
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        which = rows
        while len(which):
            best = ranks.argmin(1)
            line = np.arange(len(which))
            low = ranks[line, best]
            done = low == NONE
            if done.any():
                sizes[which[done]] = lengths[done]
                parts.append((which[done], ids[done][np.arange(ids.shape[1])[None, :] < lengths[done][:, None]]))
                go = ~done  # compaction: finished rows leave the matrix, and the matrix narrows to the longest row left
                ids, ranks, which, lengths, best, low = ids[go], ranks[go], which[go], lengths[go], best[go], low[go]
                if not len(which):
                    break
                wide = int(lengths.max())
                ids, ranks = ids[:, : wide + 1], ranks[:, :wide]
                line = np.arange(len(which))
            if len(which) == 1:  # one long row: shift in place
                b = int(best[0])
                ids[0, b + 1 : -1] = ids[0, b + 2 :]
                ranks[0, b:-1] = ranks[0, b + 1 :]
                ranks[0, -1] = NONE
            else:
                after = np.arange(ids.shape[1] - 1)[None, :] > best[:, None]
                np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=after)
                after = np.arange(ranks.shape[1] - 1)[None, :] >= best[:, None]
                np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=after)
                ranks[:, -1] = NONE
            ids[line, best] = low
            ids[:, -1] = -1
            lengths = lengths - 1
            ranks[line, best] = self.table.find(low, ids[line, best + 1])
            left = np.flatnonzero(best > 0)
            if len(left):
                ranks[left, best[left] - 1] = self.table.find(ids[left, best[left] - 1], low[left])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; each match of the pattern is merged on its own, once per distinct match."""
        if self.held > KEPT_BYTES:
            self._forget()
        known, before = self.known, len(self.known)
        coded = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in map(self.split, texts)]
        if len(known) > before:
            new = [w.encode("utf-8", "surrogatepass") for w in itertools.islice(known, before, None)]
            self.held += sum(map(len, new)) + KEPT_EACH * len(new)
            flat, sizes = self.merge(new)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat])
        return [self.flat[spread(self.starts[codes], self.starts[codes + 1] - self.starts[codes])] for codes in coded]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Every whole text as token ids: the id column, n_tokens and ids (little-endian unsigned 32-bit integers, packed); with
    `decoded` also the bytes that those ids stand for, in the same worker, which has the token table already.

    A row per input row and no shuffle. A null text counts as empty and gives no ids; a null id stays null; repeated
    rows give repeated results. `path` must be readable on every executor. Other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    frame = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).toDF("id", "text")
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = built(f"bpe {path} {pattern}", lambda: Codec(path, pattern))
        for batch, texts in slices(batches, most=1 << 20):
            ids = codec.encode([t.decode("utf-8", "replace") for t in texts])
            packed = [x.astype("<u4").tobytes() for x in ids]
            back = [pa.array([codec.decode(np.frombuffer(x, "<u4")) for x in packed], pa.binary())] * decoded
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(packed, pa.binary()), *back], names=["id", "n_tokens", "ids", *["decoded"] * decoded])

    return frame.mapInArrow(run, f"id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the packed ids stand for as `out_col`; null ids give null."""
    arrow_limits(encoded.sparkSession)
    out = encoded.drop(out_col).schema.add(out_col, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = built(f"bpe {path} {pattern}", lambda: Codec(path, pattern))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids_col))
            for start in range(0, batch.num_rows, 500):
                texts = [None if (v := x.as_py()) is None else codec.decode(np.frombuffer(v, "<u4")) for x in column.slice(start, 500)]
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out_col])

    return encoded.drop(out_col).mapInArrow(run, out)
