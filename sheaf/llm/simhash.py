"""SimHash near-duplicates: segment-popcount embedding, grid range-join on its Manhattan distance, exact check."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.common import LOWER_TABLE, arrow_limits, checkpointed, components, slices

#: A cell of more points than this is cut into finer cells.
DENSE_CELL = 5_000
#: Buckets up to this size are compared pair by pair in whole-array steps; larger ones by breadth-first search.
SMALL_BUCKET = 48


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words of the lower-cased text (the whole sequence if it is shorter)."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = memoryview(b" ".join(words))
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, width: int = 4) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, width)
    counts, step = np.zeros(64, np.int64), 1 << 14
    for k in range(0, len(hashes), step):
        counts += np.unpackbits(hashes[k : k + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 4, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """The id column and fp (long, two's complement of the 64 bits) per input row; null and wordless texts have 0. With `key_col`
    also that column, a long, as row_key."""
    arrow_limits(docs.sparkSession)
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(key_col).alias("row_key")] if key_col else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]], names=["id", "fp", *batch.schema.names[2:]])

    return frame.mapInArrow(run, f"id {frame.schema['id'].dataType.simpleString()}, fp long" + ", row_key long" * (key_col is not None)).withColumnRenamed("id", id_col)


def block_masks(coordinates: list[int], blocks: int) -> list[int]:
    """Masks of the 2-bit segments of consecutive runs of coordinates."""
    cuts = [round(len(coordinates) * i / blocks) for i in range(blocks + 1)]
    return [sum(3 << 2 * c for c in coordinates[a:b]) for a, b in itertools.pairwise(cuts)]


def grid(n: int, distance: int) -> list[int]:
    """Masks of the cells of the grid, each a choice of coordinate blocks of the embedding.

    The embedding has 32 coordinates, the bit counts of 2-bit segments. Split into distance + s blocks, two vectors
    within the distance agree on at least s whole blocks, so each choice of s blocks is a grid of width-1 cells; s grows
    with the number of points, so that a cell's expected load stays bounded.
    """
    s = 2 if n < 20_000_000 else 3 if n < 2_000_000_000 else 4
    return [sum(choice) for choice in itertools.combinations(block_masks(list(range(32)), distance + s), s)]


def finer(mask: int, distance: int) -> list[int]:
    """Masks of the finer cells of a cell: its other coordinates split into distance + 1 blocks, of which two vectors within the
    distance agree on one. None where so few are left that the cell holds a few hundred points at most."""
    free = [c for c in range(32) if not mask >> 2 * c & 3]
    return [mask | m for m in block_masks(free, distance + 1)] if len(free) > distance else []


def link_cell(points: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect all points of one cell that are connected by distances up to `distance`: breadth-first, so a
    dense group costs about its size, and no more links than points come out."""
    left, links = points, []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            a = front.pop()
            near = np.flatnonzero(manhattan(bit_counts(left), bit_counts(a)) <= distance)
            near = near[np.bitwise_count(left[near] ^ a) <= distance]
            if len(near):
                found = left[near]
                links += [(int(a), int(b)) for b in found]
                front += list(found)
                left = np.delete(left, near)
    return links


def bit_counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of the 2-bit segments, packed in place."""
    return x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of two packed embeddings: the sum over segments of |difference| (each 0 to 2)."""
    low = np.uint64(0x5555555555555555)
    # counts 0, 1, 2: differing low bits are a difference of 1, differing high bits with equal low bits one of 2
    x = a ^ b
    odd, high = x & low, (x >> np.uint64(1)) & low
    return np.bitwise_count(odd).astype(np.int64) + 2 * np.bitwise_count(high & ~odd)


def _verify(distance: int):
    def links(cells: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows sorted by cell."""
        edges = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
        sizes = np.diff(edges)
        a_out, b_out = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        big = sizes > SMALL_BUCKET
        for k in np.flatnonzero(big):
            if found := link_cell(points[edges[k] : edges[k + 1]], distance):
                pairs = np.array(found, np.uint64)
                a_out.append(pairs[:, 0])
                b_out.append(pairs[:, 1])
        small = np.repeat(~big, sizes)
        cells, points = cells[small], points[small]
        embedded = bit_counts(points)
        at = np.arange(len(cells))
        for step in range(1, SMALL_BUCKET):
            at = at[at + step < len(cells)]
            at = at[cells[at] == cells[at + step]]
            if not len(at):
                break
            near = at[manhattan(embedded[at], embedded[at + step]) <= distance]
            near = near[np.bitwise_count(points[near] ^ points[near + step]) <= distance]
            a_out.append(points[near])
            b_out.append(points[near + step])
        return np.concatenate(a_out), np.concatenate(b_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(parts):
            cells, points = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = links(cells, points)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            cells, points = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(cells):
                continue
            cut = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on in the next batch
            if cut:
                held.append((cells[:cut], points[:cut]))
                if sum(len(x[0]) for x in held) > 100_000:
                    yield out(held)
                    held = []
                elif held:
                    yield out(held)
                    held = []
            held.append((cells[cut:], points[cut:]))
        if held:
            yield out(held)

    return run


def links(points: DataFrame, *, distance: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span every group connected at <= distance bits.

    Cells of more than DENSE_CELL points are cut into finer ones, again and again, so no task gets an unbounded cell.
    """
    points = points.select("fp").distinct()
    arrow_limits(points.sparkSession)
    low = "6148914691236517205L"  # the low bit of each segment; counts as in bit_counts(), without a difference that could overflow
    embedded = f"((fp ^ shiftrightunsigned(fp, 1)) & {low}) | shiftleft(fp & shiftrightunsigned(fp, 1) & {low}, 1)"

    def spread(frame: DataFrame, masks: DataFrame) -> DataFrame:
        cell = F.xxhash64("mask", F.expr(f"({embedded})").bitwiseAND(F.col("mask")))
        return frame.join(F.broadcast(masks), "above").select("mask", cell.alias("cell"), "fp")

    def table(pairs: list[tuple[int, int]]) -> DataFrame:
        """Of a mask and the finer masks in it; at most a few to a dense cell, and at first the grid."""
        return points.sparkSession.createDataFrame([tuple(m - (1 << 64) if m >> 63 else m for m in pair) for pair in pairs], "above long, mask long")

    rows, done = spread(points.withColumn("above", F.lit(0).cast("long")), table([(0, m) for m in grid(points.count(), distance)])), []
    while True:
        dense = checkpointed(rows.groupBy("mask", "cell").agg(F.count("*").alias("n")).where(F.col("n") > DENSE_CELL).select("mask", "cell"))
        masks = [(m, x) for r in dense.select("mask").distinct().collect() for m in [r["mask"] % (1 << 64)] for x in finer(m, distance)]
        dense = dense.join(F.broadcast(table(masks).select(F.col("above").alias("mask")).distinct()), "mask", "left_semi")
        if not masks:
            done.append(rows)
            break
        done.append(rows.join(dense, ["mask", "cell"], "left_anti"))
        hot = rows.join(dense, ["mask", "cell"], "left_semi").select(F.col("mask").alias("above"), "fp")
        rows = checkpointed(spread(hot, table(masks)).distinct())
    done = functools.reduce(DataFrame.unionByName, done)
    return done.select("cell", "fp").repartition("cell").sortWithinPartitions("cell").mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per document with its fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over
    links of at most `distance` differing bits; with `key_col` (a long) also that column, as row_key, and the component's own name, component.

    Equal fingerprints collapse before the join (a grouped minimum, combined before the shuffle), so exact copies never
    meet as pairs; a cell of the grid yields spanning links only, and its rows are 16 bytes each. Null and empty texts have
    fingerprint zero and link like any other; a null id stays null and is passed over as a smallest id (a component of null ids
    has a null component_id); repeated rows give repeated results; empty tables give no rows; other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, width=width, id_col=id_col, text_col=text_col, key_col=key_col))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(distinct, distance=distance)).toDF("fp", "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id", F.col("root").alias("component"))
    found = prints.join(named, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", *["row_key"] * (key_col is not None))
    return found if key_col else found.drop("component")
