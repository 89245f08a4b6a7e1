"""What the operators of this subpackage share: checkpoints, Arrow batches of texts, word rules, hot-group-safe components."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes that end a word of the alphanumeric word rule (ASCII only; every other byte of UTF-8 belongs to a word).
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Lower-cases A-Z, then turns each separator into a blank.
WORD_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)) + bytes(b for b in _SEPARATORS if not 0x41 <= b <= 0x5A), bytes(range(0x61, 0x7B)) + b" " * (len(_SEPARATORS) - 26))
#: Lower-cases A-Z only.
LOWER_TABLE = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: The same word rule on a text that is not yet lower-cased, for offsets into the original.
ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: A batch of rows sent to Python holds about this many bytes of text at most (one longer text still goes alone).
SLICE_BYTES = 2 << 20


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; a folder of our own is set only where that setting is absent and everything runs in
    one process (tests). A cluster without the setting raises: no folder of one machine would do."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not given and not re.match(r"local(\[[^-]*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="sheaf-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives the loss of any executor."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The lineage cut by a compressed table in the checkpoint folder, a fraction of a checkpoint's size for texts."""
    shared_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{token()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def arrow_limits(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that very long texts don't meet in one batch. A session's own lower bounds stay."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        _lower(spark, f"spark.sql.execution.arrow.{name}", most)


def _lower(spark: SparkSession, name: str, most: int) -> None:
    try:
        now = str(spark.conf.get(name))
        if not now.isdigit() or int(now) == 0 or int(now) > most:
            spark.conf.set(name, str(most))
    except Exception as error:  # an older Spark doesn't know the setting; the record limit still holds
        if "maxBytesPerBatch" not in str(error):
            raise


def give_back() -> None:
    """Return freed memory to the system: Python workers live on after their task, several to an executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch cut into runs of about `most` bytes of text, with the texts as bytes (null: empty)."""
    try:
        yield from _slices(batches, column, most)
    finally:
        give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        start, held, values = 0, 0, []
        for i in range(batch.num_rows):
            value = texts[i].as_py() or b""
            values.append(value)
            held += len(value)
            if held >= most:
                yield batch.slice(start, i + 1 - start), values
                start, held, values = i + 1, 0, []
        if values:
            yield batch.slice(start, batch.num_rows - start), values


def whole_row(df: DataFrame, wanted: bool) -> list[Column]:
    """All columns of a row as one struct `row`, if wanted. The text isn't among them: it comes along once, as `text`."""
    return [F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")] if wanted else []


def with_fields(ddl: str, fields: list[StructField]) -> StructType:
    """A schema given as text, and more fields."""
    return StructType([*StructType.fromDDL(ddl).fields, *fields])


def token() -> str:
    """A name under which a worker keeps what it has built from a broadcast."""
    return uuid.uuid4().hex


_BUILT: dict[str, object] = {}


def built(key: str, make: Callable[[], object], keep: int = 1) -> object:
    """What `make` returned in this Python worker before under `key`; a worker keeps the last few only."""
    if key not in _BUILT:
        while len(_BUILT) >= keep:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = make()
    return _BUILT[key]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (a, b: long) as rows (node, root), root being the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum (combined before the shuffle) and an equi-join
    that adaptive execution can split, so one huge component never meets in a task; each round is checkpointed.
    Nodes without an edge don't appear. Empty edges give no rows.
    """

    def minima(directed: DataFrame) -> DataFrame:
        return directed.groupBy("u").agg(F.min("v").alias("m"))

    def state(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(minima(both), "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = down.join(minima(down), "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.unionByName(minima(down).select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
