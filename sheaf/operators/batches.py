"""Arrow batches for Python that are bounded by bytes as well as by rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import SparkSession

#: Rows and bytes of a batch sent to Python, and bytes of text that are worked on at once.
MOST_ROWS, MOST_BYTES, PIECE_BYTES = 1000, 4 << 20, 1 << 20


def bounded(spark: SparkSession) -> None:
    """Lower the session's limits of an Arrow batch, so that many long texts never meet in one; limits that are lower already stay."""
    for name, most in (("maxRecordsPerBatch", MOST_ROWS), ("maxBytesPerBatch", MOST_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch cut into runs of rows with about `most` bytes in a column of text; one longer text goes alone."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            held += n
            if held >= most:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)
