"""Batches for Python are bounded by rows and bytes."""

from __future__ import annotations

import pyarrow as pa

from sheaf.operators import batches
from sheaf.sources import web


def test_pages_go_in_bounded_batches(spark):
    names = [f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    for name in names:
        spark.conf.unset(name)
    pages = spark.range(3000).selectExpr("id AS page_id", "'http://a.b/' AS url", "concat('<p>', repeat('x', 5000), id, '</p>') AS html")
    parsed = web.parse_pages(pages)
    assert [int(spark.conf.get(n)) for n in names] == [batches.MOST_ROWS, batches.MOST_BYTES]
    assert parsed.where("page.text = concat(repeat('x', 5000), page_id)").count() == 3000


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4, 5], "text": ["aa", None, "bbbbbb", "", "c"]})
    found = [p.column("id").to_pylist() for p in batches.pieces(iter([batch]), "text", 4)]
    assert found == [[1, 2, 3], [4, 5]]
