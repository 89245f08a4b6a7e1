"""Writers: delimited text, content-addressed blobs, staged replacement, manifests and event lines."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import storage_key


def write_csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.csv(path, header=True, sep=separator, quote='"', escape='"', mode="errorifexists")


def store_blobs(files: DataFrame, path: str, content: str = "content", extension: str = "extension") -> None:
    """Blobs once each under their digest, dealt over 256 folders by its first byte."""
    sha = F.sha2(content, 256)
    blobs = files.select(sha.alias("sha256"), storage_key(sha, F.col(extension)).alias("key"), F.col(content).alias("content"), F.substring(sha, 1, 2).alias("prefix")).dropDuplicates(["sha256"])
    blobs.write.partitionBy("prefix").parquet(path, mode="append")


def unverified(blobs: DataFrame) -> DataFrame:
    """Blobs whose content no longer has its digest."""
    return blobs.where(F.sha2("content", 256) != F.col("sha256"))


def event_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def selection_digest(keys: DataFrame, column: str) -> str:
    """A digest of a set of keys that doesn't depend on their order; for selections, whose size is bounded."""
    ordered = [r[0] for r in keys.select(column).distinct().orderBy(column).collect()]
    return hashlib.sha256("\n".join(map(str, ordered)).encode()).hexdigest()


def manifest(df: DataFrame, facts: dict) -> str:
    """Sorted, indented JSON of facts and of the rows of a small report."""
    return json.dumps(facts | {"rows": [r.asDict(recursive=True) for r in df.collect()]}, sort_keys=True, indent=2, default=str)
