"""All registered queries of the library; importing a query module registers its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.plans import catalogs, documents, profiles, relational, reports, scalars, streams, tables  # noqa: F401
from sheaf.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["dirty_aggregate"](spark, sf_dir)
