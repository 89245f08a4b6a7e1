"""Corpus pipeline: language ID, near-dedup, repeated passages, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontam, langid, queries, simhash, suffix
from sheaf.llm.common import checkpointed


def column(name: str, of: str = "") -> Column:
    """A column by its whole name, whatever signs it holds; of the struct `of`, if given."""
    return F.col(f"{of}." * bool(of) + "`" + name.replace("`", "``") + "`")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of docs has, upper and lower case alike."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too), or in which no language holds half of the letters, go; `lang` becomes the language
    found (ties: the first by name). Repeated rows have one fate; an empty table stays empty."""
    model = langid.train(docs.where(~langid.held_out(4, 2)))
    found = langid.predict(docs, model, carry=True).where("lang_pred <> 'und' and score >= 0.5")
    return found.select([F.col("lang_pred").alias("lang") if c == "lang" else F.col("text") if c == "text" else column(c, "row") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: the one with the smallest id (nulls last; then by a hash), once. Null and empty
    texts are near-duplicates of each other. Rows are the same only if two hashes say so."""
    key, other = fresh(docs, "row_key", "row_check")
    name, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(name, text)).withColumn(other, F.xxhash64(text, name))
    found = simhash.near_duplicates(keyed.select("doc_id", "text", F.col(key).alias("row_key")), key_col="row_key")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_key").alias("kept"))).alias("least")
    kept = found.groupBy("component").agg(least).select(F.col("least.kept").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key, other]).select([column(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that also start elsewhere go from the texts, n_chars follows; every document stays, a null text as an empty one. Repeated rows
    are copies of each other and lose what is long enough."""
    cut = suffix.dedup(docs, carry=True)
    return cut.select([F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else column(c, "row") for c in docs.columns])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts hold no words and stay, as all do if the benchmark is empty."""
    found = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True).where("not contaminated")
    return found.select([F.col("text") if c == "text" else column(c, "row") for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of what is left, and of the bytes that they stand for; a null text is empty; a row for each row."""
    return queries.bpe_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("token_ids", token_ids),
]

#: SQL can express none of the first three stages; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, cut by a reliable checkpoint after each but the last two (which only map)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 2:
            docs = checkpointed(docs)
    return docs
