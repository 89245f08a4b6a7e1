"""The thin queries over the operators of this subpackage, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import audit, bpe, chat, decontam, langid, licenses, media, phrases, quality, simhash, substring, suffix, toxicity
from sheaf.plans.registry import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; documents, which cost the most work by row, at least a task to a core."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name == "documents" else read


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("op9_decontaminate", decontam.DECONTAMINATE_SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def language(docs: DataFrame) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out(4, 2)))
    return langid.predict(docs, model)


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op6_media")
def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read(media.store(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(
        ";", F.concat(F.lit("pid="), "pid"), F.concat(F.lit("type="), "stream_type"), F.concat(F.lit("packets="), "n_packets"), F.concat(F.lit("errors="), "continuity_errors"), F.concat(F.lit("pes="), F.size("pts")),
        F.concat(F.lit("first="), F.element_at("pts", 1)), F.concat(F.lit("last="), F.element_at("pts", -1)), F.concat(F.lit("access="), F.size("access_points")),
    )
    return found.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


@query("op5_chat", chat.MAXIMAL_SQL)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.where(~langid.held_out(5, 0)))
    return toxicity.score(docs, index).select("doc_id", langid.held_out(5, 0).alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_substring_dedup", substring.DEDUP_SQL)
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_filter_audit", audit.AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_phrases", phrases.PHRASES_SQL)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
