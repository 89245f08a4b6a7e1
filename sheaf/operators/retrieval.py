"""Hybrid retrieval: exact nearest vectors and lexical matches, fused by reciprocal rank, thresholded, or none."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.numbers import cosine_distance, reciprocal_rank
from sheaf.operators.quality import STOPWORDS


def _ranked(top: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ranks of the few rows that a limit has left; the window stands above the limit, so the limit is a distributed top-k."""
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def dense(chunks: DataFrame, query: list[float] | DataFrame, pool: int, *, id_col: str, vector: str) -> DataFrame:
    """The `pool` nearest chunks by cosine distance: id, distance, dense_rank. The query is a list, or the one vector of a frame of one row
    and column, which becomes a scalar subquery (more rows are an error when it runs, none finds nothing)."""
    own = chunks.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    q = query.toDF("q").scalar() if isinstance(query, DataFrame) else F.array(*[F.lit(float(x)) for x in query])
    near = own.withColumn("q", q).select("id", cosine_distance(F.col("v"), F.col("q")).alias("distance")).where("distance is not null")
    return _ranked(near.orderBy("distance", "id").limit(pool), [F.col("distance"), F.col("id")], "dense_rank")


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOPWORDS))


def _is(word: str):
    return lambda x: x == word


def lexical(chunks: DataFrame, query: str, pool: int, *, id_col: str, text: str) -> DataFrame:
    """The best `pool` chunks that hold all words of the query: id, lexical_score, lexical_rank. The score is the sum over the words of
    (1 + ln tf) * ln((N + 1) / df), over 1 + ln of the chunk's words. (The reference's stemmed cover density has no equal here.)"""
    terms = list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", query.lower()) if w not in STOPWORDS))
    if not terms:
        return chunks.sparkSession.createDataFrame([], "id long, lexical_score double, lexical_rank int")
    own = chunks.select(F.col(id_col).alias("id"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    tf = [F.size(F.filter("w", _is(t))) for t in terms]
    counted = own.select("id", F.size("w").alias("n"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])
    stats = counted.agg(F.count("*").alias("docs"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    counted = counted.crossJoin(F.broadcast(stats))  # one row
    score = sum(((1 + F.ln(F.col(f"tf{i}"))) * F.ln((F.col("docs") + 1) / F.greatest(F.lit(1), F.col(f"df{i}"))) for i in range(len(terms))), F.lit(0.0)) / (1 + F.ln("n"))
    every = F.expr(" and ".join(f"tf{i} > 0" for i in range(len(terms))))
    top = counted.where(every).select("id", F.round(score, 9).alias("lexical_score")).orderBy(F.desc("lexical_score"), "id").limit(pool)
    return _ranked(top, [F.desc("lexical_score"), F.col("id")], "lexical_rank")


def fuse(dense_top: DataFrame, lexical_top: DataFrame, n: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the two short lists."""
    both = dense_top.join(lexical_top, "id", "full").withColumn("rrf", F.round(reciprocal_rank(F.col("dense_rank"), k) + reciprocal_rank(F.col("lexical_rank"), k), 12))
    return _ranked(both.orderBy(F.desc("rrf"), "id").limit(n), [F.desc("rrf"), F.col("id")], "rrf_rank")


def search(chunks: DataFrame, query_vector: list[float], query_text: str, *, department: object, pool: int = 50, n: int = 20, id_col: str = "chunk_id", vector: str = "embedding", text: str = "content", scope: str = "department_id") -> DataFrame:
    """The whole search within one department; the scope is a predicate of this function, pushed down to the scan."""
    own = chunks.where(F.col(scope) == F.lit(department))
    fused = fuse(dense(own, query_vector, pool, id_col=id_col, vector=vector), lexical(own, query_text, pool, id_col=id_col, text=text), n)
    return fused.join(own.withColumnRenamed(id_col, "id"), "id")


def decide(scored: DataFrame, *, threshold: float, top_k: int, by: list[str], score: str = "score", rank: str = "rrf_rank") -> DataFrame:
    """Per question, candidates at or above the threshold, best first (ties as fusion ranked them), at least one place; adds kept and
    abstained (no candidate reached the threshold)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), rank)
    passed = F.col(score) >= threshold
    return scored.withColumn("kept", passed & (F.row_number().over(w) <= max(1, top_k))).withColumn("abstained", ~F.max(passed).over(Window.partitionBy(*by)))


def sources(cited: DataFrame) -> DataFrame:
    """Documents behind (turn_id, ord, document_id, page, recovered): in order of first citation, with sorted distinct pages."""
    docs = cited.groupBy("turn_id", "document_id").agg(F.min("ord").alias("ord"), F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"), F.max("recovered").alias("any_recovered"))
    return docs.withColumn("place", F.row_number().over(Window.partitionBy("turn_id").orderBy("ord", "document_id")))
