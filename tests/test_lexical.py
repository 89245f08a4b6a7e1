"""Cover density against stated cases and a plain search for minimal intervals."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from sheaf.operators import lexical, retrieval


def plain(text, query):
    """Sum over minimal intervals of 0.1 over one more than the foreign words in it."""
    words = re.findall("[a-z0-9]+", text.lower())
    terms = set(re.findall("[a-z0-9]+", query.lower())) - set(retrieval.STOPWORDS)
    at = [i for i, w in enumerate(words) if w in terms]
    holds = [(a, b) for a, b in itertools.combinations_with_replacement(at, 2) if {words[i] for i in at if a <= i <= b} == terms]
    least = [(a, b) for a, b in holds if not any((c, d) != (a, b) and a <= c and d <= b for c, d in holds)]
    return round(sum(0.1 / (1 + (b - a) - (sum(a <= i <= b for i in at) - 1)) for a, b in least), 9)


@pytest.mark.parametrize("query", ["red fox", "red fox hen", "fox", "red red fox", "the"])
def test_against_minimal_intervals(spark, query):
    rng = random.Random(query)
    docs = [(i, " ".join(rng.choices(["red", "fox", "hen", "the", "owl"], k=rng.randrange(0, 25)))) for i in range(40)] + [(90, None), (91, ""), (92, "Red! fox")]
    index = lexical.postings(spark.createDataFrame(docs, "doc_id long, text string"), id_col="doc_id", text="text", stem=lambda w: w)
    found = lexical.search(index, spark.createDataFrame([(1, query)], "query_id long, text string"), 100, stem=lambda w: w).collect()
    terms = set(query.split()) - {"the"}
    expected = {i: plain(t, query) for i, t in docs if t and terms and terms <= set(re.findall("[a-z0-9]+", t.lower()))}
    assert {r["id"]: r["lexical_score"] for r in found} == expected
    assert [r["id"] for r in sorted(found, key=lambda r: r["lexical_rank"])] == sorted(expected, key=lambda i: (-expected[i], i))


def test_stems_pool_and_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "queries of glasses"), (2, "a query; the glass bus"), (3, "query"), (4, "query glass query glass")], "doc_id long, text string")
    lexical.save(lexical.postings(docs, id_col="doc_id", text="text"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    queries = spark.createDataFrame([("a", "Query of glass"), ("b", "query"), ("c", "nothing here"), ("d", "the of")], "query_id string, text string")
    found = lexical.search(index, queries, 2).collect()
    assert sorted((r["query_id"], r["lexical_rank"], r["id"], r["lexical_score"]) for r in found) == [("a", 1, 4, 0.3), ("a", 2, 2, 0.05), ("b", 1, 4, 0.2), ("b", 2, 1, 0.1)]


def test_no_job_while_the_plan_is_built(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "fox")], "doc_id long, text string")
    tracker, group = spark.sparkContext.statusTracker(), "plan only"
    spark.sparkContext.setJobGroup(group, "")
    lexical.search(lexical.postings(docs, id_col="doc_id", text="text"), docs.withColumnRenamed("doc_id", "query_id"), 5)
    retrieval.lexical(docs, "Red, the FOX", 5, id_col="doc_id", text="text")
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_index_without_shuffle_and_rows_of_one_document(spark, monkeypatch):
    """An index is made where the texts lie; rows that share an id are one document; queries of the same words have the same answer, however cut."""
    docs = spark.createDataFrame([(1, "red fox"), (2, "fox hens red"), (2, "hen red"), (None, "red fox"), (3, "fox")], "doc_id long, text string")
    index = lexical.postings(docs, id_col="doc_id", text="text")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    queries = spark.createDataFrame([(i, ["red fox", "Fox, the red"][i % 2]) for i in range(50)] + [(99, "hen")], "query_id long, text string")
    monkeypatch.setattr(lexical, "BLOCKS", 3)
    found = [(r["query_id"], r["id"], r["lexical_score"]) for r in lexical.search(index, queries, 5).collect()]
    assert {q: sorted((str(i), s) for p, i, s in found if p == q) for q in (0, 1, 49)} == dict.fromkeys((0, 1, 49), [("1", 0.1), ("2", 0.1), ("None", 0.1)])
    assert [(i, s) for q, i, s in found if q == 99] == [(2, 0.2)]
