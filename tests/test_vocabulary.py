"""Vocabularies, word rates and the filter before the join."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf.operators import vocabulary


def rates(spark, lines, words):
    units = spark.createDataFrame(list(enumerate(lines)), "id long, text string")
    known = spark.createDataFrame([(w,) for w in words] or [], "word string")
    return {r["id"]: (r["runs"], r["hits"], r["rate"], r["confident"]) for r in vocabulary.word_rates(units, known, ["id"]).collect()}


def test_rates_and_the_two_rules(spark):
    lines = ["Annual Report of banks", "bank zzz xxx", "Turnover", "abc", "Turnover1 x", "zzz", "", None, "bank bank qqq"]
    found = rates(spark, lines, ["annual", "report", "of", "banks", "bank", "turnover", "abc"])
    assert found == {
        0: (4, 4, 1.0, True), 1: (3, 1, 0.3333, False), 2: (1, 1, 1.0, True), 3: (1, 1, 1.0, False), 4: (1, 1, 1.0, True), 5: (1, 0, 0.0, False), 6: (0, 0, 0.0, False), 7: (0, 0, 0.0, False), 8: (3, 2, 0.6667, True),
    }
    assert rates(spark, ["bank report"], []) == {0: (2, 0, 0.0, False)}


def test_english_admission(spark):
    docs = [(i, "The rates of NGR and plain words by it\ntyf fi Qx") for i in range(3)] + [(9, "single"), (9, "single"), (9, "single"), (10, None)]
    found = {r["word"]: (r["df"], r["acronym_df"]) for r in vocabulary.english(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {"the": (3, 0), "rates": (3, 0), "of": (3, 0), "ngr": (3, 3), "and": (3, 0), "plain": (3, 0), "words": (3, 0), "by": (3, 0), "it": (3, 0)}


def test_glyph_lines_teach_nothing(spark):
    line = "kZgf xNtR vbMk qwRt zxPl"  # letters in mixed case, no vowels to speak of
    docs = spark.createDataFrame([(i, f"{line}\nplain words here") for i in range(3)], "doc_id long, text string")
    assert {r["word"] for r in vocabulary.english(docs).collect()} == {"plain", "words", "here"}


def test_devanagari_words(spark):
    docs = spark.createDataFrame([(i, "नेपाल राष्ट्र २०७६ । क") for i in range(3)], "doc_id long, text string")
    assert {r["word"]: r["df"] for r in vocabulary.devanagari(docs).collect()} == {"नेपाल": 3, "राष्ट्र": 3}
    units = spark.createDataFrame([(1, "नेपाल बैंक")], "id long, text string")
    assert vocabulary.word_rates(units, vocabulary.devanagari(docs), ["id"], pattern=vocabulary.DEVANAGARI_RUN).first()["rate"] == 0.5


@pytest.mark.parametrize("slots", [1 << 27, 1 << 16])
def test_filter_loses_no_known_word(spark, monkeypatch, slots):
    monkeypatch.setattr(vocabulary, "SLOTS", slots)
    known = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("word"))
    every = spark.range(20000).select(F.concat(F.lit("w"), "id").alias("word"))
    passed = vocabulary.maybe_known(every, known)
    assert passed.join(known, "word").count() == 5000
    assert passed.count() < (5010 if slots > 1 << 20 else 7000)


def test_fingerprint_is_of_the_set(spark):
    def of(words, version="1"):
        return vocabulary.fingerprint(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), version).first()

    assert of(["a", "b", "c"]) == of(["c", "a", "b", "a"]) and of(["a", "b", "c"])["words"] == 3
    assert len({of(["a", "b"])["fingerprint"], of(["a", "c"])["fingerprint"], of(["a", "b"], "2")["fingerprint"], of(["ab"])["fingerprint"]}) == 4


def test_vocabulary_is_made_once(spark, sf):
    from sheaf.plans import documents

    assert "capitals" not in documents.english_lines(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
