"""Vocabularies of a corpus by document frequency, and how much of a unit's words they know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.numbers import ratio
from sheaf.functions.text import split_lines
from sheaf.operators.quality import glyph_mapped

#: What a run of letters is, the two-letter words that count as English, and the thresholds of the rules.
LATIN_RUN, DEVANAGARI_RUN = "[A-Za-z]{2,}", r"[ऀ-ॣॱ-ॿ꣠-ꣿ]{2,}"
TWO_LETTERS = "am an as at be by do go he if in is it me my no of on or so to up us we id re ex".split()
LEAST_DOCUMENTS, LEAST_RATE, LEAST_RUNS, LEAST_LENGTH = 3, 0.60, 2, 4
#: Slots of the filter that stands before the join: 16 MB when it is broadcast, whatever the vocabulary's size.
SLOTS = 1 << 27


def runs(text: Column, pattern: str = LATIN_RUN) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def english(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(word, df, acronym_df): lower-case Latin runs that stand in at least `least` documents, outside lines that look like glyphs typed as
    Latin letters. A word of three letters or more needs a vowel, one of two must be a known one, unless it is an acronym (in capitals only,
    two to six of them) in as many documents. A document counts once however many rows it has; null texts have no words."""
    good = F.filter(split_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: ~F.coalesce(glyph_mapped(x), F.lit(False)))
    found = F.array_distinct(F.flatten(F.transform(good, lambda line: runs(line))))
    each = docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))
    by_doc = each.groupBy(F.lower("run").alias("word"), "id").agg(F.max((F.col("run") == F.upper("run")) & (F.length("run") <= 6)).alias("capitals"))
    counted = by_doc.groupBy("word").agg(F.count("*").alias("df"), F.count_if("capitals").alias("acronym_df")).where(F.col("df") >= least)
    known = ((F.length("word") > 2) & F.col("word").rlike("[aeiou]")) | F.col("word").isin(TWO_LETTERS) | (F.col("acronym_df") >= least)
    return counted.where(known)


def devanagari(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(word, df) of Devanagari words of two letters or more in at least `least` documents; digits and dandas belong to none."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(runs(F.col(text), DEVANAGARI_RUN))).alias("word"))
    return each.distinct().groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)) + 1


def filter_of(vocabulary: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of the words' hashes in at most SLOTS / 32768 rows of 4 kB."""
    slots = vocabulary.select(_slot(F.col("word")).alias("slot"))
    return slots.groupBy(F.call_function("bitmap_bucket_number", "slot").alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "slot")).alias("bits"))


def maybe_known(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows whose `word` may be in the vocabulary: all that are, and few others. The bitmap alone is broadcast, never the vocabulary."""
    slotted = words.withColumn("slot", _slot(F.col("word")))
    at = F.call_function("bitmap_bit_position", "slot")
    joined = slotted.withColumn("bucket", F.call_function("bitmap_bucket_number", "slot")).join(F.broadcast(filter_of(vocabulary)), "bucket")
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(bitmap_bit_position(slot) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    return joined.where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).select(words.columns)


def word_rates(units: DataFrame, vocabulary: DataFrame, keys: list[str], *, text: str = "text", pattern: str = LATIN_RUN) -> DataFrame:
    """Of each unit (its `keys` are unique): runs, hits, rate (hits over runs to four places) and confident: whether it surely is of the
    vocabulary's language, by a share of 0.60 of two runs or more, or by a single known run of four letters or more.

    Runs pass a bitmap of the vocabulary first, so unknown words, which are most of a foreign text, aren't shuffled; what is left meets
    the vocabulary in an equi-join on the word. A null text has no runs and isn't confident.
    """
    given = units.select(*keys, F.transform(runs(F.col(text), pattern), lambda w: F.lower(w)).alias("words"))
    each = given.select(*keys, F.explode("words").alias("word"))
    hits = maybe_known(each, vocabulary.select("word")).join(vocabulary.select("word"), "word").groupBy(*keys).agg(F.count("*").alias("hits"))
    facts = given.select(*keys, F.size("words").cast("long").alias("runs"), F.length(F.get("words", F.lit(0))).alias("first"))
    out = facts.join(hits, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("rate", ratio(F.col("hits"), F.col("runs")))
    confident = F.when(F.col("runs") >= LEAST_RUNS, F.col("rate") >= LEAST_RATE).otherwise(F.coalesce((F.col("hits") == 1) & (F.col("first") >= LEAST_LENGTH), F.lit(False)))
    return out.select(*keys, "runs", "hits", "rate", confident.alias("confident"))


def fingerprint(vocabulary: DataFrame, version: str) -> DataFrame:
    """One row (words, fingerprint): identity of the set of words under a version, whatever the order of rows. Four sums of parts of each word's
    SHA-256 are added up where the rows are, so no list of words is ever in one place."""
    h = F.sha2("word", 256)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"x{i}") for i in range(4)]
    added = vocabulary.select("word").distinct().agg(F.count("*").alias("words"), *lanes)
    parts = [F.lit(version), F.col("words").cast("string"), *[F.coalesce(F.col(f"x{i}").cast("string"), F.lit("0")) for i in range(4)]]
    return added.select("words", F.sha2(F.concat_ws("\x1f", *parts), 256).alias("fingerprint"))
