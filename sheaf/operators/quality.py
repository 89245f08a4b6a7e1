"""Text metrics and rule-based verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sheaf.functions.numbers import let, ratio
from sheaf.operators import measures
from sheaf.operators.batches import bounded, pieces

#: Words and thresholds of the verdicts.
STOPWORDS = "the of and to in a for is on that by with as at from be this it are or an was shall which not have has been will may all such any".split()
MAX_DEVANAGARI, MIN_LATIN, MIN_TOKENS, LINE_MIN_TOKENS = 0.01, 0.35, 50, 4
MIN_VOWELLESS, MIN_SYMBOL, MIN_CASE_SWITCH, LINE_RATIO = 0.30, 0.15, 0.10, 0.20
MAX_REPLACEMENT, MAX_CONTROL, MIN_PRINTABLE = 0.005, 0.01, 0.95
COVERAGE_NEEDS_OCR, COVERAGE_SUSPICIOUS, COVERAGE_WARN, MIN_CHARS_PER_PAGE = 0.10, 0.60, 0.90, 50
UNSUPPORTED = ["office_legacy", "archive", "web", "unknown"]
_EDGES = r""".,;:!?()\[\]{}"'`—–-"""
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_DEVANAGARI = r"[\u0900-\u097f\ua8e0-\ua8ff]"
_SWITCH = r"\p{Ll}\p{Lu}"
_WORD = r"\p{L}\p{N}\p{Mn}\p{Mc}"
#: Patterns that match whole tokens of a kind in a spaced text (see spaced()), each in one pass, without looking back.
ALPHA, VOWELLESS = " [A-Za-z]{3,}(?= )", " [B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{3,}(?= )"
SWITCHED = f" [^ ]*?{_SWITCH}[^ ]*"
#: The first sign after the first letter that isn't outer punctuation, with something else behind it.
SYMBOLIC = f" [{_EDGES}]*+[^ {_EDGES}][{_WORD}]*+[^ {_WORD}][^ ]*[^ {_EDGES}][^ ]*"
#: Tokens that are none of VOWELLESS, SWITCHED and SYMBOLIC, which are most: one capital at most, lower case with a vowel, ASCII punctuation behind.
PLAIN = r" (?=[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]*+[AEIOUaeiou])[A-Z]?[a-z]*+[.,;:!?]*+(?= )"


def spaced(c: Column) -> Column:
    """One blank before, between and after the tokens, and no other white space."""
    return F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), f"[{_SPACE}]+", " ")


def unusual(x: Column) -> Column:
    """A spaced text without its plain tokens: the short rest that the patterns of odd tokens have to be tried on."""
    return F.regexp_replace(x, PLAIN, "")


def share_of(n: Column, d: Column, places: int = 4) -> Column:
    """ratio() that counts the whole only where the part isn't 0."""
    return let(n, lambda part: F.when(part > 0, let(d, lambda whole: ratio(part, whole, places))).otherwise(F.lit(0.0)))


def blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def tokens(c: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(c, F.lit(f"[^{_SPACE}]+"), F.lit(0))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars(c: Column, kind: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(c) - F.length(F.regexp_replace(c, f"{kind}+", ""))


def glyph_mapped(line: Column) -> Column:
    """Whether a line looks like glyphs typed as Latin letters; null if it is too short to tell."""

    def judge(n: Column) -> Column:
        x, z, tokens_, total = n["x"], n["z"], n["blanks"] - 1, F.length(n["x"]) - n["blanks"]
        shape = (share_of(count(z, VOWELLESS), count(x, ALPHA), 9) > MIN_VOWELLESS) | (share_of(count(z, SYMBOLIC), tokens_, 9) > MIN_SYMBOL) | (share_of(count(z, SWITCHED), tokens_, 9) > MIN_CASE_SWITCH)
        foreign = (chars(x, _DEVANAGARI) > MAX_DEVANAGARI * total) | (chars(x, "[A-Za-z]") < MIN_LATIN * total)
        odd = F.length(z) > 1  # a line of plain tokens has no shape to judge
        return F.when(tokens_ < LINE_MIN_TOKENS, None).otherwise(odd & shape & ~foreign)

    return let(let(spaced(line), lambda x: F.struct(x.alias("x"), unusual(x).alias("z"), blanks(x).alias("blanks"))), judge)


def text_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the struct `metrics` of twenty measurements: whole numbers are counted over Arrow batches, in one reading of a text; ratios are expressions.
    Kinds of characters are those of Python's Unicode tables."""
    names, session = measures.COUNTS, df.sparkSession
    bounded(session)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = measures.measure([t or "" for t in batch.column(text).to_pylist()], STOPWORDS, line_tokens=LINE_MIN_TOKENS, vowelless=MIN_VOWELLESS, symbol=MIN_SYMBOL, case_switch=MIN_CASE_SWITCH, devanagari=MAX_DEVANAGARI, latin=MIN_LATIN)
            counts = pa.StructArray.from_arrays([pa.array(found[c], pa.int32()) for c in names], names)
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, "_counts"])

    kept = StructType([*df.schema.fields, StructField("_counts", StructType([StructField(c, IntegerType()) for c in names]))])
    n = {c: F.col(f"_counts.{c}") for c in names}
    share = lambda part, whole="total": ratio(n[part], n[whole])
    fields = {
        "char_count": n["chars"], "non_whitespace_chars": n["total"], "token_count": n["tokens"], "line_count": n["lines"], "non_empty_lines": n["filled"],
        "printable_ratio": ratio(n["total"] - n["other"], n["total"]), "control_char_ratio": share("control"), "replacement_char_count": n["replacement"], "replacement_char_ratio": share("replacement"),
        "devanagari_ratio": share("devanagari"), "latin_letter_ratio": share("latin"), "digit_ratio": share("digits"), "punctuation_ratio": share("punctuation"),
        "stopword_rate": share("stopwords", "tokens"), "vowelless_token_ratio": share("vowelless", "alpha"), "intraword_symbol_ratio": share("symbolic", "tokens"), "intraword_case_switch_ratio": share("switched", "tokens"),
        "legacy_line_ratio": share("legacy", "judged"), "legacy_lines": n["legacy"], "judged_lines": n["judged"],
    }
    return df.mapInArrow(counted, kept).withColumn("metrics", F.struct(*[v.alias(k) for k, v in fields.items()])).drop("_counts")


def classify(df: DataFrame, *, family: Column, error: Column, parsed: Column, cells: Column, coverage: Column, page_chars: Column) -> DataFrame:
    """Adds status, reason and warnings from `metrics` and the evidence: rules in order, the first that matches decides.

    cells: non-empty cells of a spreadsheet, else null; coverage and page_chars: share of pages with text and its median
    length, null without pages.
    """
    m = F.col("metrics")
    structural = cells.isNotNull()
    font = (m["token_count"] >= MIN_TOKENS) & (m["judged_lines"] > 0) & (m["legacy_line_ratio"] > LINE_RATIO)
    rules = [
        (error.isNotNull(), "failed", "parser_error"), (family.isin(UNSUPPORTED), "unsupported", "no_native_parser"), (family == "image", "needs_ocr", "image_file"), (~parsed, "failed", "parser_error"),
        (structural & (cells == 0), "suspicious", "empty_spreadsheet"), (structural, "extracted", "clean"), (coverage < COVERAGE_NEEDS_OCR, "needs_ocr", "no_text_layer"), (page_chars < MIN_CHARS_PER_PAGE, "needs_ocr", "sparse_text_layer"),
        (font, "suspicious", "legacy_font_suspected"), (m["replacement_char_ratio"] > MAX_REPLACEMENT, "suspicious", "replacement_characters"), (m["control_char_ratio"] > MAX_CONTROL, "suspicious", "control_characters"), (m["printable_ratio"] < MIN_PRINTABLE, "suspicious", "low_printable_ratio"),
        (coverage < COVERAGE_SUSPICIOUS, "suspicious", "partial_text_coverage"), (m["non_whitespace_chars"] == 0, "needs_ocr", "no_text_layer"),
    ]
    verdict = F.struct(F.lit("extracted").alias("status"), F.lit("clean").alias("reason"))
    for test, status, reason in reversed(rules):
        verdict = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))).otherwise(verdict)
    out = df.withColumn("_v", verdict)
    prose = ~structural & ~F.col("_v.reason").isin("parser_error", "no_native_parser", "image_file")
    few = F.when(prose & (m["token_count"] < MIN_TOKENS), F.lit("insufficient_text"))
    partial = F.when(prose & (F.col("_v.status").isin("extracted") | ((F.col("_v.reason") == "no_text_layer") & (coverage >= COVERAGE_SUSPICIOUS))) & (coverage >= COVERAGE_SUSPICIOUS) & (coverage < COVERAGE_WARN), F.lit("partial_text_coverage"))
    return out.select(*df.columns, "_v.status", "_v.reason", F.array_compact(F.array(few, partial)).alias("warnings"))


def lexicon(docs: DataFrame, id_col: str, text: str, least: int = 3) -> DataFrame:
    """Words of three letters and more with a vowel, and in how many documents they occur, from `least` on."""
    words = docs.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))).alias("word")).where(F.col("word").rlike("[aeiou]"))
    return words.groupBy("word").agg(F.countDistinct(id_col).alias("df")).where(F.col("df") >= least)
