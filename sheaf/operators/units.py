"""Units of a document (lines, cells) told apart by shape, profiles of them, and the verdicts and routes that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.numbers import let, ratio
from sheaf.operators import quality as q

#: Thresholds of the unit rules and of the document rules over units.
ENGLISH_MIN_WORDS, ENGLISH_MAX_VOWELLESS, NUMERIC_MIN_DIGITS, NUMERIC_MAX_WORDS = 3, 0.10, 0.30, 2
REGION_UNITS, REGION_RUN, REGION_CONTESTED, RATIO_JUDGED, RATIO_LEGACY = 10, 3, 0.50, 8, 4
CONVERSION_GATE, MIN_PAGE_TEXT = 0.20, 50
#: Fixed values of Devanagari orthography: independent vowels, consonants, vowel signs, digits and dandas.
VOWELS, CONSONANTS, SIGNS, VIRAMA, NUKTA, DIGITS, DANDA = r"ऄ-औॠॡॲ-ॷ", r"क-हक़-य़ॸ-ॿ", r"ऺऻा-ौॎॏॕ-ॗॢॣ", r"्", r"़", r"०-९", r"।॥"


#: Patterns of whole tokens in a spaced text (as in quality.py): three letters and more with a small one, and those without a vowel; tokens with a Latin letter, and those with a
#: symbol inside that doesn't merely join real words (two or more runs of letters, each with a vowel, an acronym or a single capital), or with a change to a capital.
_CONSONANTS = "B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z"
_RUN = f"(?:[A-Z]++(?![a-z])|[{_CONSONANTS}]*+[AEIOUaeiou][A-Za-z]*+)"
_COMPOUND = f"[^ A-Za-z]*+{_RUN}(?:[^ A-Za-z]++{_RUN})++[^ A-Za-z]*+(?= )"
JUDGED, JUDGED_VOWELLESS = " (?=[A-Z]*+[a-z])[A-Za-z]{3,}(?= )", f" (?=[A-Z]*+[a-z])[{_CONSONANTS}]{{3,}}(?= )"
WORDISH = " [^ A-Za-z]*+[A-Za-z][^ ]*+"
WORDISH_SYMBOLIC, WORDISH_SWITCHED = f" (?=[^ A-Za-z]*+[A-Za-z])(?!{_COMPOUND}){q.SYMBOLIC[1:]}", f" (?=[^ A-Za-z]*+[A-Za-z]){q.SWITCHED[1:]}"


def assess(text: Column) -> Column:
    """Struct of state (legacy, trusted, unjudged), kind and shares of one unit; rules in order."""

    def measured(w: Column) -> Column:
        x, z, rest, total = w["x"], w["z"], w["rest"], w["total"]
        small = F.length(x) - w["blanks"] - F.length(rest)
        return F.struct(
            total.alias("total"), (w["blanks"] - 1).alias("tokens"), q.count(x, q.ALPHA).alias("alpha_tokens"), q.share_of(q.count(z, JUDGED_VOWELLESS), q.count(x, JUDGED)).alias("vowelless_ratio"),
            q.share_of(q.count(z, WORDISH_SYMBOLIC), q.count(x, WORDISH)).alias("symbol_ratio"), q.share_of(q.count(z, WORDISH_SWITCHED), q.count(x, WORDISH)).alias("case_switch_ratio"),
            ratio(q.chars(rest, q._DEVANAGARI), total).alias("devanagari_ratio"), ratio(small + q.chars(rest, "[A-Z]"), total).alias("latin_ratio"), ratio(q.chars(rest, r"\p{Nd}"), total).alias("digit_ratio"),
        )

    def kind(m: Column) -> Column:
        return (
            F.when(m["total"] == 0, "empty").when(m["devanagari_ratio"] > q.MAX_DEVANAGARI, "unicode_devanagari").when(m["tokens"] < q.LINE_MIN_TOKENS, "too_short")
            .when((m["digit_ratio"] >= NUMERIC_MIN_DIGITS) & (m["alpha_tokens"] <= NUMERIC_MAX_WORDS), "numeric_table_like").when(m["latin_ratio"] < q.MIN_LATIN, "numeric_table_like")
            .when((m["alpha_tokens"] >= ENGLISH_MIN_WORDS) & (m["vowelless_ratio"] <= ENGLISH_MAX_VOWELLESS) & (m["case_switch_ratio"] <= 0) & (m["symbol_ratio"] <= q.MIN_SYMBOL), "english_like")
            .when((m["vowelless_ratio"] > q.MIN_VOWELLESS) | (m["symbol_ratio"] > q.MIN_SYMBOL) | (m["case_switch_ratio"] > q.MIN_CASE_SWITCH), "legacy_shape").otherwise("clean_latin")
        )

    def made(m: Column, k: Column) -> Column:
        state = F.when(k == "legacy_shape", "legacy").when(k.isin("unicode_devanagari", "english_like", "clean_latin"), "trusted").otherwise("unjudged")
        names = ("tokens", "alpha_tokens", "vowelless_ratio", "symbol_ratio", "case_switch_ratio", "devanagari_ratio", "latin_ratio", "digit_ratio")
        return F.struct(state.alias("state"), k.alias("kind"), *[m[n].alias(n) for n in names])

    def split(x: Column) -> Column:
        blanks = q.blanks(x)
        return F.struct(x.alias("x"), q.unusual(x).alias("z"), F.regexp_replace(x, "[a-z ]+", "").alias("rest"), blanks.alias("blanks"), (F.length(x) - blanks).alias("total"))

    return let(let(let(q.spaced(text), split), measured), lambda m: let(kind(m), lambda k: made(m, k)))


def profile(units: DataFrame, doc: str = "doc_id", order: str = "unit_ord", text: str = "text") -> DataFrame:
    """Counts, shares and the longest legacy run of each document's units."""
    seen = units.select(doc, order, assess(F.col(text)).alias("a")).select(doc, order, "a.state", "a.kind")
    # a run goes on until a trusted unit; every group is within its document, so one shuffle by document serves all of it, and units are assessed once
    island = F.sum(F.when(F.col("state") == "trusted", 1).otherwise(0)).over(Window.partitionBy(doc).orderBy(order))
    tests = {"judged": F.col("state") != "unjudged", "legacy": F.col("state") == "legacy", "trusted": F.col("state") == "trusted", "clean": F.col("kind") == "clean_latin", "english": F.col("kind") == "english_like", "numeric": F.col("kind") == "numeric_table_like"}
    runs = seen.withColumn("_i", island).groupBy(doc, "_i").agg(F.count("*").alias("units"), *[F.count_if(c).alias(name) for name, c in tests.items()])
    out = runs.groupBy(doc).agg(F.sum("units").alias("units"), *[F.sum(name).alias(name) for name in tests], F.max("legacy").alias("longest_run"))
    return out.select("*", ratio(F.col("legacy"), F.col("judged")).alias("legacy_unit_ratio"), ratio(F.col("legacy"), F.col("legacy") + F.col("clean")).alias("contested_ratio"))


def region(p: str = "") -> Column:
    """A legacy region in a document whose share looks innocent."""
    return (F.col(f"{p}legacy") >= REGION_UNITS) & (F.col(f"{p}longest_run") >= REGION_RUN) & (F.col(f"{p}contested_ratio") >= REGION_CONTESTED)


def by_share(p: str = "") -> Column:
    """A document that is legacy by the share of its judged units, once there are enough of them."""
    return (F.col(f"{p}legacy_unit_ratio") > q.LINE_RATIO) & ((F.col(f"{p}judged") >= RATIO_JUDGED) | (F.col(f"{p}legacy") >= RATIO_LEGACY))


def classify_units(first: DataFrame) -> DataFrame:
    """Adds status2, reason2 and minority from the first verdict (status, reason) and a unit profile: only what the first
    called legacy, or passed below that rule, is decided anew."""
    later = F.col("reason").isin("legacy_font_suspected", "replacement_characters", "control_characters", "low_printable_ratio", "partial_text_coverage", "clean")
    suspect = later & (by_share() | region())
    return first.withColumn("status2", F.when(suspect, "suspicious").when(F.col("reason") == "legacy_font_suspected", "extracted").otherwise(F.col("status"))).withColumn("reason2", F.when(suspect, "legacy_font_suspected").when(F.col("reason") == "legacy_font_suspected", "clean").otherwise(F.col("reason"))).withColumn("minority", suspect & ~by_share())


def plan(family: Column, status: Column, reason: Column, share: Column) -> Column:
    """Struct of plan and why for a document: none, pages, convert or native."""
    rules = [
        (status.isin("failed", "unsupported"), "none", reason), (family == "image", "none", F.lit("image_ocr_not_enabled")), ((status == "needs_ocr") & (family == "pdf"), "pages", reason), (status == "needs_ocr", "none", F.concat(reason, F.lit("_unsupported_family"))),
        ((reason == "legacy_font_suspected") & share.isNull(), "native", F.lit("no_unit_metrics")), ((reason == "legacy_font_suspected") & (share < CONVERSION_GATE), "native", F.lit("below_conversion_gate")), ((reason == "legacy_font_suspected") & (family == "pdf"), "pages", reason),
        ((reason == "legacy_font_suspected") & family.isin("spreadsheet", "document", "text"), "convert", reason), (reason == "legacy_font_suspected", "native", F.concat(reason, F.lit("_unsupported_family"))),
    ]
    return _first(rules, "native", reason)


def route(known: Column, reason: Column, chars: Column, embedded: Column, legacy_name: Column, image: Column) -> Column:
    """Struct of route and why for a page: native, legacy or ocr; without provenance the native text stays."""
    legacy = reason == "legacy_font_suspected"
    rules = [
        (~known, "native", F.lit("provenance_unavailable")), (legacy & embedded, "legacy_conversion", F.lit("embedded_font")), (legacy & legacy_name, "legacy_conversion", F.lit("legacy_font_referenced")), (legacy & image, "ocr", F.lit("no_font_scan_backed")),
        (legacy & (chars == 0), "native", F.lit("empty_page")), (legacy, "native", F.lit("no_font_provenance")), ((chars >= MIN_PAGE_TEXT) & embedded, "native", F.lit("page_has_text_layer")), (image, "ocr", reason), (chars >= MIN_PAGE_TEXT, "native", F.lit("page_has_text_layer")),
    ]
    return _first(rules, "native", F.lit("empty_page"))


def _first(rules: list, otherwise: str, why: Column) -> Column:
    out = F.struct(F.lit(otherwise).alias("decision"), why.alias("why"))
    for test, decision, reason in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(decision).alias("decision"), reason.alias("why"))).otherwise(out)
    return out


def illegal_clusters(text: Column) -> Column:
    """Sequences that Devanagari does not permit: a dependent sign without a base, after another sign, a virama, a digit or a danda."""
    script = r"ऀ-ॿ꣠-ꣿ"
    alone = rf"(?<![{script}])[{SIGNS}{VIRAMA}{NUKTA}]"
    after = rf"(?<=[{VOWELS}{SIGNS}{VIRAMA}{DIGITS}{DANDA}])[{SIGNS}{VIRAMA}]"
    nukta = rf"(?<=[{script}])(?<![{CONSONANTS}]){NUKTA}"
    return q.count(text, alone) + q.count(text, after) + q.count(text, nukta)


def script_shape(text: Column) -> Column:
    """Struct of Devanagari characters, tokens, illegal clusters and tokens that mix scripts, with their shares."""
    words, chars = q.tokens(text), q.count(text, q._DEVANAGARI)
    mixed = F.size(F.filter(words, lambda t: t.rlike(q._DEVANAGARI) & t.rlike("[A-Za-z]")))
    return F.struct(chars.alias("devanagari_chars"), F.size(words).alias("tokens"), illegal_clusters(text).alias("illegal_clusters"), ratio(illegal_clusters(text), chars).alias("illegal_ratio"), mixed.alias("residue_tokens"), ratio(mixed, F.size(words)).alias("residue_ratio"), ratio(chars, q.count(text, f"[^{q._SPACE}]")).alias("devanagari_ratio"))


def conversion_verdict(source: Column, converted: Column, known_words: Column, words: Column) -> Column:
    """Why a conversion is refused, or null: length between half and double, script that emerges, few illegal clusters and
    little residue, and enough known words (at least 5 and 5 %). The converter itself is not part of the library."""
    shape, length = script_shape(converted), F.length(converted) / F.greatest(F.length(source), F.lit(1))
    return (
        F.when((length < 0.5) | (length > 2.0), "length").when(shape["devanagari_ratio"] < 0.3, "no_script").when(shape["illegal_ratio"] > 0.02, "illegal_clusters").when(shape["residue_ratio"] > 0.20, "residue")
        .when((known_words < 5) | (known_words < 0.05 * words), "vocabulary")
    )
