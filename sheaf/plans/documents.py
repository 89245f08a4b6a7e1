"""Queries over texts, chunks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators import chunking, quality, recovered, vocabulary
from sheaf.operators.ranks import checkpointed
from sheaf.plans.registry import query, spread, table
from sheaf.sources import web

WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
STOP = ", ".join(f"'{w}'" for w in quality.STOPWORDS)


def _r(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN round({n}::DOUBLE / {d}, 4) ELSE 0.0 END"


@query("text_metrics", f"""WITH t AS (SELECT doc_id, text, length(regexp_replace(text, '[{WS}]+', '', 'g')) AS total, regexp_extract_all(text, '[^{WS}]+') AS w FROM documents),
a AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]{{3,}}')) AS alpha FROM t)
SELECT doc_id, length(text)::INT AS char_count, total::INT AS non_whitespace_chars, len(w)::INT AS token_count, {_r("length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))", "total")} AS latin_letter_ratio, {_r("length(regexp_replace(text, '[^0-9]+', '', 'g'))", "total")} AS digit_ratio,
{_r("length(regexp_replace(text, '[^' || chr(92) || 'p{P}]+', '', 'g'))", "total")} AS punctuation_ratio, {_r(f"len(list_filter(w, lambda x: list_contains([{STOP}], lower(x))))", "len(w)")} AS stopword_rate, {_r("len(list_filter(alpha, lambda x: NOT regexp_matches(x, '[aeiouAEIOU]')))", "len(alpha)")} AS vowelless_token_ratio,
{_r("len(list_filter(w, lambda x: regexp_matches(x, '[[:lower:]ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ][[:upper:]ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ]')))", "len(w)")} AS intraword_case_switch_ratio FROM a""")
def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.text_metrics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return m.select("doc_id", *[F.col(f"metrics.{c}") for c in ("char_count", "non_whitespace_chars", "token_count", "latin_letter_ratio", "digit_ratio")], F.col("metrics.punctuation_ratio"), *[F.col(f"metrics.{c}") for c in ("stopword_rate", "vowelless_token_ratio", "intraword_case_switch_ratio")])


@query("text_verdicts")
def text_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.text_metrics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None)
    out = quality.classify(m, family=F.lit("pdf"), error=none.cast("string"), parsed=F.lit(True), cells=none.cast("int"), coverage=F.when(F.col("doc_id") % 3 == 0, 0.8), page_chars=F.when(F.col("doc_id") % 3 == 0, F.length("text")))
    return out.select("doc_id", "status", "reason", F.array_join("warnings", ",").alias("warnings"))


def chunk_sql(source: str, keys: str, most: int, overlap: int) -> str:
    """Recursive SQL: `cut` has keys, i (number of the piece), s and e (its place in body, which is the stripped text)."""
    breaks = [("chr(10) || chr(10)", 2), ("' .'", 2), ("chr(10)", 1), ("' '", 1)]  # reversed

    def end(s: str) -> str:
        at = [f"strpos(reverse(substring(body, {s} + 1, {most})), {b})" for b, _ in breaks]
        found = ", ".join(f"CASE WHEN {p} > 0 AND {most} - {p} + 1 - {size} > {most // 2} THEN {s} + {most} - {p} + 1 END" for p, (_, size) in zip(at, breaks, strict=True))
        return f"CASE WHEN length(body) - {s} <= {most} THEN length(body) ELSE coalesce({found}, {s} + {most}) END"

    return f"""body AS (SELECT {keys}, regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g') AS body, length(text) - length(regexp_replace(text, '^[{WS}]+', '')) AS lead FROM ({source})),
cut AS (SELECT {keys}, body, lead, 0::BIGINT AS i, 0::BIGINT AS s, {end("0")}::BIGINT AS e FROM body WHERE body <> ''
  UNION ALL SELECT {keys}, body, lead, i + 1, s2, {end("s2")} FROM (SELECT *, s + greatest({max(1, most - overlap)}, e - s - {overlap}) AS s2 FROM cut WHERE length(body) - s > {most}) WHERE s2 < length(body)),
pieces AS (SELECT {keys}, i, lead + s + length(raw) - length(regexp_replace(raw, '^[{WS}]+', '')) AS s, regexp_replace(raw, '^[{WS}]+|[{WS}]+$', '', 'g') AS content FROM (SELECT *, substring(body, s + 1, e - s) AS raw FROM cut))"""


@query("chunks", f"WITH RECURSIVE {chunk_sql('SELECT doc_id, text FROM documents', 'doc_id', 1000, 100)} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, content FROM pieces WHERE content <> ''")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), max_chars=1000, overlap=100)


@query("chunk_sizes", f"WITH RECURSIVE {chunk_sql('SELECT doc_id, text FROM documents', 'doc_id', 1000, 0)} SELECT doc_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM pieces WHERE content <> '' GROUP BY doc_id")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), max_chars=1000, overlap=0).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query("merged_blocks")
def merged_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    blocks = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_ord"), "text", F.col("role").alias("section"), F.lit(1).alias("page_number"), F.when(F.col("turn") % 5 == 4, "table").otherwise("text").alias("element_type"))
    return chunking.merge_blocks(blocks, max_chars=1200)


@query("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.parse_pages(table(spark, sf_dir, "pages")).select("page_id", "page.title", "page.text", F.size("page.links").alias("n_links"))


@query("page_links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.links(table(spark, sf_dir, "pages"))


@query("byte_families", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'archive' ELSE CASE WHEN regexp_matches(lower(html), '^\\s*(<!doctype html|<html)') THEN 'web' ELSE 'text' END END AS family FROM pages")
def byte_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id") % 4
    content = F.when(n == 0, F.encode(F.concat(F.lit("%PDF-1.7 "), "html"), "UTF-8")).when(n == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(n == 2, F.unhex(F.lit("504B03041400"))).otherwise(F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", web.sniff(content).alias("family"))


GLYPHS = f"""lines AS (SELECT doc_id, lang, n::INT AS n, line FROM (SELECT doc_id, lang, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))),
toks AS (SELECT *, regexp_extract_all(line, '[^{WS}]+') AS w, length(regexp_replace(line, '[{WS}]+', '', 'g')) AS total FROM lines),
parts AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]{{3,}}')) AS alpha, list_transform(w, lambda x: regexp_replace(x, '^[.,;:!?()\\[\\]{{}}"''`—–-]+|[.,;:!?()\\[\\]{{}}"''`—–-]+$', '', 'g')) AS bare FROM toks),
good AS (SELECT doc_id, lang, n, line FROM parts WHERE NOT (len(w) >= 4 AND length(regexp_replace(line, '[^A-Za-z]+', '', 'g')) >= 0.35 * total AND (
  len(list_filter(alpha, lambda x: NOT regexp_matches(x, '[aeiouAEIOU]'))) > 0.30 * len(alpha) OR len(list_filter(bare, lambda x: regexp_matches(x, '(?s)^.+[^\\pL\\pN\\p{{Mn}}\\p{{Mc}}].+$'))) > 0.15 * len(w) OR len(list_filter(w, lambda x: regexp_matches(x, '\\p{{Ll}}\\p{{Lu}}'))) > 0.10 * len(w)))),
seen AS (SELECT lower(run) AS word, doc_id, bool_or(regexp_full_match(run, '[A-Z]{{2,6}}')) AS capitals FROM (SELECT doc_id, unnest(regexp_extract_all(line, '[A-Za-z]{{2,}}')) AS run FROM good WHERE lang = 'en') GROUP BY 1, 2),
known AS (SELECT word, count(*) AS df, count(*) FILTER (capitals) AS acronym_df FROM seen GROUP BY word HAVING count(*) >= 3 AND ((length(word) > 2 AND regexp_matches(word, '[aeiou]')) OR word IN ({", ".join(f"'{w}'" for w in vocabulary.TWO_LETTERS)}) OR count(*) FILTER (capitals) >= 3))"""


@query("english_vocabulary", f"WITH {GLYPHS} SELECT * FROM known")
def english_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.english(spread(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "text")))


@query("english_lines", f"""WITH {GLYPHS}, runs AS (SELECT doc_id, n, list_transform(regexp_extract_all(line, '[A-Za-z]{{2,}}'), lambda x: lower(x)) AS r FROM lines),
hits AS (SELECT doc_id, n, count(*) AS h FROM (SELECT doc_id, n, unnest(r) AS word FROM runs) JOIN known USING (word) GROUP BY 1, 2)
SELECT doc_id, count(*) AS lines, sum(len(r))::BIGINT AS runs, sum(coalesce(h, 0))::BIGINT AS hits, count(*) FILTER (len(r) > 0 AND 2 * coalesce(h, 0) >= len(r)) AS half, count(*) FILTER (CASE WHEN len(r) >= 2 THEN round(h / len(r), 4) >= 0.6 ELSE len(r) = 1 AND h = 1 AND length(r[1]) >= 4 END) AS confident FROM runs LEFT JOIN hits USING (doc_id, n) GROUP BY doc_id""")
def english_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    units = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    known = checkpointed(vocabulary.english(spread(docs.where("lang = 'en'"))))  # the bitmap and the join both need it
    found = vocabulary.word_rates(units, known, ["doc_id", "n"])
    return found.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum("runs").alias("runs"), F.sum("hits").alias("hits"), F.count_if(F.col("rate") >= 0.5).alias("half"), F.count_if("confident").alias("confident"))


@query("recovered_chunks", f"""WITH RECURSIVE units AS (SELECT doc_id, lang, (n - 1) // 6 + 1 AS page_number, n AS unit_ord, t AS text FROM (SELECT doc_id, lang, unnest(l) AS t, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))),
texts AS (SELECT doc_id, page_number, string_agg(text, chr(10) ORDER BY unit_ord) AS text FROM units GROUP BY 1, 2),
offs AS (SELECT doc_id, page_number, unit_ord, length(text) AS size, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, page_number ORDER BY unit_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM units),
{chunk_sql('SELECT doc_id, page_number, text FROM texts', 'doc_id, page_number', 400, 50)},
met AS (SELECT p.doc_id, p.page_number, i, list_aggregate(list_transform(list_sort(list(unit_ord)), lambda x: x::VARCHAR), 'string_agg', ',') AS units FROM pieces p JOIN offs o ON o.doc_id = p.doc_id AND o.page_number = p.page_number AND size > 0 AND a < p.s + length(content) AND a + size > p.s WHERE content <> '' GROUP BY 1, 2, 3)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, i) - 1)::INT AS chunk_index, page_number, content, units, CASE lang WHEN 'de' THEN 'ocr,lines' WHEN 'fr' THEN 'legacy_conversion,lines,c1' ELSE 'native,lines' END AS kept, CASE lang WHEN 'de' THEN 'false' END AS authoritative
FROM pieces JOIN met USING (doc_id, page_number, i) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""")
def recovered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    units = lines.select("doc_id", "lang", F.expr("n div 6 + 1").alias("page_number"), (F.col("n") + 1).alias("unit_ord"), "text")
    route = F.when(F.col("lang") == "de", "ocr").when(F.col("lang") == "fr", "legacy_conversion").otherwise("native")
    pages = units.groupBy("doc_id", "page_number").agg(F.first("lang").alias("lang")).select("doc_id", "page_number", route.alias("route"), F.lit("lines").alias("reason"), F.lit(None).cast("string").alias("label"), F.lit("c1").alias("converter"))
    found = recovered.chunks(units.drop("lang"), pages, max_chars=400, overlap=50)
    kept = F.concat_ws(",", *[F.col("metadata")[k] for k in ("route", "route_reason", "converter")])
    return found.select("doc_id", "chunk_index", "page_number", "content", F.array_join(F.transform("units", lambda u: u.cast("string")), ",").alias("units"), kept.alias("kept"), F.col("metadata")["authoritative"].alias("authoritative"))
