"""Counts and reports over catalogs, files and runs: plain joins and conditional aggregates, one row or one row a key."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.numbers import ratio

#: How much of a passage must fit, what marks a cut one, the instruction of a search query, families whose bytes may be markup.
MIN_PASSAGE, CUT_MARK = 200, " …"
QUERY_INSTRUCTION = "Given a search query, retrieve relevant passages that answer the query"
KEYS_CAP = 5_000


def in_keys(df: DataFrame, column: str, keys: list, cap: int = KEYS_CAP) -> DataFrame:
    """Rows whose key is in a list: repeated keys count once, and a list longer than the cap is refused."""
    wanted = list(dict.fromkeys(keys))
    if len(wanted) > cap:
        raise ValueError(f"{len(wanted)} keys; at most {cap} at once")
    table = df.sparkSession.createDataFrame([(k,) for k in wanted], df.select(F.col(column).alias("_key")).schema)
    return df.join(F.broadcast(table), F.col(column) == F.col("_key"), "left_semi")


def next_numbers(parents: DataFrame, rows: DataFrame, key: str, number: str) -> DataFrame:
    """The number that each parent's next row gets: one above its largest, 1 without rows."""
    return parents.select(key).join(rows.groupBy(key).agg(F.max(number).alias("_top")), key, "left").select(key, (F.coalesce("_top", F.lit(0)) + 1).alias("next_number"))


def newest(df: DataFrame, by: list[str], at: str, key: str, n: int) -> DataFrame:
    """The n newest rows of each group, with their place; equal times by the larger key."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(at), F.desc(key)))).where(F.col("place") <= n)


def day(c: Column) -> Column:
    """A date given as YYYY-MM-DD and nothing else; null where it isn't a real one."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(c), "yyyy-MM-dd"))


def range_refusal(first: Column, last: Column, currency: Column, *, most_days: int = 31, most_days_all: int = 3) -> Column:
    """Why a range of days can't be asked for, or null: format, calendar, order, then length (shorter without a currency)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    odd = lambda c: ~F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$")
    days = F.datediff(day(last), day(first)) + 1
    return (
        F.when(blank(first) | blank(last), "missing").when(odd(first) | odd(last), "format").when(day(first).isNull() | day(last).isNull(), "calendar").when(day(first) > day(last), "order")
        .when(days > most_days, "length").when(blank(currency) & (days > most_days_all), "length_all")
    )


def instructed(text: Column, mode: str) -> Column:
    """The text that is embedded: queries carry an instruction, documents stand as they are."""
    if mode not in ("query", "document"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.concat(F.lit(f"Instruct: {QUERY_INSTRUCTION}\nQuery: "), text) if mode == "query" else text


def mebibytes(c: Column) -> Column:
    return F.concat(F.format_number(F.coalesce(c, F.lit(0)) / F.lit(1_048_576), 1), F.lit(" MB"))


def without_site(title: Column, site: Column) -> Column:
    """A title without the ` - site name` that its page declares; null where nothing is left."""
    suffix = F.concat(F.lit(" - "), site)
    cut = F.trim(F.substr(title, F.lit(1), F.length(title) - F.length(suffix)))
    out = F.when((F.coalesce(site, F.lit("")) != "") & F.endswith(title, suffix), cut).otherwise(title)
    return F.when(out != "", out)


def without_subset(font: Column) -> Column:
    """A font's name without the six capitals and plus that mark a subset."""
    return F.regexp_replace(F.regexp_replace(font, "^/+", ""), r"^[A-Z]{6}\+", "")


def merged_json(base: Column, patch: Column) -> Column:
    """Two JSON objects as one map of texts; the right one wins."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(as_map(base), lambda k, _: ~F.map_contains_key(as_map(patch), k))
    return F.map_concat(kept, as_map(patch))


def has_key(c: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(c), key), F.lit(False))


def budgeted(passages: DataFrame, *, query: str, place: str, text: str, budget: int, fixed: int = 0) -> DataFrame:
    """Passages that fit a budget of characters, cut to equal shares: of each query's ranked passages the last go until every one left
    has room for MIN_PASSAGE (at least one stays); `fixed` characters of each are its header's."""
    sizes = passages.groupBy(query).agg(F.count("*").alias("_n"))
    kept = F.greatest(F.lit(1), F.least(F.col("_n"), F.floor(F.lit(budget) / F.lit(fixed + MIN_PASSAGE))))
    share = F.greatest(F.lit(MIN_PASSAGE), F.floor(F.lit(budget) / kept) - fixed)
    body = F.trim(F.col(text))
    cut = F.concat(F.rtrim(F.substr(body, F.lit(1), (share - len(CUT_MARK)).cast("int"))), F.lit(CUT_MARK))
    return passages.join(sizes, query).where(F.col(place) <= kept).select(query, place, F.when(F.length(body) > share, cut).otherwise(body).alias("passage"), (F.length(body) > share).alias("trimmed"))


def line_page(lines: DataFrame, *, doc: str, ordinal: str, text: str, start: int = 1, most: int = 200, budget: int = 8_000) -> DataFrame:
    """Whole lines from `start` on that fit a budget, by document: first, last, lines and chars of the page, where to go on (null at the end), and the
    length of a first line that alone is over the budget and had to be cut."""
    ends = lines.groupBy(doc).agg(F.max(ordinal).alias("_end"))
    window = Window.partitionBy(doc).orderBy(ordinal)
    page = lines.where(F.col(ordinal).between(start, start + most - 1)).select(doc, ordinal, (F.length(text) + 1).alias("_size"), F.sum(F.length(text) + 1).over(window).alias("_upto"))
    shown = page.where((F.col("_upto") <= budget) | (F.col(ordinal) == start))
    last, alone = F.max(ordinal), F.max(F.when((F.col(ordinal) == start) & (F.col("_size") > budget), F.col("_size") - 1))
    out = shown.groupBy(doc).agg(F.min(ordinal).alias("first"), last.alias("last"), F.count("*").alias("lines"), F.least(F.max("_upto"), F.lit(budget)).alias("chars"), alone.alias("hard_cut"))
    return out.join(ends, doc).select(doc, "first", "last", "lines", "chars", "hard_cut", F.when(F.col("last") < F.col("_end"), F.col("last") + 1).alias("resume"))


def work_order(targets: DataFrame, manifest: DataFrame, key: str, position: str) -> DataFrame:
    """Targets in the order of the first entry of a manifest that names them, others behind; the key settles the rest."""
    first = manifest.groupBy(key).agg(F.min(position).alias("_rank"))
    return targets.join(first, key, "left").orderBy(F.col("_rank").asc_nulls_last(), key).select(targets.columns + [F.col("_rank").alias("rank")])


def unfetched(wanted: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """How many distinct keys are wanted, and how many of them aren't there."""
    distinct = wanted.select(key).distinct()
    there = fetched.select(key, F.lit(1).alias("_there")).distinct()
    return distinct.join(there, key, "left").agg(F.count("*").alias("wanted"), F.count_if(F.col("_there").isNull()).alias("missing"))


def version_counts(results: DataFrame, *, version: str, status: str, current: str, statuses: list[str]) -> DataFrame:
    """Results of the current version, by each status of a closed vocabulary, and how many are of another one."""
    now = F.col(version) == current
    return results.agg(F.count_if(now).alias("extracted"), *[F.count_if(now & (F.col(status) == s)).alias(s) for s in statuses], F.count_if(~now).alias("stale"))


def pass_counters(rows: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """Every counter of a pass, zero where nothing was counted."""
    return rows.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in counters.items()])


def ledger(run: int, counters: dict[str, int], known: list[str], runs: DataFrame) -> DataFrame:
    """A run's row added to the ledger: known counters only, zero where not given."""
    if unknown := sorted(set(counters) - set(known)):
        raise ValueError(f"unknown counters: {', '.join(unknown)}")
    return runs.unionByName(runs.sparkSession.createDataFrame([(run, *[int(counters.get(c, 0)) for c in known])], "run_id long, " + ", ".join(f"{c} long" for c in known)))


def run_ledger(counted: DataFrame, known: list[str]) -> DataFrame:
    """(run_id, a column for each known counter, unknown) from rows (run_id, counter, n): zero where a run counted nothing, and the sorted names of
    counters that the ledger doesn't have. A null count is none; a run with unknown counters only still has its row."""
    sums = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).cast("long").alias(c) for c in known]
    strange = F.sort_array(F.collect_set(F.when(~F.col("counter").isin(known), F.col("counter"))))
    return counted.groupBy("run_id").agg(*sums, strange.alias("unknown"))


def cohort_accounts(files: DataFrame, *, blob: str, ready: Column) -> DataFrame:
    """Files and blobs of a cohort, never mixed: how many of each, and how many files are copies of a blob that counts already."""
    return files.agg(F.count("*").alias("files"), F.countDistinct(blob).alias("blobs"), F.countDistinct(F.when(ready, F.col(blob))).alias("blobs_ready")).withColumn("collapsed", F.col("files") - F.col("blobs"))


def discovered(sources: dict[str, DataFrame], key: str, complete: dict[str, bool]) -> DataFrame:
    """The union of what several sources list: each key once, the sources that have it, and whether all of them were read to the end."""
    frames = [f.select(key, F.lit(name).alias("_s")) for name, f in sources.items()]
    every = functools.reduce(DataFrame.unionByName, frames)
    return every.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("_s")), "+").alias("seen_in"), F.lit(all(complete[name] for name in sources)).alias("complete"))


def titles(files: DataFrame, links: DataFrame, sources: DataFrame, *, file: str, source: str, ordinal: str, title: str) -> DataFrame:
    """The title of each file: of its first source by ordinal, those without one last."""
    rows = links.join(sources.select(source, title), source)
    first = rows.groupBy(file).agg(F.min_by(title, F.struct(F.col(ordinal).isNull(), ordinal, source)).alias("title"))
    return files.select(file).join(first, file, "left")


def upload_refusal(extension: Column, size: Column, expanded: Column, *, allowed: list[str], most: int, most_expanded: int) -> Column:
    """Why a file isn't taken, or null: its type, its size, none at all, or what it expands to."""
    return F.when(~F.lower(extension).isin(allowed) | extension.isNull(), "type").when(size > most, "too_large").when(size == 0, "empty").when(expanded > most_expanded, "expands_too_large")


def download_refusal(declared: Column, size: Column, family: Column, promised: Column, *, most: int) -> Column:
    """Why stored bytes aren't what was asked for, or null: too many, none, cut off, or a page where a file was promised."""
    return F.when(size > most, "too_large").when(size == 0, "empty").when(declared != size, "truncated").when((family == "web") & (promised != "web"), "soft_404")


def kept_cache(cache: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Entries that stay when a cache is purged: those of the current version of a key that still exists."""
    return cache.join(current.select(key, version).distinct(), [key, version], "left_semi")


def conversion_summary(lines: DataFrame, by: str, outcome: str, *, accepted: list[str], attempted: list[str]) -> DataFrame:
    """Lines attempted and accepted, and the rate, by mapping."""
    tried, good = F.count_if(F.col(outcome).isin(attempted)), F.count_if(F.col(outcome).isin(accepted))
    return lines.groupBy(by).agg(tried.alias("attempted"), good.alias("accepted"), ratio(good, tried).alias("acceptance_rate"))


def orthography(text: Column) -> Column:
    """Struct of two signs of well-formed Devanagari: viramas to a letter, mean length of its words; null below 50 letters."""
    letters = F.regexp_count(text, F.lit(r"[ऀ-ॿ]"))
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(r"[ऀ-ॿ]"))
    mean = F.round(F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.size(words), 1)
    return F.when(letters >= 50, F.struct(ratio(F.regexp_count(text, F.lit("्")), letters).alias("halant_per_letter"), mean.alias("mean_word_length"), letters.alias("letters")))


def latest_jobs(documents: DataFrame, jobs: DataFrame, *, document: str, at: str, job: str, status: str) -> DataFrame:
    """Every document with the status of its latest job, null without one."""
    latest = jobs.groupBy(document).agg(F.max_by(status, F.struct(at, job)).alias("latest_status"), F.count("*").alias("jobs"))
    return documents.select(document).join(latest, document, "left").select(document, "latest_status", F.coalesce("jobs", F.lit(0)).alias("jobs"))


def turn_sources(chunks: DataFrame, *, turn: list[str], document: str, ordinal: str) -> DataFrame:
    """The documents that a turn's results came from, in the order in which they were first seen."""
    first = chunks.groupBy(*turn, document).agg(F.min(ordinal).alias("_at"))
    return first.groupBy(*turn).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", document))), lambda x: x[document]).alias("sources"))


def classified(url: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of section and kind of a page by the first rule whose path matches, and that rule as evidence; rules are data."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    out = F.struct(F.lit("other").alias("section"), F.lit("page").alias("kind"), F.lit("no rule").alias("evidence"))
    for pattern, section, kind in reversed(rules):
        out = F.when(path.rlike(pattern), F.struct(F.lit(section).alias("section"), F.lit(kind).alias("kind"), F.lit(f"path matches {pattern}").alias("evidence"))).otherwise(out)
    return out


def attachments(records: DataFrame, *, key: str, typed: str, linked: str) -> DataFrame:
    """(key, place, url, origin) of files that a record names: its typed fields first, then links of its body, each address once."""
    both = F.concat(F.transform(F.coalesce(F.col(typed), F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit("field").alias("origin"))), F.transform(F.coalesce(F.col(linked), F.array().cast("array<string>")), lambda u: F.struct(u.alias("url"), F.lit("body").alias("origin"))))
    rows = records.select(key, F.posexplode(both).alias("place", "a")).select(key, "place", "a.*")
    return rows.groupBy(key, "url").agg(F.min("place").alias("place"), F.min_by("origin", "place").alias("origin"))


def recovered_pages(units: DataFrame, *, document: str, page: str, ordinal: str, text: str, resolved: str) -> DataFrame:
    """Pages put together from the results of their units, in order; a unit without one is withheld, and its page isn't indexable."""
    parts = F.array_sort(F.collect_list(F.when(F.col(resolved), F.struct(ordinal, text))))
    out = units.groupBy(document, page).agg(parts.alias("_p"), F.count("*").alias("units"), F.count_if(~F.coalesce(F.col(resolved), F.lit(False))).alias("withheld"))
    return out.select(document, page, F.array_join(F.transform("_p", lambda p: p[text]), "\n").alias("text"), "units", "withheld", (F.col("withheld") == 0).alias("indexable"))
