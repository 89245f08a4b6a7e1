"""Nested documents (JSON text) into flat records: paths and types from a table of rules, what doesn't fit kept as evidence."""

from __future__ import annotations

import html
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import squeeze
from sheaf.functions.urls import normalize_url

#: Kinds of variant values that count as each type of rule.
KINDS = {"long": ["BIGINT"], "double": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "string": ["STRING"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
SQL_TYPES = {"long": "long", "double": "double", "string": "string", "boolean": "boolean", "object": "variant", "array": "array<variant>"}
#: Fields of a post's extra block that are machinery or files, never facts about the document.
MECHANICAL = "document_file secondary_file photos banner_details no_homepage document_new_tag_duration document_redirect_to_file".split()


@dataclass(frozen=True)
class Rule:
    """A column of the record: its name, where it stands in the document and what type it must have there."""

    name: str
    path: str
    type: str


#: Rules of a content system's posts.
POST = [
    Rule("post_id", "$.id", "long"), Rule("post_type", "$.type", "string"), Rule("canonical_url", "$.link", "string"), Rule("slug", "$.slug", "string"), Rule("title", "$.title.rendered", "string"), Rule("published", "$.date", "string"),
    Rule("published_gmt", "$.date_gmt", "string"), Rule("modified", "$.modified", "string"), Rule("status", "$.status", "string"), Rule("redirects_to_file", "$.acf.document_redirect_to_file", "boolean"),
]


def kind(v: Column) -> Column:
    """The outermost kind of a variant (BIGINT, DECIMAL, DOUBLE, STRING, BOOLEAN, OBJECT, ARRAY, VOID), null if there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def flatten(df: DataFrame, json: str, rules: list[Rule]) -> DataFrame:
    """Adds a column for each rule, `malformed` (text that isn't JSON, or no object) and `evidence`.

    A value counts only if it has the rule's type as it stands: "5" is no number, a number no string, a fraction no long. Anything else (an explicit
    null aside) leaves the column null and a line `name: expected type, found KIND: value` in `evidence`. A null text is malformed and has
    nulls only. Each text is parsed once.
    """
    v, own = F.col("__v"), [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    parsed = df.withColumn("__v", F.try_parse_json(F.col(json))).withColumn("__k", kind(v))
    found = parsed.select(*own, "__v", "__k", *[at(v, r.path).alias(f"__{i}") for i, r in enumerate(rules)])
    values, evidence = [], []
    for i, r in enumerate(rules):
        x, k = F.col(f"__{i}"), kind(F.col(f"__{i}"))
        fits = k.isin(KINDS[r.type])
        values.append(F.when(fits, F.try_variant_get(x, "$", SQL_TYPES[r.type])).alias(r.name))
        evidence.append(F.when(~fits & (k != "VOID"), F.concat(F.lit(f"{r.name}: expected {r.type}, found "), k, F.lit(": "), F.to_json(x))))
    malformed = F.coalesce(F.col("__k") != "OBJECT", F.lit(True))
    return found.select(*own, *values, malformed.alias("malformed"), F.array_compact(F.array(*evidence)).alias("evidence"))


def unescaped(c: Column) -> Column:
    """Text with HTML's entities resolved."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return run(c)


def posts(df: DataFrame, json: str) -> DataFrame:
    """Flat records of posts: the columns of POST, url (normalised), category_ids (the whole numbers of `categories`), extras (scalars of `acf` that
    are facts: no machinery, no flags, nothing blank; as text) and warnings (a missing link, then the evidence). A post with any gap still gives a record."""
    flat = flatten(df, json, POST)
    v = F.try_parse_json(F.col(json))
    scalar = lambda x: kind(x).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE")
    ids = F.transform(F.filter(F.try_variant_get(v, "$.categories", "array<variant>"), lambda x: kind(x) == "BIGINT"), lambda x: x.cast("long"))
    facts = F.map_filter(F.try_variant_get(v, "$.acf", "map<string,variant>"), lambda k, x: ~k.isin(MECHANICAL) & scalar(x))
    texts = F.map_filter(F.transform_values(facts, lambda _, x: x.cast("string")), lambda _, x: x.rlike(r"\S"))
    link = F.when(F.col("canonical_url") != "", F.col("canonical_url"))
    raw = squeeze(F.when(F.col("title").contains("&"), unescaped(F.col("title"))).otherwise(F.col("title")))
    out = flat.withColumns({"canonical_url": link, "title": F.when(raw != "", raw), "category_ids": F.coalesce(ids, F.array().cast("array<long>")), "extras": F.coalesce(texts, F.create_map().cast("map<string,string>"))})
    return out.withColumn("url", normalize_url(F.col("canonical_url"))).withColumn("warnings", F.concat(F.when(F.col("canonical_url").isNull(), F.array(F.lit("post has no link"))).otherwise(F.array().cast("array<string>")), F.col("evidence"))).drop("evidence")


def paths(df: DataFrame, json: str, depth: int = 3) -> DataFrame:
    """(path, kind, n): how often each path of objects, `depth` names deep at most, holds a value of each kind. Values are exploded where they are and
    counted with partial sums, so neither wide nor common documents meet in a task."""
    spark = df.sparkSession
    level = df.select(F.try_parse_json(F.col(json)).alias("v"), F.lit("$").alias("path"))
    counts = []
    for _ in range(depth):
        below = level.where(kind(F.col("v")) == "OBJECT").lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("v"), F.concat("path", F.lit("."), "key").alias("path"))
        counts.append(below.groupBy("path", kind(F.col("v")).alias("kind")).agg(F.count("*").alias("n")))
        level = below
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def column_types(df: DataFrame, json: str, depth: int = 3) -> DataFrame:
    """(path, type, n, others): the commonest kind of each path (ties: the first by name), its count, and how many values have another one."""
    by = paths(df, json, depth).groupBy("path").agg(F.min(F.struct((-F.col("n")).alias("less"), "kind", "n")).alias("most"), F.sum("n").alias("total"))
    return by.select("path", F.col("most.kind").alias("type"), F.col("most.n").alias("n"), (F.col("total") - F.col("most.n")).alias("others"))
