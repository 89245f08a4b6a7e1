"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.numbers import let, strip

ELLIPSIS = "…"


def squeeze(c: Column) -> Column:
    """White space runs become one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clip(c: Column, limit: int = 500) -> Column:
    """A longer cell is cut and marked; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(ELLIPSIS))).otherwise(c)


def title(c: Column, limit: int = 80) -> Column:
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit(ELLIPSIS)))


def preview(c: Column, limit: int = 300) -> Column:
    return F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, limit)


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "-")
    s = F.regexp_replace(s, "^[.-]+|[.-]+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "misc").otherwise(s)


def heading(c: Column) -> Column:
    """A heading for comparison: lower case, one blank between words, no punctuation at the ends."""
    return F.regexp_replace(F.lower(squeeze(c)), r"^[\p{P}\s]+|[\p{P}\s]+$", "")


def cited(c: Column, n: Column) -> Column:
    """Numbers from 1 to n in brackets of up to three digits, distinct, in order of their first occurrence."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda x: (x >= 1) & (x <= n)))


def like_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def name_tokens(c: Column) -> Column:
    """Parts of a tool name: camel case and separators split it."""
    s = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")


def storage_key(sha256: Column, extension: Column) -> Column:
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), sha256, F.when(F.coalesce(extension, F.lit("")) != "", F.concat(F.lit("."), extension)).otherwise(F.lit("")))


def split_lines(c: Column) -> Column:
    """Lines as text editors count them: also at vertical tabs, form feeds, separators 1C to 1E, NEL, LS and PS; no line
    after a final break."""
    parts = F.split(F.regexp_replace(c, "\r\n", "\n"), "[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))
