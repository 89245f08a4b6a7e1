"""Numbers in untidy text, ratios, ranks and vectors, as expressions that stay inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number type of parsed cells, and the currency signs a cell may carry.
DECIMAL, CURRENCY = "decimal(38,10)", "$€£₹¥"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times but computes it once, also within a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode's notion of it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def parse_number(c: Column) -> Column:
    """The value of a cell, or null if it isn't a number: `(5)` and a sign on either side of a currency sign are negative, `%`
    divides by 100, blanks (also no-break ones) and commas go, exponents count; nan and infinity are not numbers."""
    s = strip(c)
    paren = s.rlike(r"(?s)^\(.*\)$")
    inner = strip(F.regexp_replace(s, r"(?s)^\((.*)\)$", "$1"))
    percent = inner.endswith("%")
    body = strip(F.regexp_replace(inner, "%$", ""))
    shape = rf"(?Us)^([+-]?)\s*[{CURRENCY}\s]*([+-]?)\s*(.*)$"
    digits = F.regexp_replace(F.regexp_extract(body, shape, 3), "[ \u00a0\u202f,]", "")
    value = F.regexp_replace(digits, r"(?<=\d)_(?=\d)", "").try_cast(DECIMAL)
    scaled = F.when(percent, (value / 100).cast(DECIMAL)).otherwise(value)
    negative = paren | (F.regexp_extract(body, shape, 1) == "-") | (F.regexp_extract(body, shape, 2) == "-")
    return F.when(negative, -scaled).otherwise(scaled)


#: The same in the oracle's dialect, for a text expression `{c}`.
PARSE_NUMBER_SQL = r"""
(SELECT CASE WHEN neg THEN -v ELSE v END FROM (
  SELECT paren OR regexp_extract(body, '^([+-]?)\s*[$€£₹¥\s]*([+-]?)', 1) = '-' OR regexp_extract(body, '^([+-]?)\s*[$€£₹¥\s]*([+-]?)', 2) = '-' AS neg,
         CASE WHEN pct THEN CAST(n / 100 AS DECIMAL(38,10)) ELSE n END AS v
  FROM (SELECT *, TRY_CAST(regexp_replace(regexp_replace(body, '^[+-]?\s*[$€£₹¥\s]*[+-]?\s*', ''), '[ \x{{a0}}\x{{202f}},]', '', 'g') AS DECIMAL(38,10)) AS n
  FROM (SELECT *, trim(regexp_replace(inn, '%$', '')) AS body, suffix(inn, '%') AS pct
  FROM (SELECT trim({c}) LIKE '(%)' AS paren, CASE WHEN trim({c}) LIKE '(%)' THEN trim(trim({c})[2:-2]) ELSE trim({c}) END AS inn)))))
"""


def ratio(n: Column, d: Column, places: int = 4) -> Column:
    """n / d to four places, half up; 0 for an empty denominator."""
    return F.round(F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0)), places)


def show_number(c: Column) -> Column:
    """Thousands separators; whole numbers bare, others with two places."""
    return F.when(c == F.floor(c), F.format_number(c, 0)).otherwise(F.format_number(c, 2))


def nearest_rank(values: Column, fraction: float) -> Column:
    """Of a sorted array, the element at min(floor(fraction * n), n - 1); null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.least(F.floor(F.lit(fraction) * n), n - 1).cast("int")))


def clamp(c: Column, default: int, low: int, high: int) -> Column:
    """An integer within limits; the default where it can't be read."""
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """A rank's share in reciprocal rank fusion; 0 where the list doesn't hold the item."""
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def yes_no_probability(yes: Column, no: Column) -> Column:
    """Softmax over the log probabilities of yes and no; one side alone decides; neither gives one half."""
    return F.when(yes.isNull() & no.isNull(), 0.5).when(no.isNull(), F.lit(1.0)).when(yes.isNull(), F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(no - yes)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector or unequal widths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), 1.0 - dot(a, b) / norm)


def shorten_vector(a: Column, width: int) -> Column:
    """The first `width` numbers, of length 1; raises if there are fewer or all are 0."""
    head = F.slice(a, 1, width)
    norm = F.sqrt(dot(head, head))
    bad = (F.size(a) < width) | (norm == 0)
    return F.when(bad, F.raise_error(F.lit("vector is too short or zero"))).otherwise(F.transform(head, lambda x: x / norm))


def nice_step(span: Column, ticks: int = 5) -> Column:
    """A tick distance of 1, 2 or 5 times a power of ten that cuts the span into about `ticks` parts."""
    raw = span / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    share = raw / power
    return F.when(span <= 0, 1.0).otherwise(F.when(share <= 1, 1.0).when(share <= 2, 2.0).when(share <= 5, 5.0).otherwise(10.0) * power)
