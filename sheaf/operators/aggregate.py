"""Aggregation over tables whose cells are all text, with exact accounting of what was counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.functions.numbers import DECIMAL, normal, parse_number, strip

FILTERS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains")
METRICS = ("sum", "avg", "min", "max", "count")


class UnknownColumn(ValueError):
    """A name that no header has; the message lists the headers."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class Metric:
    column: str
    op: str
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"{self.op}_{self.column}"


def resolve(headers: list[str], name: str) -> str:
    """The header that a name means: trimmed, case aside; of equal headers the last."""
    for header in reversed(headers):
        if header.strip().lower() == name.strip().lower():
            return header
    raise UnknownColumn(f"unknown column {name!r}; columns: {', '.join(headers)}")


def _cell(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def matches(cell: Column, f: Filter) -> tuple[Column, Column]:
    """Whether a cell matches, and whether a numeric test failed because the cell can't be read."""
    if f.op not in FILTERS:
        raise ValueError(f"unknown filter {f.op!r}; filters: {', '.join(FILTERS)}")
    number, wanted = parse_number(cell), parse_number(F.lit(str(f.value)))
    if f.op in ("gt", "gte", "lt", "lte"):
        test = {"gt": number > wanted, "gte": number >= wanted, "lt": number < wanted, "lte": number <= wanted}[f.op]
        return F.coalesce(test, F.lit(False)), number.isNull() & (strip(cell) != "")
    if f.op == "contains":
        return F.contains(normal(cell), normal(F.lit(str(f.value)))), F.lit(False)
    same = F.when(number.isNotNull() & wanted.isNotNull(), number == wanted).otherwise(normal(cell) == normal(F.lit(str(f.value))))
    return (same if f.op == "eq" else ~same), F.lit(False)


def _marked(rows: DataFrame, filters: list[Filter], headers: list[str]) -> DataFrame:
    """Adds _keep, and _skip_i where the i-th filter met an unreadable cell in a row that the filters before it kept."""
    keep, out = F.lit(True), rows
    for i, f in enumerate(filters):
        match, bad = matches(_cell(resolve(headers, f.column)), f)
        out = out.withColumn(f"_skip_{i}", keep & bad)
        keep = keep & match
    return out.withColumn("_keep", keep)


def _scanned(rows: DataFrame, headers: list[str], ordinal: str, max_rows: int | None) -> DataFrame:
    """Rows that aren't blank throughout; if there is a ceiling, the first of them by the ordinal."""
    full = rows.where(F.exists(F.array(*[_cell(h) for h in headers]), lambda c: strip(c) != ""))
    return full if max_rows is None else full.orderBy(ordinal).limit(max_rows)


def aggregate(rows: DataFrame, *, ordinal: str, metrics: list[Metric] = [], group_by: str | None = None, filters: list[Filter] = [], max_scan_rows: int | None = None, max_groups: int | None = 50) -> DataFrame:  # noqa: B006
    """Filter, group and measure a table of text cells: columns group, rows, and one per metric (count: long, others decimal).

    Groups are told apart by trimmed lower case and shown in the spelling seen first by `ordinal`; blank is `(blank)`. Cells
    that can't be read don't count; a metric over no readable cell is null. Without `group_by` there is one row
    `(all)`, also over no rows; with it, no rows give no groups. The largest `max_groups` by the first metric come out (nulls last,
    then by group), with the number of all groups in `total_groups`.
    """
    for m in metrics:
        if m.op not in METRICS:
            raise ValueError(f"unknown metric {m.op!r}; metrics: {', '.join(METRICS)}")
    headers = [c for c in rows.columns if c != ordinal]
    kept = _marked(_scanned(rows, headers, ordinal, max_scan_rows), filters, headers).where("_keep")
    numbers = {resolve(headers, m.column) for m in metrics if m.op != "count"}
    kept = kept.select("*", *[parse_number(_cell(h)).alias(f"_n_{i}") for i, h in enumerate(sorted(numbers))])
    at = {h: F.col(f"_n_{i}") for i, h in enumerate(sorted(numbers))}

    def measure(m: Metric) -> Column:
        h = resolve(headers, m.column)
        if m.op == "count":
            return F.count_if(strip(_cell(h)) != "").alias(m.label)
        if m.op == "avg":
            return (F.sum(at[h]) / F.count(at[h])).cast(DECIMAL).alias(m.label)
        return {"sum": F.sum, "min": F.min, "max": F.max}[m.op](at[h]).cast(DECIMAL).alias(m.label)

    measures = [F.count("*").alias("rows"), *map(measure, metrics)]
    if group_by is None:
        return kept.agg(*measures).select(F.lit("(all)").alias("group"), "*", F.lit(1).cast("long").alias("total_groups"))
    own = _cell(resolve(headers, group_by))
    key, shown = normal(own), F.when(strip(own) == "", "(blank)").otherwise(strip(own))
    groups = kept.groupBy(key.alias("_key")).agg(F.min_by(shown, F.col(ordinal)).alias("group"), *measures).drop("_key")
    order = [F.col(f"`{metrics[0].label}`").desc_nulls_last() if metrics else F.col("rows").desc(), F.col("group")]
    total = groups.agg(F.count("*").alias("total_groups"))  # one row; the grouping's exchange is reused
    out = groups.crossJoin(F.broadcast(total))
    return out if max_groups is None else out.orderBy(*order).limit(max_groups)


def accounting(rows: DataFrame, *, ordinal: str, columns: list[str], filters: list[Filter] = [], max_examples: int = 3) -> DataFrame:  # noqa: B006
    """Per numeric column, over the rows that the filters keep: matched, parsed, skipped (not readable), blank, and the first
    distinct offending cells in order of the ordinal. One pass; examples are pre-aggregated per spelling."""
    headers = [c for c in rows.columns if c != ordinal]
    kept = _marked(_scanned(rows, headers, ordinal, None), filters, headers).where("_keep")
    names = list(dict.fromkeys(resolve(headers, c) for c in columns))
    long = kept.select(F.col(ordinal).alias("_at"), F.explode(F.array(*[F.struct(F.lit(h).alias("column"), strip(_cell(h)).alias("cell"), parse_number(_cell(h)).alias("number")) for h in names])).alias("c")).select("_at", "c.*")
    bad = F.col("number").isNull() & (F.col("cell") != "")
    by_cell = long.groupBy("column", F.when(bad, F.col("cell")).alias("offender")).agg(F.count("*").alias("n"), F.count("number").alias("parsed"), F.count_if(bad).alias("skipped"), F.count_if(F.col("cell") == "").alias("blank"), F.min("_at").alias("at"))
    totals = by_cell.groupBy("column").agg(F.sum("n").alias("matched"), F.sum("parsed").alias("parsed"), F.sum("skipped").alias("skipped"), F.sum("blank").alias("blank"))
    # the filter on the place lets each task keep its first few per column before they meet
    place = F.row_number().over(Window.partitionBy("column").orderBy("at", "offender"))
    first = by_cell.where("offender is not null").select("column", "offender", place.alias("place")).where(F.col("place") <= max_examples)
    examples = first.groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "offender"))), lambda x: x.offender).alias("examples"))
    none = F.expr("cast(array() as array<string>)")
    return totals.join(examples, "column", "left").select("column", "matched", "parsed", "skipped", "blank", F.coalesce("examples", none).alias("examples"))


def filter_skips(rows: DataFrame, *, ordinal: str, filters: list[Filter]) -> DataFrame:
    """Per filter, in order: how many cells its numeric test could not read among the rows that earlier filters kept."""
    headers = [c for c in rows.columns if c != ordinal]
    marked = _marked(_scanned(rows, headers, ordinal, None), filters, headers)
    counts = marked.agg(F.count("*").alias("scanned"), F.count_if(F.col("_keep")).alias("matched"), *[F.count_if(F.col(f"_skip_{i}")).alias(f"s{i}") for i in range(len(filters))])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f"{f.column} {f.op} {f.value}").alias("filter"), F.col(f"s{i}").alias("skipped")) for i, f in enumerate(filters)])
    return counts.select("scanned", "matched", F.explode(pairs).alias("p")).select("p.position", "p.filter", "p.skipped", "scanned", "matched")


def scan_flag(rows: DataFrame, ordinal: str, max_scan_rows: int) -> DataFrame:
    """Whether a scan with this ceiling leaves rows unread: the ceiling is tested before blank rows are passed over, so any row
    after the last scanned one sets it."""
    headers = [c for c in rows.columns if c != ordinal]
    last = _scanned(rows, headers, ordinal, max_scan_rows).agg(F.max(ordinal).alias("last"), F.count("*").alias("scanned"))
    return rows.crossJoin(F.broadcast(last)).agg(F.first("scanned").alias("rows_scanned"), (F.first("scanned").eqNullSafe(F.lit(max_scan_rows)) & (F.max(ordinal) > F.first("last"))).alias("scan_truncated"))
