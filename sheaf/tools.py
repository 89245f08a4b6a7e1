"""Named tools, each a table and a dictionary of arguments to a table, with the checks of their arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import dates
from sheaf.functions.calculator import compile_expression
from sheaf.functions.numbers import show_number
from sheaf.operators import aggregate, chunking, reports, retrieval
from sheaf.sources import files, web

Tool = Callable[[DataFrame, dict], DataFrame]


class BadArgument(ValueError):
    """An argument that a tool can't use; the message says what it takes."""


@dataclass(frozen=True)
class Spec:
    name: str
    purpose: str
    required: dict[str, type | tuple[type, ...]]
    run: Tool


TOOLS: dict[str, Spec] = {}


def tool(name: str, purpose: str, **required: type | tuple[type, ...]) -> Callable[[Tool], Tool]:
    def put(run: Tool) -> Tool:
        TOOLS[name] = Spec(name, purpose, required, run)
        return run

    return put


def call(name: str, table: DataFrame, arguments: dict) -> DataFrame:
    """Run a tool by name; unknown names, missing arguments and arguments of another type are refused."""
    spec = TOOLS.get(name)
    if spec is None:
        raise BadArgument(f"no tool {name!r}; tools: {', '.join(sorted(TOOLS))}")
    for key, kind in spec.required.items():
        if not isinstance(arguments.get(key), kind):
            raise BadArgument(f"{name} needs {key!r}")
    return spec.run(table, arguments)


def entries(given: object, what: str, keys: tuple[str, ...], ops: tuple[str, ...]) -> list[dict]:
    """A list of dictionaries with a column, a known operation and the other keys; none for null."""
    if given is None:
        return []
    if not isinstance(given, list) or not all(isinstance(x, dict) for x in given):
        raise BadArgument(f"{what}: a list of objects with {', '.join(keys)}")
    out = [{k: str(x.get(k, "") if x.get(k) is not None else "").strip() for k in keys} for x in given]
    for x in out:
        x["op"] = x["op"].lower()
        if not x["column"]:
            raise BadArgument(f"{what}: each needs a column")
        if x["op"] not in ops:
            raise BadArgument(f"{what}: unknown op {x['op']!r}; ops: {', '.join(ops)}")
    return out


def shown(result: DataFrame, metrics: list[aggregate.Metric]) -> DataFrame:
    """An aggregate as it is shown: numbers as text, a dash for none."""
    number = lambda c: F.coalesce(show_number(F.col(f"`{c}`")), F.lit("—")).alias(c)
    return result.select("group", number("rows"), *[number(m.label) for m in metrics], "total_groups")


@tool("aggregate", "filter, group and measure a table of text cells")
def aggregate_table(table: DataFrame, arguments: dict) -> DataFrame:
    metrics = [aggregate.Metric(x["column"], x["op"]) for x in entries(arguments.get("metrics"), "metrics", ("column", "op"), aggregate.METRICS)]
    filters = [aggregate.Filter(x["column"], x["op"], x["value"]) for x in entries(arguments.get("filters"), "filters", ("column", "op", "value"), aggregate.FILTERS)]
    return shown(aggregate.aggregate(table, ordinal=arguments.get("ordinal", "row_ord"), metrics=metrics, filters=filters, group_by=arguments.get("group_by")), metrics)


@tool("rows", "a window of rows and columns", columns=list)
def rows(table: DataFrame, arguments: dict) -> DataFrame:
    start, order = max(1, int(arguments.get("start", 1))), arguments.get("ordinal", "row_ord")
    page = table.where(F.col(order).between(start, start + min(200, max(1, int(arguments.get("rows", 50)))) - 1))
    return files.project(page, [order, *arguments["columns"]])


@tool("inspect", "headers, size and first rows of a table")
def inspect(table: DataFrame, arguments: dict) -> DataFrame:
    return files.inspect(table, int(arguments.get("sample", 10)))


@tool("calculate", "a checked expression over the columns of a table", expression=str)
def calculate(table: DataFrame, arguments: dict) -> DataFrame:
    return table.withColumn("result", compile_expression(arguments["expression"], {c: F.col(f"`{c}`") for c in table.columns}))


@tool("days_between", "whole days and the rest between two columns of dates", first=str, last=str)
def days_between(table: DataFrame, arguments: dict) -> DataFrame:
    return table.withColumn("difference", dates.human(dates.parse_iso(F.col(arguments["first"])), dates.parse_iso(F.col(arguments["last"]))))


@tool("search", "the passages of one department nearest to a question", vector=list, text=str, department=(int, str))
def search(table: DataFrame, arguments: dict) -> DataFrame:
    return retrieval.search(table, arguments["vector"], arguments["text"], department=arguments["department"])


@tool("passages", "ranked passages cut to a budget", budget=int)
def passages(table: DataFrame, arguments: dict) -> DataFrame:
    return reports.budgeted(table, query="query", place="place", text="content", budget=arguments["budget"], fixed=int(arguments.get("header", 0)))


@tool("read_lines", "whole lines of documents and where to go on")
def read_lines(table: DataFrame, arguments: dict) -> DataFrame:
    return reports.line_page(table, doc="doc_id", ordinal="line", text="text", start=max(1, int(arguments.get("start", 1))), most=int(arguments.get("lines", 200)), budget=int(arguments.get("budget", 8_000)))


@tool("page_text", "title, text and links of web pages")
def page_text(table: DataFrame, arguments: dict) -> DataFrame:
    return web.parse_pages(table).select(*[c for c in table.columns if c != "html"], "page.*")


@tool("rates", "exchange rates of day documents; a currency by its three letters")
def rates(table: DataFrame, arguments: dict) -> DataFrame:
    found, currency = web.forex(table)[0], str(arguments.get("currency") or "").strip().upper()
    return found.where(F.col("currency") == currency) if currency else found


@tool("local_time", "a column of instants as a wall clock", column=str)
def local_time(table: DataFrame, arguments: dict) -> DataFrame:
    return table.withColumn("local", dates.local_time(F.col(arguments["column"]), arguments.get("offset", "+05:45")))


@tool("chunks", "overlapping chunks of documents")
def chunks(table: DataFrame, arguments: dict) -> DataFrame:
    return chunking.chunk(table, max_chars=int(arguments.get("max_chars", 2000)), overlap=int(arguments.get("overlap", 200)))
