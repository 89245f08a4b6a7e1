"""Paged collections from stored responses: a data source that plans a partition for each page, and the rules by which a walk ends."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Fixed value: a walk never asks for more pages than this.
MAX_PAGES = 1000
RESPONSES = "collection string, page int, status int, total long, body string, error string"


def responses_facts(responses: DataFrame, per_page: int) -> DataFrame:
    """What decides about each page, without its body: items, and why a walk would end there (null: it goes on)."""
    shape = F.regexp_extract(F.schema_of_variant(F.try_parse_json(F.col("body"))), "^[A-Z]+", 0)
    items = F.when(shape == "ARRAY", F.expr("json_array_length(body)"))
    stop = F.when((F.col("status") != 200) | F.col("error").isNotNull(), "error").when(items.isNull(), "malformed").when(items == 0, "empty").when(items < per_page, "short page")
    return responses.select("collection", "page", "status", "total", "error", F.coalesce(items, F.lit(0)).cast("long").alias("n"), stop.alias("stop"))


def walk(responses: DataFrame, *, per_page: int = 100, max_pages: int = MAX_PAGES, max_items: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Items and outcomes of walks over collections, from responses (collection, page, status, total, body, error).

    A walk takes pages from 1 on and ends at the first that fails, isn't a JSON array, is empty or short, or is missing, or after `max_pages`
    pages or with the page that reaches `max_items` items; what comes later is not read. A status of 400 after the promised total (of the first page that
    gives one) has come is an end, not an error. Items: (collection, page, pos, item) with the item as JSON; outcomes: a row for each collection with
    pages, items, total, ended (why) and error, so a hole in a collection is a row and raises nothing. The window sees a few numbers a page, of at most
    max_pages + 1 pages a collection, never bodies. Of repeated pages the one with the smallest body counts.
    """
    once = responses.where(F.col("page").between(1, max_pages + 1)).groupBy("collection", "page").agg(F.min_by(F.struct("status", "total", "body", "error"), F.coalesce("body", F.lit(""))).alias("r")).select("collection", "page", "r.*")
    w = Window.partitionBy("collection").orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = responses_facts(once, per_page).withColumn("gap", F.col("page") != F.coalesce(F.lag("page").over(w), F.lit(0)) + 1).withColumn("had", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("promised", F.first("total", ignorenulls=True).over(before))
    enough = F.lit(False) if max_items is None else F.col("had") + F.col("n") >= max_items
    reason = F.when(F.col("gap"), "missing page").when(F.col("page") > max_pages, "too many pages").when(F.col("stop") == "error", F.when((F.col("status") == 400) & (F.col("had") >= F.col("promised")), "past the end").otherwise("error")).when(F.col("stop").isNotNull(), F.col("stop")).when(enough, "enough items")
    judged = seen.withColumn("ended", reason)
    taken = judged.withColumn("over", F.coalesce(F.max(F.when(F.col("ended").isNotNull(), F.lit(1))).over(before), F.lit(0))).where("over = 0").withColumn("read", ~F.coalesce(F.col("ended").isin("missing page", "too many pages", "error", "past the end", "malformed"), F.lit(False)))
    room = F.col("n") if max_items is None else F.least(F.col("n"), F.lit(max_items) - F.col("had"))
    kept = taken.where("read and n > 0").select("collection", "page", room.alias("room"))
    items = once.join(kept, ["collection", "page"]).select("collection", "page", "room", F.posexplode(F.from_json("body", "array<string>")).alias("pos", "item")).where("pos < room").drop("room")
    wrong = F.col("ended").isin("error", "malformed", "missing page")
    outcomes = taken.groupBy("collection").agg(
        F.count_if("read").alias("pages"), F.sum(F.when(F.col("read"), room).otherwise(0)).alias("items"), F.min_by("total", F.when(F.col("total").isNotNull(), F.col("page"))).alias("total"), F.coalesce(F.max("ended"), F.lit("last stored page")).alias("ended"),
        F.max(F.when(wrong, F.concat_ws(" ", F.lit("page"), F.col("page").cast("string"), F.coalesce("error", F.when(F.col("ended") == "error", F.concat(F.lit("status "), "status")).otherwise(F.col("ended")))))).alias("error"),
    )
    return items, outcomes


@dataclass
class Page(InputPartition):
    number: int


class CollectionSource(DataSource):
    """spark.read.format("collection"): RESPONSES of the pages of one collection, a partition each.

    Options: `path`, a pattern of stored responses with `{page}` in it, on a mount that all executors share, each file a JSON object of status, headers and
    body; `per_page` (100). The first page is read while the plan is made: its X-WP-Total says how many pages there are; without it the files that
    are there do. Comparisons of `page` with numbers are pushed down, so pages that aren't wanted are never opened (spark.sql.python.filterPushdown.enabled must be true). A file that is missing or no
    JSON gives a row with `error`.
    """

    @classmethod
    def name(cls) -> str:
        return "collection"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> DataSourceReader:
        return CollectionReader(dict(self.options))


class CollectionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "{page}" not in options.get("path", ""):
            raise ValueError("the option path needs {page} in it")
        self.path, self.per_page = options["path"], int(options.get("per_page", options.get("perPage", 100)))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | In) and f.attribute == ("page",):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, page: int) -> bool:
        def holds(f: Filter) -> bool:
            if isinstance(f, In):
                return page in f.value
            return {EqualTo: page == f.value, GreaterThan: page > f.value, GreaterThanOrEqual: page >= f.value, LessThan: page < f.value, LessThanOrEqual: page <= f.value}[type(f)]

        return all(map(holds, self.tests))

    def partitions(self) -> list[InputPartition]:
        first = self.fetch(1)
        if first[3] is not None:
            last = max(1, -(-first[3] // self.per_page))
        else:
            whole = Path(self.path)
            number = re.compile(re.escape(whole.name).replace(re.escape("{page}"), r"(\d+)"))
            last = max([1, *(int(m[1]) for p in whole.parent.glob("*") if (m := number.fullmatch(p.name)))])
        return [Page(n) for n in range(1, min(last, MAX_PAGES) + 1) if self.wanted(n)]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield self.fetch(partition.number)

    def fetch(self, page: int) -> tuple:
        path = self.path.replace("{page}", str(page))
        name = Path(self.path).parent.name
        try:
            told = json.loads(Path(path).read_text(encoding="utf-8"))
            headers = {k.lower(): str(v) for k, v in (told.get("headers") or {}).items()}
            total = headers.get("x-wp-total", "")
            return name, page, int(told.get("status", 0)), int(total) if total.isdigit() else None, json.dumps(told.get("body"), ensure_ascii=False), None
        except (OSError, ValueError, AttributeError) as error:
            return name, page, 0, None, None, f"{type(error).__name__}: {path}"
