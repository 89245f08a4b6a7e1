"""Web pages, sitemaps and rate files as rows."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators.batches import bounded
from sheaf.operators.ranks import checkpointed

#: Elements whose text isn't shown, elements that break a line.
HIDDEN = {"script", "style", "head", "noscript", "svg"}
BLOCKS = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol", "header", "footer"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.text, self.links, self.meta, self.title = 0, [], [], {}, ""
        self._link: list | None = None
        self._in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag == "title":
            self._in_title = True
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "a" and given.get("href"):
            self._link = [given["href"], ""]
        if tag == "meta" and given.get("content"):
            self.meta.setdefault(given.get("property") or given.get("name") or "", given["content"])
        if tag == "link" and given.get("rel") == "canonical" and given.get("href"):
            self.meta.setdefault("canonical", given["href"])

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._in_title = False
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.text.append("\n")
        if tag == "a" and self._link:
            self.links.append((self._link[0], " ".join(self._link[1].split())))
            self._link = None

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        if not self.hidden:
            self.text.append(data)
            if self._link:
                self._link[1] += data


def read_page(html: str | None, url: str | None = None) -> dict:
    """Shown text (blank lines dropped, blanks squeezed), title, metadata and links of a page; broken markup is read as far as it goes."""
    page = _Page()
    page.feed(html or "")
    page.close()
    lines = (" ".join(line.split()) for line in "".join(page.text).split("\n"))
    links = []
    for href, text in page.links:
        if href.startswith("#"):
            continue
        try:
            target = urljoin(url or "", href)
            scheme = urlsplit(target).scheme
        except ValueError:
            continue
        if scheme in ("http", "https", ""):
            links.append({"url": target, "href": href, "text": text})
    return {"text": "\n".join(x for x in lines if x), "title": " ".join(page.title.split()), "canonical": page.meta.get("canonical"), "description": page.meta.get("og:description") or page.meta.get("description"), "links": links}


PAGE = "text string, title string, canonical string, description string, links array<struct<url:string,href:string,text:string>>"


def parse_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds the struct `page`: text, title, canonical, description and links. Pages go to Python in batches bounded by bytes, so its memory doesn't grow with the table."""
    bounded(pages.sparkSession)

    @F.pandas_udf(PAGE)
    def parse(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(a, b) for a, b in zip(h, u, strict=True)], columns=["text", "title", "canonical", "description", "links"])

    return pages.withColumn("page", parse(html, url))


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, href, text), the first of each target per page."""
    found = parse_pages(pages).select(key, F.posexplode("page.links").alias("place", "l")).select(key, "place", "l.*")
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(key, "url").orderBy("place"))).where("_r = 1").drop("_r")


def sitemap(documents: DataFrame, root: str, *, depth: int = 3, max_maps: int = 300, max_urls: int = 200_000) -> DataFrame:
    """(loc, lastmod) reachable from a root map, from maps given as (url, xml): breadth first, each map and page once, within
    the limits on depth, maps (nearest first, then by address) and pages. Each level is a join of the last one with the links, less what has been seen."""
    entry = "array<struct<loc:string,lastmod:string>>"
    parsed = documents.select(F.col("url").alias("map"), F.from_xml("xml", f"sitemap {entry}, url {entry}").alias("x")).select("map", "x.sitemap", "x.url")
    edges = checkpointed(parsed.select("map", F.explode("sitemap.loc").alias("loc")).select("map", F.trim("loc").alias("loc")).distinct())
    front = seen = documents.sparkSession.createDataFrame([(root,)], "map string")
    room = max_maps - 1
    for _ in range(depth):
        below = edges.join(front, "map", "left_semi").select(F.col("loc").alias("map")).distinct().join(seen, "map", "left_anti")
        front = checkpointed(below.orderBy("map").limit(max(0, room)))  # the frontier stays a table; its size alone is known here
        found = front.count()
        if not found:
            break
        room -= found
        seen = checkpointed(seen.unionByName(front))
    pages = parsed.join(seen, "map", "left_semi").select(F.explode("url").alias("u")).select(F.trim("u.loc").alias("loc"), "u.lastmod")
    return pages.groupBy("loc").agg(F.max("lastmod").alias("lastmod")).orderBy("loc").limit(max_urls)


def forex(days: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """Rates (date, currency, unit, buy, sell) and skipped quotes with a reason, from day documents; the first day of a date wins."""
    schema = "date string, published_on string, rates array<struct<currency:struct<iso3:string,unit:int>,buy:string,sell:string>>"
    parsed = days.select("ord", F.from_json(column, schema).alias("d")).select("ord", "d.*").where("date is not null")
    first = parsed.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy("ord"))).where("_r = 1")
    quotes = first.select("date", F.explode("rates").alias("r")).select("date", "r.currency.iso3", "r.currency.unit", "r.buy", "r.sell")
    number = lambda c: F.col(c).try_cast("decimal(18,6)")
    reason = F.when(F.col("buy").isNull() & F.col("sell").isNull(), "unquoted").when(number("buy").isNull() | number("sell").isNull(), "unreadable")
    marked = quotes.withColumn("reason", reason)
    good = marked.where("reason is null").select("date", F.col("iso3").alias("currency"), "unit", number("buy").alias("buy"), number("sell").alias("sell"))
    return good, marked.where("reason is not null").select("date", F.col("iso3").alias("currency"), "reason")


#: First bytes of families of files.
MAGIC = [(b"%PDF-", "pdf"), (b"PK\x03\x04", "zip"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "office_legacy"), (b"\x89PNG\r\n\x1a\n", "image"), (b"\xff\xd8\xff", "image"), (b"GIF8", "image"), (b"Rar!\x1a\x07", "archive"), (b"\x1f\x8b", "archive"), (b"7z\xbc\xaf\x27\x1c", "archive")]


def sniff(content: F.Column) -> F.Column:
    """The family of a file by its first bytes: magic numbers, flavours of zip, markup, then text or unknown."""
    head = F.substring(content, 1, 4096)
    starts = lambda b: F.startswith(F.hex(head), F.lit(b.hex().upper()))
    text = F.lower(F.trim(F.decode(head, "ISO-8859-1")))
    out = F.when(F.octet_length(head) == 0, "empty")
    for magic, family in MAGIC:
        if family == "zip":  # names of members stand in it as they are; Latin-1 shows every byte as one character
            names = F.decode(content, "ISO-8859-1")
            out = out.when(starts(magic) & names.contains("word/"), "document").when(starts(magic) & names.contains("xl/"), "spreadsheet").when(starts(magic), "archive")
        else:
            out = out.when(starts(magic), family)
    out = out.when(text.startswith("<!doctype html") | text.startswith("<html"), "web").when(text.startswith("<?xml"), "xml")
    return out.when(F.hex(head).rlike("^([0-9A-F]{2})*?(0[0-8EF]|1[0-9A-F])"), "unknown").otherwise("text")

