"""Web pages: fields, URL keys and passages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.chunks import page_chunks
from lodestar.functions.types import TEXT, struct
from lodestar.operators.lexical import words

FIELDS = struct(title=TEXT, published=TEXT, publisher=TEXT, text=TEXT)
SKIPPED = {"script", "style", "noscript", "svg"}
BREAKS = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "td"}
PUBLISHED = {"article:published_time", "date", "dc.date", "datepublished", "pubdate"}
PUBLISHER = {"og:site_name", "publisher", "dc.publisher", "application-name"}


class _Fields(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.meta, self.skip, self.in_title = [], [], {}, 0, False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BREAKS:
            self.parts.append("\n")
        elif tag == "meta":
            given = {k: v or "" for k, v in attrs}
            name = (given.get("property") or given.get("name") or given.get("itemprop") or "").lower()
            self.meta.setdefault(name, given.get("content", ""))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.parts.append(data)


def decode(data: bytes, charset: str | None) -> str:
    """By the given charset, else UTF-8; what can't be read is replaced."""
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def read_page(html: str | None) -> dict:
    page = _Fields()
    page.feed(html or "")
    page.close()
    lines = (" ".join(line.split()) for line in "".join(page.parts).split("\n"))
    first = lambda names: next((page.meta[n] for n in sorted(names) if page.meta.get(n)), "")
    return {"title": " ".join("".join(page.title).split()), "published": first(PUBLISHED), "publisher": first(PUBLISHER), "text": "\n".join(x for x in lines if x)}


@F.pandas_udf(FIELDS)
def page_fields(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(h) for h in html], columns=["title", "published", "publisher", "text"])


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, no fragment."""
    host = F.lower(F.regexp_extract(url, "^(https?://[^/]+)", 1))
    return F.concat(host, F.regexp_replace(F.regexp_extract(url, "^https?://[^/]+(.*)$", 1), "#.*$", ""))


def best_passages(pages: DataFrame, n: int) -> DataFrame:
    """The n chunks of each page that cover most words of its title; a whole title counts two more."""
    read = pages.select("page_id", page_fields("html").alias("p")).select("page_id", "p.title", F.posexplode(page_chunks("p.text")).alias("i", "c"))
    asked = F.array_distinct(words(F.col("title")))
    score = F.size(F.array_intersect(F.array_distinct(words(F.col("c.text"))), asked)) + F.when((F.length("title") > 0) & F.contains(F.lower("c.text"), F.lower("title")), 2).otherwise(0)
    ranked = read.select("page_id", F.col("c.chunk_no").alias("chunk_no"), score.alias("score"))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "chunk_no")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
