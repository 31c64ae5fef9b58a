"""Connectors: queries asked of a service on the executors, and its answers as articles.

The fetcher is given by the caller, so that a test, a proxy or a cache can stand in for the
network; the shapes are those of the services' public JSON interfaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.dates import iso_date
from casegraph.functions.text import host
from casegraph.sources.ingest import property_text


def asked(queries: DataFrame, fetch: Callable[[str], str]) -> DataFrame:
    """``query, response, error``: what ``fetch`` gives for each query; one that fails costs
    only itself.  ``queries``: query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for q in batch["query"]:
                try:
                    rows.append((q, fetch(q), None))
                except Exception as e:  # noqa: BLE001  the fetcher is the caller's
                    rows.append((q, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["query", "response", "error"])

    return queries.select("query").mapInPandas(run, "query string, response string, error string")


def _articles(responses: DataFrame, items: Column, provenance: str, **fields: Column) -> DataFrame:
    """``query, provenance, title, url, publisher, text, published`` of the items of each answer."""
    rows = responses.select("query", F.explode(items).alias("x"))
    known = {"title": F.lit(None), "url": F.lit(None), "text": F.lit(None), "published": F.lit("")} | fields
    named = rows.select("query", F.lit(provenance).alias("provenance"), *[F.coalesce(v.cast("string"), F.lit("")).alias(k) for k, v in known.items()])
    publisher = host(F.col("url")) if "publisher" not in fields else F.col("publisher")
    return named.withColumn("publisher", publisher).filter((F.trim("title") != "") | (F.trim("text") != ""))


def encyclopedia(responses: DataFrame) -> DataFrame:
    """Articles of an encyclopedia's extracts by page."""
    pages = F.from_json("response", "query struct<pages: map<string, struct<title: string, extract: string, fullurl: string>>>")["query"]["pages"]
    return _articles(responses, F.map_values(pages), "encyclopedia", title=F.col("x.title"), url=F.col("x.fullurl"), text=F.col("x.extract"))


def news_index(responses: DataFrame) -> DataFrame:
    """Headlines of a news index; bodies are fetched elsewhere."""
    items = F.from_json("response", "articles array<struct<url: string, title: string, seendate: string, domain: string>>")["articles"]
    return _articles(responses, items, "news_index", title=F.col("x.title"), url=F.col("x.url"), publisher=F.col("x.domain"), published=iso_date(F.regexp_replace("x.seendate", "T.*$", "")))


def web_search(responses: DataFrame) -> DataFrame:
    """Hits of a web search with their snippets as text."""
    items = F.from_json("response", "items array<struct<title: string, link: string, snippet: string>>")["items"]
    return _articles(responses, items, "web_search", title=F.col("x.title"), url=F.col("x.link"), text=F.col("x.snippet"))


def sanctions(responses: DataFrame) -> DataFrame:
    """Listed entities with their properties as text."""
    items = F.from_json("response", "results array<struct<id: string, caption: string, properties: map<string, array<string>>>>")["results"]
    return _articles(responses, items, "sanctions", title=F.col("x.caption"), url=F.concat(F.lit("sanctions:"), "x.id"), publisher=F.lit("sanctions list"), text=property_text(F.col("x.properties")))
