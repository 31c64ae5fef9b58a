"""Articles: fan-in of sources, payloads, splitters, and files and pages as records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.sources import pdf

MAX_SPLIT_CHARS = 3000
#: Articles in one map of a payload, about.
PAYLOAD_ARTICLES = 1000


def fetched(sources: dict[str, DataFrame | None], wanted: list[str]) -> DataFrame:
    """The records of the wanted sources that are available, without those that have no text."""
    frames = [sources[i].withColumn("provenance", F.lit(i)) for i in dict.fromkeys(wanted) if sources.get(i) is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).filter(F.length(F.trim("text")) > 0)


def payload(articles: DataFrame) -> DataFrame:
    """One record for each article with a body or a title; a lost body gives way to the headline."""
    title, text = F.trim(F.coalesce("title", F.lit(""))), F.coalesce("text", F.lit(""))
    publisher = F.coalesce("publisher", F.lit("unknown"))
    headline = F.concat(F.lit("[HEADLINE ONLY ("), F.coalesce("error", F.lit("no body")), F.lit(")]\nTitle: "), title, F.lit("\nPublisher: "), publisher)
    rows = articles.filter((text != "") | (title != ""))
    return rows.select(
        "ord", "run", F.concat(publisher, F.lit("__"), "ord").alias("key"), title.alias("title"), publisher.alias("publisher"),
        F.when(text != "", text).otherwise(headline).alias("text"), (text != "").alias("body_available"),
    )


def combined_payload(articles: DataFrame, entity: str, most: int = PAYLOAD_ARTICLES) -> DataFrame:
    """Second-stage payload: bodies only, keyed by publisher, entity and place, in maps ``run, part, articles``.

    A run's maps hold some ``most`` articles each, so that a run may be of any size.
    """
    rows = payload(articles).filter("body_available")
    key = F.concat_ws("__", "publisher", F.lit(entity), "ord")
    parts = rows.groupBy("run").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))  # a row for each run
    parts = parts.withColumnRenamed("run", "of")
    dealt = rows.select("run", key.alias("key"), "text").join(F.broadcast(parts), F.col("run").eqNullSafe(F.col("of")))
    return dealt.groupBy("run", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "text")))).alias("articles"))


def titles(articles: DataFrame) -> DataFrame:
    """Articles with a title, without their bodies: what a first look at a query's results needs."""
    title = F.trim(F.coalesce("title", F.lit("")))
    return articles.filter(title != "").select("ord", "run", "publisher", title.alias("title"))


def property_text(properties: Column) -> Column:
    """A map of properties, each with several values, as lines ``name: value, value`` by name."""
    filled = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.struct(e["key"].alias("key"), F.filter(e["value"], lambda x: x.isNotNull() & (F.trim(x) != "")).alias("value")))
    lines = F.transform(F.filter(filled, lambda e: F.size(e["value"]) > 0), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    return F.array_join(lines, "\n")


def split_text(text: str | None, most: int = MAX_SPLIT_CHARS) -> list[str]:
    """A text within ``most`` characters as it is; a longer one as runs of whole lines that fit.

    A line that does not fit by itself is cut at every ``most`` characters, and stands
    apart from the lines around it.  Blank pieces go.  Null has no pieces.
    """
    if text is None or len(text) <= most:
        return [] if text is None else [text]
    pieces, run, room = [], [], most
    for line in text.split("\n"):
        if run and len(line) + 1 > room:
            pieces.append("\n".join(run))
            run = []
        if len(line) > most:
            pieces += [line[at : at + most] for at in range(0, len(line), most)]
        elif run or line:  # a piece does not begin with empty lines
            room = room - 1 - len(line) if run else most - len(line)
            run.append(line)
    return [x for x in [*pieces, "\n".join(run)] if x.strip()]


def expanded(articles: DataFrame, most: int = MAX_SPLIT_CHARS) -> DataFrame:
    """Long articles as several rows with ``part``."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: split_text(x, most))

    return articles.select("*", F.posexplode(pieces("text")).alias("part", "piece")).drop("text").withColumnRenamed("piece", "text")


def ingested(sources: list[DataFrame], most: int = MAX_SPLIT_CHARS) -> DataFrame:
    """Articles of several files and pages as one batch: those without text go, long ones are split."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return expanded(rows.filter(F.length(F.trim("text")) > 0), most)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Text and PDF files as articles: ``url, title, text, error, published``.

    Title is the first line with words, 200 characters at most, of a PDF without one its
    name; ``error`` tells that there is no text, or why a PDF cannot be read.
    """
    raw = spark.read.format("binaryFile").load(path)
    is_pdf = F.contains(F.substring(F.col("content"), 1, 1024), F.lit(b"%PDF-"))
    read = raw.select("path", "modificationTime", is_pdf.alias("is_pdf"), pdf.texts(F.when(is_pdf, F.col("content"))).alias("pdf"), F.when(~is_pdf, F.col("content").cast("string")).alias("plain"))
    text = F.coalesce("pdf.text", "plain")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    stem = F.when(F.col("is_pdf"), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    error = F.coalesce("pdf.error", F.when(F.size(lines) == 0, "no text"))
    return read.select(F.col("path").alias("url"), F.coalesce(F.substring(F.trim(F.get(lines, F.lit(0))), 1, 200), stem).alias("title"), text.alias("text"), error.alias("error"), F.col("modificationTime").alias("published"))


def pages(table: DataFrame) -> DataFrame:
    """Raw pages as articles without tags."""
    from casegraph.functions.text import host, without_tags

    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    body = F.trim(without_tags(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</\\1>", "")))
    return table.select(F.col("page_id").alias("ord"), title.alias("title"), host(F.col("url")).alias("publisher"), "url", body.alias("text"), F.when(body == "", "no text").alias("error"))


def extracted(chunks: DataFrame, extractor, schema: str) -> DataFrame:
    """Rows that an extractor draws from each chunk, with ``status``; a failing chunk costs only itself.

    ``extractor(text)`` gives a list of dicts of the columns of ``schema``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, x in zip(batch["chunk_id"], batch["text"], strict=True):
                try:
                    rows += [{"chunk_id": k, "status": "ok", **r} for r in extractor(x)]
                except Exception as e:  # noqa: BLE001  the extractor is the caller's
                    rows.append({"chunk_id": k, "status": f"failed: {e}"})
            names = ["chunk_id", "status", *[c.split()[0] for c in schema.split(", ")]]
            yield pd.DataFrame(rows, columns=names)

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id long, status string, {schema}")
