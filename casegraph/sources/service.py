"""A search service as a data source of Spark: ``format("search_service")``.

Each query is asked on an executor, in a partition of some queries.  What a service gives
is kept as text for the parsers in :mod:`casegraph.sources.connectors`; a query that fails
is a row with its error, and costs only itself.  As a stream, the service is asked day by
day: the offset is the last day that has been read, so a restart goes on where it stopped.

Options: ``fetcher`` (``module:function``, importable on executors; called with a query and,
on a stream, a day), ``queries`` (JSON array), ``each`` (queries in a partition, 10), and for
streams ``since`` and ``until`` (ISO days, until today by default).
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "query string, day string, response string, error string"


@dataclass
class _Queries(InputPartition):
    """Some queries, and the days for which they are asked (None: without a day)."""

    queries: list
    days: list


def _ask(fetcher: str, part: _Queries) -> Iterator[tuple]:
    module, name = fetcher.split(":")
    fetch = getattr(importlib.import_module(module), name)
    for day in part.days:
        for query in part.queries:
            try:
                yield query, day, (fetch(query) if day is None else fetch(query, day)), None
            except Exception as e:  # noqa: BLE001  the fetcher is the caller's
                yield query, day, None, f"{type(e).__name__}: {e}"


class _Options:
    def __init__(self, options: dict) -> None:
        if ":" not in options.get("fetcher", ""):
            raise ValueError("fetcher is module:function")
        self.fetcher = options["fetcher"]
        self.queries = list(dict.fromkeys(json.loads(options.get("queries", "[]"))))
        self.each = max(1, int(options.get("each", 10)))
        self.since = date.fromisoformat(options.get("since", "1970-01-01"))
        self.until = options.get("until")

    def parts(self, days: list) -> list[_Queries]:
        return [_Queries(self.queries[i : i + self.each], days) for i in range(0, len(self.queries), self.each)]


class _Reader(DataSourceReader):
    """Asks each query once.  Conditions on the query choose what is asked at all."""

    def __init__(self, options: _Options) -> None:
        self.options = options

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            if isinstance(x, EqualTo | In) and x.attribute == ("query",):
                wanted = {x.value} if isinstance(x, EqualTo) else set(x.value)
                self.options.queries = [q for q in self.options.queries if q in wanted]
            else:
                yield x

    def partitions(self) -> list[_Queries]:
        return self.options.parts([None]) or [_Queries([], [])]

    def read(self, partition: _Queries) -> Iterator[tuple]:
        return _ask(self.options.fetcher, partition)


class _StreamReader(DataSourceStreamReader):
    """Asks each query for each day that has come since the last offset."""

    def __init__(self, options: _Options) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"day": str(self.options.since - timedelta(days=1))}

    def latestOffset(self) -> dict:
        last = date.fromisoformat(self.options.until) if self.options.until else date.today()
        return {"day": str(max(last, self.options.since - timedelta(days=1)))}

    def partitions(self, start: dict, end: dict) -> list[_Queries]:
        first, last = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        days = [str(first + timedelta(days=i + 1)) for i in range((last - first).days)]
        return [p for day in days for p in self.options.parts([day])] or [_Queries([], [])]

    def read(self, partition: _Queries) -> Iterator[tuple]:
        return _ask(self.options.fetcher, partition)


class SearchService(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return "search_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchService)
