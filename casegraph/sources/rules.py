"""Extractors by rule: what stands in for a language model where none is given.

They are column expressions, so a corpus is read without Python; any function from a text to
rows can take their place through :func:`casegraph.sources.ingest.extracted`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.names import found

NAME = r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"
DAY = r"\d{4}-\d{2}-\d{2}"
#: Words between a cause and its effect, and between an effect and its cause.
FORWARD, BACKWARD = "led to|resulted in|triggered", "because of|due to|caused by"


def entities(text: Column) -> Column:
    """Names of two words and more, each once, in order."""
    return F.array_distinct(found(F.coalesce(text, F.lit("")), NAME))


def dated_events(text: Column) -> Column:
    """``day, names, sentence`` of the sentences that hold a day and a name."""
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.struct(F.regexp_extract(s, DAY, 0).alias("day"), entities(s).alias("names"), F.trim(s).alias("sentence")))
    return F.filter(sentences, lambda s: (s["day"] != "") & (F.size(s["names"]) > 0))


def causal_claims(text: Column) -> Column:
    """``cause, effect, claim`` of the sentences that tie two names by a causal phrase."""

    def claim(sentence: Column, phrases: str, cause: int, effect: int) -> Column:
        pattern = f"({NAME})[^.!?]*?\\b(?:{phrases})\\b[^.!?]*?({NAME})"
        return F.struct(F.regexp_extract(sentence, pattern, cause).alias("cause"), F.regexp_extract(sentence, pattern, effect).alias("effect"), F.trim(sentence).alias("claim"))

    sentences = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    both = F.concat(F.transform(sentences, lambda s: claim(s, FORWARD, 1, 2)), F.transform(sentences, lambda s: claim(s, BACKWARD, 2, 1)))
    return F.filter(both, lambda c: (c["cause"] != "") & (c["cause"] != c["effect"]))


def with_vectors(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "text", name: str = "vector") -> DataFrame:
    """Rows with the vector that an embedding function gives for a column, a batch at a time;
    null texts have none."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        found = dict(zip(known.index, embed(known.tolist()), strict=True)) if len(known) else {}
        return pd.Series([found.get(i) for i in texts.index], index=texts.index, dtype=object)

    return rows.withColumn(name, vectors(F.col(column)))


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """Unit vectors of hashed words: the same text, the same vector, on every machine."""
    import math
    import zlib

    out = []
    for text in texts:
        vector = [0.0] * size
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            vector[h % size] += 1.0 if h >> 16 & 1 else -1.0
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        out.append([x / norm for x in vector])
    return out
