"""SimHash fingerprints of whole texts, and the search for those within a Hamming radius.

Terms are windows of five words, weighted by how often they occur; each votes on every
bit of the fingerprint with its hash.  For the search, fingerprints are cut into blocks;
two that differ in at most ``radius`` bits agree in some choice of blocks, so one table
for each choice, keyed by those blocks in front, finds every such pair.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.scratch import materialize
from casegraph.llm.text import mix64, shingle_hashes, word_hashes

BITS = 128
TERM_WORDS = 5
_RUN = 4096
#: Ranges of the key, at most: beyond that they grow, and are streamed in order.
MAX_BLOCKS = 20_000


def simhash(text: str) -> bytes:
    """The fingerprint of a text, 16 bytes; zeros without words."""
    terms = shingle_hashes(word_hashes(text.encode().lower()), TERM_WORDS)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(terms), _RUN):
        some = terms[at : at + _RUN]
        wide = np.stack([some, mix64(some ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(terms)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _blocks(docs: DataFrame, key: str, text: str, block_bytes: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds of ranges of keys, descending, and for the first key of each range the range before it."""
    n, size = docs.agg(F.count(key), F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))).first()
    n_blocks = max(1, min(math.ceil((size or 0) / block_bytes), n, MAX_BLOCKS))
    bounds = np.empty(0, np.int64)
    if n_blocks > 1:
        shares = [(i + 1) / n_blocks for i in range(n_blocks - 1)]
        found = docs.agg(F.percentile_approx(key, shares, max(10_000, 20 * n_blocks))).first()[0]
        bounds = np.unique(np.array(found, np.int64))
    firsts = docs.filter(F.col(key).isNotNull()).select(_block_of(bounds, {})(F.col(key))[0].alias("block"), key)
    firsts = dict(sorted(firsts.groupBy("block").agg(F.max(key)).collect()))  # a row for each range
    order = list(firsts)
    return bounds, {firsts[b]: order[i - 1] for i, b in enumerate(order)}


def _block_of(bounds: np.ndarray, before: dict[int, int]):
    """Range of a key, and -1 - range for the range that needs it as the row after its last."""
    last = len(bounds)

    @F.pandas_udf("array<int>")
    def block_of(keys: pd.Series) -> pd.Series:
        at = last - np.searchsorted(bounds, keys.fillna(0).to_numpy().astype(np.int64), side="left")
        return pd.Series([[last + 1] if m else [b, -1 - before[k]] if k in before else [b] for k, b, m in zip(keys, at.tolist(), keys.isna(), strict=True)])

    return block_of


def fingerprint_documents(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Fingerprints of each row's text and of the text edited with the row after it.

    Returns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  Rows follow each other by descending integer key, ties by a hash of the
    text, and the first follows the last.  Rows are dealt out by ranges of the key, each
    range with a copy of the row after its last.

    A null text counts as empty, whose fingerprint is zeros.  Rows of null key follow one
    another after all others and are followed by an empty text.  Rows alike in key and
    text are interchangeable.  An empty table gives an empty table; other columns go.
    """
    bounds, before = _blocks(docs, key, text, block_bytes)
    selected = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    places = selected.withColumn("place", F.explode(_block_of(bounds, before)("key")))
    placed = places.select("key", "text", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("block"), (F.col("place") < 0).alias("after"))
    n = len(bounds) + 2
    dealt = placed.repartitionById(n, F.col("block")).sortWithinPartitions("block", "after", F.col("key").desc_nulls_last(), F.xxhash64("text"))
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def row(key: int, own: str, mark: bytes, following: str, next_mark: bytes) -> tuple:
        other = edited(own, following)
        changed = simhash(other)
        return key, len(own), hashlib.sha256(other.encode()).hexdigest(), mark.hex(), changed.hex(), likeness(mark, changed), likeness(mark, next_mark)

    def fingerprinted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for batch in batches:
            rows = []
            for k, x, block, after in zip(batch["key"].astype(object).where(batch["key"].notna(), None), batch["text"], batch["block"], batch["after"], strict=True):
                mark = simhash(x)
                if waiting is not None:
                    if waiting[0] == block:
                        rows.append(row(*waiting[1:], x, mark))
                    else:
                        rows.append(row(*waiting[1:], "", simhash("")))
                waiting = None if after else (block, k, x, mark)
            yield pd.DataFrame(rows, columns=names).astype({"key": "Int64"})
        if waiting is not None:
            yield pd.DataFrame([row(*waiting[1:], "", simhash(""))], columns=names).astype({"key": "Int64"})

    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInPandas(fingerprinted, schema).withColumnRenamed("key", key)


def within_radius(queries: DataFrame, corpus: DataFrame, n: int, radius: int = 3) -> DataFrame:
    """All pairs ``query, found, distance`` of fingerprints at most ``radius`` bits apart.

    Both inputs have a column ``fingerprint`` (hex); its distinct values are compared, so
    copies cost nothing.  As many blocks are matched together as make chance matches rare
    among ``n`` fingerprints.  A fingerprint finds itself.  Nulls find nothing.
    """
    matched = next((m for m in range(1, 9) if BITS * m // (radius + m) >= math.log2(n + 1) + 8), 8)
    edges = np.linspace(0, BITS, radius + matched + 1).astype(int).tolist()
    choices = list(itertools.combinations(range(radius + matched), matched))

    @F.pandas_udf("array<long>")
    def tables(marks: pd.Series) -> pd.Series:
        out = []
        for mark in marks:
            value = int(mark, 16)
            parts = [(value >> lo) & ((1 << (hi - lo)) - 1) for lo, hi in itertools.pairwise(edges)]
            keys = [hashlib.blake2b(repr((i, [parts[j] for j in choice])).encode(), digest_size=8).digest() for i, choice in enumerate(choices)]
            out.append([int.from_bytes(x, "big", signed=True) for x in keys])
        return pd.Series(out)

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(int(x, 16) ^ int(y, 16)).bit_count() for x, y in zip(a, b, strict=True)])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        marks = df.select(F.col("fingerprint").alias(name)).filter(F.col(name).isNotNull()).distinct()
        return marks.select(name, F.explode(tables(name)).alias("table_key"))

    pairs = keyed(queries, "query").join(keyed(corpus, "found"), "table_key").select("query", "found").distinct()
    return pairs.withColumn("distance", distance("query", "found")).filter(F.col("distance") <= radius)


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents; for ids divisible by 20, how many others are near."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = materialize(fingerprint_documents(docs), "fingerprints")
    queries = marked.filter(F.col("doc_id") % 20 == 0)
    found = within_radius(queries, marked, marked.count())
    holders = marked.groupBy("fingerprint").agg(F.count("*").alias("holders"))
    near = found.join(holders, found["found"] == holders["fingerprint"]).groupBy("query").agg(F.sum("holders").alias("n"))
    joined = marked.join(near, (marked["fingerprint"] == near["query"]) & (marked["doc_id"] % 20 == 0), "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", (F.col("n") - 1).alias("n_near"))
