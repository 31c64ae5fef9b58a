"""An inverted index of vectors: lists around centroids, residuals as bytes, exact reranking.

Centroids are fitted on a bounded sample; every vector is in the list of its nearest one, as
the difference from it in one signed byte a component.  A query looks into the lists of its
nearest centroids, scores their members by the bytes, and the best are scored again from
the vectors themselves.  Lists are cut into blocks, and a block meets the queries of its list
in one matrix product, so a list that holds a third of all vectors is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.operators.graph import settled
from casegraph.operators.picks import top_rows

#: Rows of the sample that centroids are fitted on, and vectors or queries in a block.
SAMPLE_ROWS, BLOCK_ROWS, QUERY_ROWS = 100_000, 4096, 256
#: Numbers of rows times centroids, and rows of queries times lists, that a task holds at once.
MOST_SIMS, MOST_PROBES = 1 << 20, 1 << 14


class Index(NamedTuple):
    """``centroids`` (unit vectors, some thousands at most) and ``blocks``: list, ids, codes, scales."""

    centroids: np.ndarray
    blocks: DataFrame


def _unit(column: pd.Series) -> np.ndarray:
    rows = np.stack(column.to_list()).astype(np.float64)
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12)


def _sliced(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches in slices of so many rows, one at least."""
    for batch in batches:
        for at in range(0, len(batch), max(1, rows)):
            yield batch.iloc[at : at + max(1, rows)]


def _fitted(rows: DataFrame, lists: int, n: int, seed: int) -> np.ndarray:
    """Means of the sample by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    sample = rows if n <= SAMPLE_ROWS else rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n)) < SAMPLE_ROWS)
    unit = Normalizer(inputCol="raw", outputCol="features").transform(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("raw")))
    found = np.array(KMeans(k=lists, seed=seed, maxIter=15).fit(unit).clusterCenters())
    return found / (np.linalg.norm(found, axis=1, keepdims=True) + 1e-12)


def built(vectors: DataFrame, lists: int | None = None, seed: int = 3) -> Index:
    """The index of all vectors (``vec_id``, ``embedding``); null ids and vectors are left out.

    ``lists`` is the root of the number of vectors, 4096 at most, unless it is given.
    """
    rows = vectors.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    n = rows.count()
    if not n:
        return Index(np.empty((0, 0)), vectors.sparkSession.createDataFrame([], "list int, ids array<long>, codes binary, scales binary"))
    centroids = _fitted(rows, lists or max(1, min(4096, int(n**0.5))), n, seed)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in _sliced(batches, MOST_SIMS // len(centroids)):
            x = _unit(some["embedding"])
            own = (x @ centroids.T).argmax(axis=1)
            rest = x - centroids[own]
            scale = np.abs(rest).max(axis=1) / 127 + 1e-12
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"list": own.astype(np.int32), "vec_id": some["vec_id"], "code": [c.tobytes() for c in codes], "scale": scale})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, own in batch.groupby("list", sort=False):
                for at in range(0, len(own), BLOCK_ROWS):
                    some = own.iloc[at : at + BLOCK_ROWS]
                    yield pd.DataFrame({"list": [number], "ids": [some["vec_id"].to_numpy()], "codes": [b"".join(some["code"])], "scales": [some["scale"].to_numpy().tobytes()]})

    members = rows.mapInPandas(coded, "list int, vec_id long, code binary, scale double").hint("rebalance", "list").sortWithinPartitions("list")
    return Index(centroids, settled(members.mapInPandas(packed, "list int, ids array<long>, codes binary, scales binary")))


def searched(index: Index, queries: DataFrame, vectors: DataFrame, k: int, probes: int = 8, depth: int = 4, same: bool = False) -> DataFrame:
    """``query, found, sim``: about the k nearest vectors of each query by cosine, exactly scored.

    ``probes`` lists are looked into, and ``depth * k`` of what they hold is scored again.
    Unless ``same``, a query does not find its own id.
    """
    spark, centroids = queries.sparkSession, index.centroids
    if not len(centroids):
        return spark.createDataFrame([], "query long, found long, sim double")
    asked = queries.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = min(probes, len(centroids))
        for some in _sliced(batches, min(MOST_SIMS // len(centroids), MOST_PROBES // most)):
            x = _unit(some["embedding"])
            lists = np.argpartition(-(x @ centroids.T), most - 1, axis=1)[:, :most]
            yield pd.DataFrame({"list": lists.reshape(-1).astype(np.int32), "query": np.repeat(some["vec_id"].to_numpy(), most), "unit": [u.tobytes() for u in x for _ in range(most)]})

    probed = settled(asked.mapInPandas(near, "list int, query long, unit binary"))
    parts = probed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    dealt = probed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")))  # a row for each list
    together = dealt.groupBy("list", "part").agg(F.collect_list(F.struct("query", "unit")).alias("asked"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids, codes, scales, own in batch[["list", "ids", "codes", "scales", "asked"]].itertuples(index=False):
                names = np.array([a["query"] for a in own])
                units = np.stack([np.frombuffer(a["unit"]) for a in own])
                table = np.frombuffer(codes, np.int8).reshape(len(ids), -1).astype(np.float64)
                sims = (units @ table.T) * np.frombuffer(scales) + (units @ centroids[number])[:, None]
                if not same:
                    sims[names[:, None] == ids[None, :]] = -np.inf
                most = min(depth * k, len(ids))
                best = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                score = np.take_along_axis(sims, best, axis=1).reshape(-1)
                yield pd.DataFrame({"query": np.repeat(names, most), "found": ids[best.reshape(-1)], "score": score})[score > -np.inf]

    rough = index.blocks.join(together, "list").mapInPandas(scored, "query long, found long, score double")
    likely = top_rows(rough, ["query"], depth * k, F.desc("score"), "found").select("query", "found")
    pairs = likely.join(vectors.select(F.col("vec_id").cast("long").alias("found"), F.col("embedding").alias("b")), "found")
    pairs = pairs.join(asked.select(F.col("vec_id").alias("query"), F.col("embedding").alias("a")), "query")

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series((_unit(a) * _unit(b)).sum(axis=1)) if len(a) else pd.Series([], dtype=float)

    exact = pairs.select("query", "found", F.pandas_udf(cosine, "double")("a", "b").alias("sim"))
    return top_rows(exact, ["query"], k, F.desc("sim"), "found")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact pairs that were found."""
    both = exact.select("query", "found").join(found.select("query", "found").withColumn("hit", F.lit(1)), ["query", "found"], "left")
    return both.agg(F.count("hit") / F.count("*")).first()[0]


def tuned(index: Index, vectors: DataFrame, k: int, target: float = 0.95, queries: int = 200) -> int:
    """The least power of two of lists that finds ``target`` of the k nearest, for a bounded
    sample of the vectors as queries; all lists where nothing less does.

    Vectors without clusters need most of the lists: an index does not help there.
    """
    from casegraph.operators.resolve import nearest

    sample = settled(vectors.filter("vec_id is not null and embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(queries).select("vec_id", "embedding"))
    exact = settled(nearest(sample, vectors, k))
    probes = 4
    while probes < len(index.centroids) and recall(searched(index, sample, vectors, k, probes), exact) < target:
        probes *= 2
    return min(probes, max(1, len(index.centroids)))
