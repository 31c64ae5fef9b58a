"""Centroid clustering of integer vectors, exact in every assignment.

Distances to all centroids are screened in 32-bit floats, by one matrix product for a block
of vectors.  The rounding error of such a product is bounded by ``g * |x| * |c|``, with ``g``
from the number of additions, whatever their order; so each distance comes as an interval.
A vector whose least interval overlaps no other is settled; for the others the centroids
in reach are compared again in exact integers, ties to the smaller number.

A round reads the vectors once.  Each task hands on one sum for each centroid, Spark adds
those up exactly, and the driver gets one number for each component of each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.memory import trimmed
from casegraph.llm.scratch import materialize
from casegraph.llm.vectors import finite, in_range, integers, means, summed, sums_batch, sums_schema, table_of

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
_ROWS = 4096
_UNIT = 2.0**-24


def screened(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to each vector, by intervals of their distances.

    The squared length of the vector is common to all its distances and left out.
    """
    steps = (x.shape[1] + 2) * _UNIT
    bound = steps / (1 - steps) * (1 + 1e-6)  # of two conversions and all products and sums
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    squares = (centroids.astype(np.float64) ** 2).sum(axis=1)
    error = 2 * bound * length[:, None] * (np.sqrt(squares) * (1 + 1e-9))
    error += (squares + 2 * np.abs(product)) * 2.0**-45  # of the arithmetic on intervals itself
    middle = squares - 2 * product
    return middle - error <= (middle + error).min(axis=1)[:, None]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, and the squared distance, both exact."""
    near = screened(x, centroids)
    chosen = near.argmax(axis=1)
    distance = ((x - centroids[chosen]) ** 2).sum(axis=1)
    unsettled = np.flatnonzero(near.sum(axis=1) > 1)
    row, number = np.nonzero(near[unsettled])
    exact = np.full((len(unsettled), len(centroids)), np.iinfo(np.int64).max)
    exact[row, number] = ((x[unsettled[row]] - centroids[number]) ** 2).sum(axis=1)
    chosen[unsettled] = exact.argmin(axis=1)  # the first of equals
    distance[unsettled] = exact.min(axis=1) if len(unsettled) else distance[unsettled]
    return chosen, distance


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            block = batch.slice(at, _ROWS)
            yield block, table_of(block.column("v"), width)


def _round(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for _, x in _blocks(batches, centroids.shape[1]):
            n, of = summed(nearest(x, centroids)[0], x, len(centroids))
            counts += n
            total += of
        yield from sums_batch(counts, total)

    moved = centroids.copy()
    for number, mean in means(kept.select("v").mapInArrow(trimmed(sums), sums_schema())).items():
        moved[number] = mean
    return moved


def cluster_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = 1,
    owner: str = "query",
) -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector.

    Vectors of ``width`` numbers, none null or non-finite, become integers at ``scale``;
    other rows go.  Centroids start as the vectors with the least sha256 of
    ``seed:key``.  Empty centroids stay.  With fewer vectors than ``clusters`` there are as
    many centroids as vectors.

    Repeated rows and keys are vectors of their own; among equal keys the lesser vector
    starts first, null keys after all others.  Equal vectors that start make equal
    centroids, of which the larger numbers stay empty.  A vector with a component beyond
    2^27 in integers, whose distances may not fit a long, takes part in no round: its
    cluster, distance, inertia of the cluster and centroid are null.  Sums that do not fit
    a long are null.  An empty table gives an empty table; other columns are dropped.
    """
    found = vectors.select(F.col(key).alias("key"), F.col(vector).alias("e")).filter((F.size("e") == width) & finite("e"))
    found = found.select("key", F.when(in_range("e", scale), integers("e", scale)).alias("v"))
    found = materialize(found, "integers", owner)
    kept = found.filter("v is not null")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    start = kept.withColumn("hash", order).orderBy(F.col("hash").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, width)
    if len(centroids):
        for _ in range(rounds):
            centroids = _round(kept, centroids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, x in _blocks(batches, width):
            number, distance = nearest(x, centroids)
            yield pa.RecordBatch.from_arrays([block.column("key"), pa.array(number.astype(np.int32)), pa.array(distance)], ["key", "cluster", "distance"])

    key_type = vectors.schema[key].dataType.simpleString()
    marks = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    out = materialize(kept.mapInArrow(trimmed(assigned), f"key {key_type}, cluster int, distance long"), "assigned", owner)
    inside = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("of_cluster"))  # a row for each centroid
    whole = inside.agg(F.sum("of_cluster").alias("of_all"))
    named = vectors.sparkSession.createDataFrame(marks, "cluster int, centroid_sha256 string")
    inside = inside.join(F.broadcast(named), "cluster")
    beyond = found.filter("v is null").select("key", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    joined = out.union(beyond).join(F.broadcast(inside), "cluster", "left").crossJoin(F.broadcast(whole))
    sums = [F.col(a).try_cast("long").alias(b) for a, b in (("of_cluster", "cluster_inertia"), ("of_all", "inertia"))]
    return joined.select(F.col("key").alias(key), "cluster", "distance", *sums, "centroid_sha256")


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(n: int) -> str:
    """Assignments ``a<n>`` to centroids ``c<n>``, and centroids after them."""
    return f"""
d{n} AS MATERIALIZED (SELECT v.vec_id, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} c ON v.i = c.i GROUP BY 1, 2),
a{n} AS MATERIALIZED (SELECT vec_id, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1),
s{n} AS (SELECT a.k, v.i, sum(v.x) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{n} a JOIN v USING (vec_id) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x) AS x FROM c{n} c LEFT JOIN s{n} s ON s.k = c.k AND s.i = c.i),"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM kept)),
z AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k FROM kept QUALIFY k < 16),
c0 AS MATERIALIZED (SELECT z.k, v.i, v.x FROM z JOIN v USING (vec_id)),
{"".join(_round_sql(n) for n in range(ROUNDS + 1))}
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY k)
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN h USING (k)
"""
