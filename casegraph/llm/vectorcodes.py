"""Vector code compression: product codes of integer vectors, by exponion search.

A vector is cut into parts, each coded by the nearest entry of its position's codebook.
The search starts at the entry ``a`` that the part had before.  An entry as near as ``a``
lies within twice the part's distance from ``a``, so it is enough to scan the list of
``a``'s neighbours, sorted by distance, up to that radius; in squares, up to four times the
squared distance, which is an integer like all distances here.  Ties go to the lower
index, and entries at the very edge of the radius are scanned as well.

Vectors are written with their codes after each round, which is where the next search
starts.  Each task hands on one sum for each entry, Spark adds those up exactly, and the
driver gets one number for each component of each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.hot import joined_hot
from casegraph.llm.memory import trimmed
from casegraph.llm.scratch import materialize, release
from casegraph.llm.vectors import finite, in_range, integers, means, summed, sums_batch, sums_schema, table_of

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
_ROWS = 8192


class Codebook:
    """The entries of one part position, each with its neighbours by distance."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        squares = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.neighbours = np.argsort(squares, axis=1, kind="stable")
        self.reach = np.take_along_axis(squares, self.neighbours, axis=1)

    def search(self, parts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entries, squared distances, and how many distances were computed.

        ``before`` has the entry at which each part's search starts.
        """
        first = ((parts - self.entries[before]) ** 2).sum(axis=1)
        scans = np.empty(len(parts), np.int64)
        for entry in np.unique(before):
            own = before == entry
            scans[own] = np.searchsorted(self.reach[entry], 4 * first[own], side="right")
        order = np.argsort(-scans, kind="stable")
        parts, start = parts[order], before[order]
        best, distance = start.copy(), first[order]
        active = np.searchsorted(-scans[order], -np.arange(len(self.entries)), side="left")
        for step, n in enumerate(active.tolist()):
            if not n:
                break
            entry = self.neighbours[start[:n], step]
            found = ((parts[:n] - self.entries[entry]) ** 2).sum(axis=1)
            better = (found < distance[:n]) | ((found == distance[:n]) & (entry < best[:n]))
            best[:n][better], distance[:n][better] = entry[better], found[better]
        nearest, squared = np.empty_like(best), np.empty_like(distance)
        nearest[order], squared[order] = best, distance
        return nearest, squared, len(parts) + int(scans.sum())


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            block = batch.slice(at, _ROWS)
            yield block, table_of(block.column("v"), width)


def _coded(rows: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """The rows with codes and errors of these codebooks, searched from the codes they have."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width // len(books)
        for block, x in _blocks(batches, width):
            codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(-1, len(books)).copy()
            error = np.zeros(len(x), np.int64)
            for at, book in enumerate(books):
                codes[:, at], squared, _ = book.search(x[:, at * size : (at + 1) * size], codes[:, at].astype(np.int64))
                error += squared
            made = {"code": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error)}
            yield pa.RecordBatch.from_arrays([made.get(n, block.column(n)) for n in block.schema.names], block.schema.names)

    return rows.mapInArrow(trimmed(coded), rows.schema)


def _moved(rows: DataFrame, books: list[Codebook], width: int) -> list[Codebook]:
    """The codebooks with each used entry at the mean of its parts."""
    parts, size, most = len(books), width // len(books), len(books[0].entries)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(parts * most, np.int64), np.zeros((parts * most, size), np.int64)
        for block, x in _blocks(batches, width):
            codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            n, of = summed((codes.astype(np.int64) + most * np.arange(parts)).reshape(-1), x.reshape(-1, size), parts * most)
            counts += n
            total += of
        yield from sums_batch(counts, total)

    entries = np.stack([b.entries for b in books])
    for group, mean in means(rows.select("v", "code").mapInArrow(trimmed(sums), sums_schema())).items():
        entries[group // most, group % most] = mean
    return [Codebook(x) for x in entries]


def compress_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    owner: str = "query",
) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` of each vector.

    Vectors without null and non-finite components become integers at ``scale``; other
    rows go.  Codebooks start as the parts of the ``entries`` (256 at most) vectors of least
    key, or of all where there are fewer.  ``label_error`` sums the error over equal labels,
    nulls being equal.

    Most vectors set the length; those of another length go, and so do all if it is no
    multiple of ``parts``.  Repeated rows and keys are vectors of their own;
    of equal keys the lesser vector comes first, null keys after all others.  A vector with
    a component beyond 2^27 in integers, whose error may not fit a long, takes part in no
    round: its code and error are null and add nothing.  Sums that do not fit a long are
    null.  An empty table gives an empty table; other columns are dropped.
    """
    spark = vectors.sparkSession
    found = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("e")).filter(finite("e"))
    found = found.select("key", "label", F.size("e").alias("width"), F.when(in_range("e", scale), integers("e", scale)).alias("v"))
    found = materialize(found, "integers", owner)
    by_key = [F.col("key").asc_nulls_last(), "v"]
    first = found.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    width = first["width"] if first and first["width"] % parts == 0 else -1
    found = found.filter(F.col("width") == width)
    rows = found.filter("v is not null").select("key", "label", "v", F.lit(bytes(parts)).alias("code"), F.lit(0).cast("long").alias("error"))
    start = np.array([r["v"] for r in rows.select("key", "v").orderBy(*by_key).limit(entries).collect()], np.int64)
    start = start.reshape(len(start), parts, max(width, 0) // parts)
    books = [Codebook(start[:, at]) for at in range(parts)]
    if len(start):
        for turn in range(rounds):
            rows = materialize(_coded(rows, books, width), "coded", f"{owner}-{turn}")
            books = _moved(rows, books, width)
            if turn:
                release(spark, f"{owner}-{turn - 1}")
        rows = _coded(rows, books, width)
    beyond = found.filter("v is null").select("key", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = materialize(rows.select("key", "label", "code", "error").union(beyond), "codes", owner)
    if len(start) and rounds:
        release(spark, f"{owner}-{rounds - 1}")
    mark = hashlib.sha256(",".join(str(x) for book in books for x in book.entries.reshape(-1).tolist()).encode()).hexdigest()
    named = F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("own")).cast("string").alias("labels")
    rows = rows.select("key", "code", "error", named)
    sums = rows.groupBy("labels").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n"))
    out = joined_hot(rows, materialize(sums, "label-errors", owner), ["labels"])
    return out.select(F.col("key").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(mark).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings."""
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(n: int) -> str:
    """Assignments ``a<n>`` to entries ``c<n>``, and entries after them."""
    return f"""
d{n} AS MATERIALIZED (SELECT v.vec_id, v.p, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{n} c ON v.p = c.p AND v.i = c.i GROUP BY 1, 2, 3),
a{n} AS MATERIALIZED (SELECT vec_id, p, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1),
s{n} AS (SELECT a.p, a.k, v.i, sum(v.x) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{n} a JOIN v USING (vec_id, p) GROUP BY 1, 2, 3),
c{n + 1} AS MATERIALIZED (SELECT c.p, c.k, c.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x) AS x FROM c{n} c LEFT JOIN s{n} s ON s.p = c.p AND s.k = c.k AND s.i = c.i),"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
u AS (SELECT vec_id, len(e) // 16 AS w, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM kept),
v AS MATERIALIZED (SELECT vec_id, i // w AS p, i % w AS i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
z AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < 64),
c0 AS MATERIALIZED (SELECT v.p, z.k, v.i, v.x FROM z JOIN v USING (vec_id)),
{"".join(_round_sql(n) for n in range(ROUNDS + 1))}
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, i)) AS h FROM c{ROUNDS}),
r AS (SELECT a.vec_id, string_agg(lower(printf('%02x', a.k)), '' ORDER BY a.p) AS code, sum(a.d) AS e FROM a{ROUNDS} a GROUP BY 1)
SELECT r.vec_id, r.code, CAST(r.e AS BIGINT) AS error, CAST(sum(r.e) OVER (PARTITION BY kept.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256
FROM r JOIN kept USING (vec_id), h
"""
