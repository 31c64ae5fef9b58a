"""Integer vectors, and exact means of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this are out of range: up to it, squared distances of 64 components fit a long.
LARGEST = 1 << 27


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good, F.lit(False))


def in_range(vector: str, scale: int) -> Column:
    """Whether all components of a finite vector are in range once they are integers."""
    return F.forall(vector, lambda x: F.abs(x.cast("double") * scale) <= LARGEST)


def integers(vector: str, scale: int) -> Column:
    """The vector with each component floored to an integer at the scale."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def table_of(column: pa.Array, width: int) -> np.ndarray:
    """A column of vectors of ``width`` numbers as a table of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def summed(groups: np.ndarray, table: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and componentwise exact sums of the rows, of each of ``n`` groups."""
    order = np.argsort(groups, kind="stable")
    counts = np.bincount(groups, minlength=n)
    sums = np.zeros((n, table.shape[1]), np.int64)
    held = np.flatnonzero(counts)
    if len(held):
        starts = (np.cumsum(counts) - counts)[held]
        sums[held] = np.add.reduceat(table[order], starts, axis=0)
    return counts, sums


def sums_schema() -> str:
    return "group int, n long, sums array<long>"


def sums_batch(counts: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each group that has rows, as one task hands it on."""
    held = np.flatnonzero(counts)
    if len(held):
        columns = [pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["group", "n", "sums"])


def means(partial: DataFrame) -> dict[int, list[int]]:
    """Floors of the exact means of each group, from the sums of all tasks.

    The driver gets a row for each group and component.
    """
    each = partial.select("group", "n", F.posexplode("sums").alias("at", "value"))
    total = each.groupBy("group", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    out: dict[int, list[int]] = {}
    for row in sorted(total.collect()):
        out.setdefault(row["group"], []).append(int(row["total"]) // row["n"])
    return out
