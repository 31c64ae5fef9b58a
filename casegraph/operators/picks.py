"""First and last row of a key, top rows of a group, pages, and merged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, FractionalType, IntegralType, TimestampType


def first_wins(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order.

    Where the order is one column, this is an aggregate that is summed before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))
    return df.groupBy(*keys).agg(F.min(ranked)["_row"].alias("_row")).select(*keys, "_row.*").select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key.

    Columns of a fixed width are picked one by one, so that rows are hashed and not sorted;
    all picks see the rows in one order and take the same row, of equals too.
    """
    rest = [c for c in df.columns if c not in keys]
    if rest and all(isinstance(df.schema[c].dataType, (BooleanType, DateType, IntegralType, FractionalType, TimestampType)) for c in rest):
        return df.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in rest]).select(*df.columns)
    row = F.max_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)


def top_rows(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first n rows of each key; Spark limits each group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def page(df: DataFrame, number: int, size: int, *order: Column | str) -> DataFrame:
    """A page (from 1, of 1 to 500 rows) of the ordered rows."""
    size = max(1, min(500, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def merged(a: Column, b: Column) -> Column:
    """Ordered union of two arrays, null if both are empty."""
    both = F.array_distinct(F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array())))
    return F.when(F.size(both) > 0, both)
