"""Output columns beside whatever columns an input brings along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame) -> Column:
    """All input columns as one struct, out of the way of internal names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpacked(df: DataFrame, row: str, names: list[str], **added: Column) -> DataFrame:
    """The columns ``names`` of the struct ``row`` and the added ones.

    An added column takes the place of an input column of its name.
    """
    kept = [F.col(row).getField(c).alias(c) for c in names if c not in added]
    return df.select(*kept, *[v.alias(k) for k, v in added.items()])
