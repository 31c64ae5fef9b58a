"""Joins on keys of which a few may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.scratch import materialize

#: A key is hot if it holds more rows than this and than this part of all.
LEAST_ROWS, MOST_KEYS = 1000, 1000
#: Parts over which the rows of a hot key are dealt.
SALTS = 256


def hot_limit(table: DataFrame) -> int:
    """Rows above which a key of ``table``, with its rows in ``n``, is hot."""
    return max(LEAST_ROWS, (table.agg(F.sum("n")).first()[0] or 0) // MOST_KEYS)


def joined_hot(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has one row and the number ``n`` of rows for each key.

    Hot keys, of which there can be ``MOST_KEYS`` at most, are broadcast, so that none of
    them goes to one task.  ``table`` is read three times: let it be a written one.
    """
    limit = hot_limit(table)
    hot = table.filter(F.col("n") > limit)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot.drop("n")), on).unionByName(rest.join(table.filter(F.col("n") <= limit).drop("n"), on))


def left_joined_salted(rows: DataFrame, table: DataFrame, on: list[str], owner: str = "query") -> DataFrame:
    """All ``rows`` with what ``table``, which has one row for each key at most, has for them.

    Rows of a hot key, be it in the table or not, are dealt over ``SALTS`` parts, each with
    a copy of the table's row.  Keys are not null.
    """
    sizes = materialize(rows.groupBy(*on).agg(F.count("*").alias("n")), "sizes", owner)
    hot = F.broadcast(sizes.filter(F.col("n") > hot_limit(sizes)).select(*on, F.lit(True).alias("_hot")))
    own = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, on, "left").withColumn("_salt", own).drop("_hot")
    copied = table.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copied, [*on, "_salt"], "left").drop("_salt")
