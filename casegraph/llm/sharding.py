"""Two-pass external shuffle into shards, on DataFrame functions only.

Pass 1 scatters the rows with a seeded hash over buckets of about ``bucket_bytes``.
Pass 2 gathers one bucket at a time and runs Spark's seeded ``shuffle`` on it, which is
an inside-out Fisher-Yates.  The buckets laid end to end are a uniform permutation; it
is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.llm.columns import packed, unpacked


def text_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1


def _scattered(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    place = F.xxhash64(F.lit(seed), F.col("_row"), F.col("_copy"))
    return rows.withColumn("_place", place).withColumn("_bucket", F.pmod("_place", F.lit(buckets)).cast("int"))


def _counted(rows: DataFrame, buckets: int) -> np.ndarray:
    """Rows of each bucket, 16 bytes a bucket on the driver."""
    table = rows.groupBy("_bucket").count().toArrow()
    sizes = np.zeros(buckets, np.int64)
    sizes[table["_bucket"].to_numpy()] = table["count"].to_numpy()
    return sizes


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    *,
    text: str = "text",
    seed: int = 17,
    bucket_bytes: int = 32 << 20,
    max_buckets: int = 1 << 22,
    max_partitions: int = 20_000,
) -> DataFrame:
    """Every row of ``docs`` with ``shard`` (0..n_shards-1) and ``slot`` (its place there).

    Shards are filled to counts that differ by one at most; slots are gapless from 0.
    The result is a function of the rows, ``seed`` and the bucket count alone.  Beyond
    ``max_buckets`` (128 TB at the defaults) buckets grow instead of becoming more, so that
    their counts, which go to the driver as Arrow and are broadcast, stay bounded.

    Nulls in any column are carried along; a null text counts 1 byte.  Rows alike in
    every column are told apart by a copy number once their bucket is overfull, so a
    third of all rows may be one row.  An empty table gives an empty table.  Input
    columns named ``shard`` or ``slot`` are replaced.  Map columns are not supported.
    """
    names = docs.columns
    n, total = docs.agg(F.count("*"), F.sum(text_bytes(text))).first()
    buckets = max(1, min(max_buckets, math.ceil((total or 0) / bucket_bytes)))
    partitions = min(buckets, max_partitions)
    rows = _scattered(docs.select(packed(docs).alias("_row"), F.lit(0).cast("long").alias("_copy")), seed, buckets)
    sizes = _counted(rows, buckets)
    overfull = np.flatnonzero(sizes > 4 * n / buckets + 1000).tolist()  # few: above four times the mean
    if overfull:
        copies = rows.filter(F.col("_bucket").isin(overfull)).groupBy("_row").agg(F.count("*").alias("_n"))
        copies = copies.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
        rest = rows.filter(~F.col("_bucket").isin(overfull)).select("_row", "_copy", "_place", "_bucket")
        rows = rest.union(_scattered(copies, seed, buckets))
        sizes = _counted(rows, buckets)
    bases = np.cumsum(sizes) - sizes
    spark = docs.sparkSession
    ids = np.arange(buckets, dtype=np.int64)
    table = spark.createDataFrame(pa.table({"_bucket": ids.astype(np.int32), "_base": bases, "_part": (ids * partitions // buckets).astype(np.int32)}))
    arrays = (
        rows.join(F.broadcast(table), "_bucket")  # at most max_buckets rows of 20 bytes
        .repartitionById(partitions, F.col("_part"))
        .sortWithinPartitions("_bucket", "_place")
        .groupBy("_part", "_bucket", "_base")
        .agg(F.sort_array(F.collect_list(F.struct("_place", "_copy", "_row"))).alias("_rows"))
    )
    dealt = arrays.select("_base", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_at", "_item"))
    at = F.col("_base") + F.col("_at")
    dealt = dealt.select(F.col("_item._row").alias("_row"), at.alias("_at"))
    shard = F.expr(f"((_at + 1) * {n_shards} - 1) div {max(n, 1)}")
    dealt = dealt.withColumn("_shard", shard)
    slot = F.expr(f"_at - (_shard * {n}) div {n_shards}")
    return unpacked(dealt, "_row", names, shard=F.col("_shard").cast("int"), slot=slot.cast("long"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, each task's rows in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sharded = shard_documents(docs, 8)
    return sharded.select(
        "doc_id",
        text_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
