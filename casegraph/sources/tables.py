"""The driver's tables, and the domain tables of the case graph made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts or hashes at once; Spark would join small partitions until the cores are just busy.
ROWS_A_TASK = 500_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The rows dealt by keys over tasks of ``ROWS_A_TASK`` where the cores alone would have more each."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed evidence about suppliers: one row for each line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.col("l_partkey").alias("source"),
        (F.col("l_discount") * 10).alias("strength"),
        (1 - F.col("l_tax")).alias("confidence"),
        (F.col("l_returnflag") != "R").alias("supports"),
        F.to_date("l_shipdate").alias("published"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def affiliations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier and customer named together in an order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.count()
    lines, orders = dealt(lines, rows, "l_orderkey"), dealt(orders, rows, "o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("a"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("b"),
        F.col("l_orderkey").alias("chunk"),
        F.col("o_orderpriority").alias("rel_type"),
        (F.col("l_discount") * 10).alias("strength"),
        (1 - F.col("l_tax")).alias("confidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_returnflag").alias("run"),
        F.to_date("o_orderdate").alias("day"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("actor"), "event_type", F.to_date("ts").alias("day"), "value", "ts")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fetched articles; every seventh has lost its body."""
    docs = table(spark, sf_dir, "documents")
    lost = F.col("doc_id") % 7 == 3
    return docs.select(
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("run"),
        F.col("source").alias("publisher"),
        F.split("text", "\n")[0].alias("title"),
        F.when(~lost, F.col("text")).alias("text"),
        F.when(lost, F.lit("403")).alias("error"),
    )
