"""Projections of nodes, edges and texts for payloads, stores and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.names import clean, truncated
from casegraph.operators.picks import first_wins

LABEL_WIDTH, MOST_LABELS = 38, 6


def payload_nodes(records: DataFrame) -> DataFrame:
    """Nodes for display: events before entities of one name, short label, at most six other labels.

    ``records``: node, is_event, labels, score, ord.
    """
    rows = first_wins(records, ["node"], (~F.col("is_event")).cast("int").alias("k"), "ord")
    labels = F.array_distinct(F.filter(F.transform("labels", clean), lambda x: x.isNotNull() & (x != F.col("node"))))
    return rows.select("node", "is_event", truncated(F.col("node"), LABEL_WIDTH).alias("label"), F.slice(labels, 1, MOST_LABELS).alias("labels"), F.round("score", 3).alias("score"))


def payload_edges(edges: DataFrame, types: list[str]) -> DataFrame:
    """Edges of known types between two different nodes, the first of each (src, dst, type)."""
    rows = edges.filter(F.col("type").isin(types) & F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return first_wins(rows, ["src", "dst", "type"], "ord").withColumn("structural", F.col("type") == "evidence")


def store_weight(weight: Column, sources: Column, investigations: Column) -> Column:
    """An edge's weight, or how often it is attested if it has none."""
    return F.coalesce(F.nullif(weight, F.lit(0.0)), F.greatest(sources, investigations, F.lit(1)).cast("double"))


def description(**parts: Column) -> Column:
    """One retrieval text of an entity: its clean attributes by name."""
    return F.concat_ws(" ", *[F.when(clean(v).isNotNull(), F.concat(F.lit(f"{k}: "), clean(v), F.lit("."))) for k, v in parts.items()])


def network_text(edges: DataFrame, most: int = 6) -> DataFrame:
    """``node, text``: the first relations of each node, for a prompt."""
    line = F.struct("dst", F.concat("src", F.lit(" -"), "type", F.lit("-> "), "dst").alias("line"))
    lists = edges.groupBy(F.col("src").alias("node")).agg(F.slice(F.array_sort(F.collect_set(line)), 1, most).alias("l"))
    return lists.select("node", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def filtered_view(nodes: DataFrame, edges: DataFrame, runs: list[str], types: list[str], least_evidence: int) -> tuple[DataFrame, DataFrame]:
    """What a reader sees: nodes of the runs and types with evidence enough that keep an edge."""
    near = nodes.filter(F.arrays_overlap("runs", F.array(*[F.lit(r) for r in runs])) & F.col("type").isin(types) & (F.col("n_evidence") >= least_evidence))
    ids = near.select(F.col("node").alias("src"))
    kept = edges.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
    held = kept.select(F.col("src").alias("node")).union(kept.select("dst")).distinct()
    return near.join(held, "node", "left_semi"), kept


def rollup(members: DataFrame) -> DataFrame:
    """Communities: size, label of the two best members, mean score, bridges, whether anchored.

    ``members``: community, node, score, n_runs, anchor.
    """
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "node"))), 1, 2)
    return members.groupBy("community").agg(
        F.count("*").alias("size"),
        F.array_join(F.transform(best, lambda x: x["node"]), " / ").alias("label"),
        F.round(F.avg("score"), 3).alias("mean_score"),
        F.count_if(F.col("n_runs") >= 2).alias("bridges"),
        F.bool_or((F.col("n_runs") >= 2) | F.col("anchor")).alias("anchored"),
    )
