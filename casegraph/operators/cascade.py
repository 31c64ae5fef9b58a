"""What follows when nodes go or change: cascades over a response's tables, repair of ids,
eligibility for a second stage, and the edges that a store takes over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions.names import clean
from casegraph.operators.predicates import better_canonical, publishers_among, valid_canonical


def _without(table: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose columns (of one name or an array of names) is among the gone."""
    out = table
    for c in columns:
        if dict(table.dtypes)[c].startswith("array"):
            marked = out.withColumn("_no", F.monotonically_increasing_id())
            hit = marked.select("_no", F.explode(c).alias("_n")).join(gone.select(F.col("node").alias("_n")), "_n", "left_semi").select("_no").distinct()
            out = marked.join(hit, "_no", "left_anti").drop("_no")
        else:
            out = out.join(gone.select(F.col("node").alias(c)), c, "left_anti")
    return out.select(*table.columns)


#: The columns of a response's tables that name nodes.
NAMING = {"nodes": ("node",), "edges": ("src", "dst"), "themes": ("members",), "promoted": ("node",), "hypotheses": ("members",)}


def publisher_cascade(tables: dict[str, DataFrame], publishers: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of a response without publishers and all that touches them, and the counts.

    ``tables`` are some of nodes, edges, themes, promoted and hypotheses, with the columns
    of ``NAMING``; ``publishers``: publisher.  Counts: table, before, after.
    """
    gone = publishers_among(tables["nodes"], publishers, "node").select("node").distinct()
    kept = {name: _without(table, gone, *NAMING[name]) for name, table in tables.items()}
    counted = [tables[name].agg(F.lit(name).alias("table"), F.count("*").alias("before")).crossJoin(kept[name].agg(F.count("*").alias("after"))) for name in tables]  # one row each
    return kept, reduce(DataFrame.unionByName, counted)


def repaired_ids(records: DataFrame) -> DataFrame:
    """Records whose id is no valid name get their best label as id, and the old id as a label.

    ``records``: node, is_event, labels.  Events keep their ids, and so do records without a
    valid label.
    """
    better = F.when(~F.col("is_event") & ~valid_canonical(F.col("node")), better_canonical(F.col("labels")))
    rows = records.withColumn("_better", better)
    labels = F.array_distinct(F.concat(F.array_remove("labels", F.col("_better")), F.array("node")))
    return rows.withColumns({"repaired": F.col("_better").isNotNull(), "labels": F.when(F.col("_better").isNotNull(), labels).otherwise(F.col("labels")), "node": F.coalesce("_better", "node")}).drop("_better")


def eligible(nodes: DataFrame, publishers: DataFrame, exclude: list[str] = (), run: str | None = None) -> DataFrame:
    """Nodes that a second stage may ask about: valid names of entities that are no publishers,
    not excluded, and attested by the run if one is given.  ``nodes``: node, is_event, runs."""
    rows = nodes.filter(~F.col("is_event") & valid_canonical(F.col("node")))
    if exclude:
        rows = rows.filter(~F.col("node").isin(list(exclude)))
    if run is not None:
        rows = rows.filter(F.array_contains("runs", run))
    return rows.join(publishers_among(rows, publishers, "node").distinct(), "node", "left_anti").select(*nodes.columns)


def store_edges(edges: DataFrame, nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """The relations that the cumulative store takes over, by canonical names.

    Structural edges stay out, those that touch an event, and what becomes a loop.  The
    description is role and context (or type), the keywords type and role; the weight is 1
    without one.  ``edges``: src, dst, kind, rel_type, context, role, weight; ``nodes``:
    node, is_event; ``mapping``: name, canonical.
    """
    events = nodes.filter("is_event").select("node")
    rows = edges.filter("kind <> 'evidence'")
    for end in ("src", "dst"):
        rows = rows.join(events.withColumnRenamed("node", end), end, "left_anti")
        rows = rows.join(mapping.select(F.col("name").alias(end), F.col("canonical").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    role, context, kind = clean(F.col("role")), clean(F.col("context")), clean(F.col("rel_type"))
    return rows.filter("src <> dst").select(
        "src", "dst",
        F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)).alias("weight"),
        F.concat_ws(" — ", role, F.coalesce(context, kind)).alias("description"),
        F.concat_ws(", ", kind, role).alias("keywords"),
    )
