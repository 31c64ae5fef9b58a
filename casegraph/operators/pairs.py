"""Pairs and edges: aggregation, degrees, resolution of ends, roll-ups of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.operators.picks import first_wins

# Relation types that have no direction.
SYMMETRIC = ["affiliation", "partnership", "coalition", "non_direct"]


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("\t", F.least(a, b), F.greatest(a, b))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.filter("src <> dst").distinct()


def pair_edges(affiliations: DataFrame, symmetric: Column | None = None) -> DataFrame:
    """One edge for each pair: chunks that attest it, types, mean strength and confidence, weight.

    ``affiliations``: a, b, chunk, rel_type, strength, confidence, ord.
    """
    sides = symmetric if symmetric is not None else F.lower("rel_type").isin(SYMMETRIC)
    a, b = F.when(sides, F.least("a", "b")).otherwise(F.col("a")), F.when(sides, F.greatest("a", "b")).otherwise(F.col("b"))
    rows = affiliations.filter(F.col("a") != F.col("b")).withColumns({"src": a, "dst": b})
    sums = rows.groupBy("src", "dst").agg(
        F.countDistinct("chunk").alias("source_count"),
        F.array_sort(F.collect_set("rel_type")).alias("types"),
        F.avg(F.coalesce("strength", F.lit(0.0))).alias("strength"),
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        F.min_by("chunk", "ord").alias("first_chunk"),
    )
    known = (F.col("strength") != 0) & (F.col("confidence") != 0)
    return sums.withColumn("weight", F.when(known, F.col("strength") * F.col("confidence")).otherwise(F.col("source_count").cast("double")))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def alias_keys(records: DataFrame, representatives: DataFrame) -> DataFrame:
    """``name, canonical``: names of records, the last record winning, then of representative groups.

    ``records``: canonical, names, ord; ``representatives``: canonical, names.
    """
    own = records.select(F.explode("names").alias("name"), "canonical", F.lit(0).alias("kind"), (-F.col("ord")).alias("ord"))
    groups = representatives.select(F.explode("names").alias("name"), "canonical", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("ord"))
    named = own.unionByName(groups).withColumn("name", F.upper("name"))
    return first_wins(named.select("name", "canonical", "kind", "ord"), ["name"], "kind", "ord", "canonical").select("name", "canonical")


def resolved(edges: DataFrame, keys: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges with both ends by their canonical names; unresolved ends and self-pairs go."""
    one = keys.select(F.col("name").alias("_na"), F.col("canonical").alias("_ca"))
    two = keys.select(F.col("name").alias("_nb"), F.col("canonical").alias("_cb"))
    out = edges.join(one, F.upper(a) == F.col("_na")).join(two, F.upper(b) == F.col("_nb")).filter("_ca <> _cb")
    return out.withColumns({a: F.col("_ca"), b: F.col("_cb")}).drop("_na", "_nb", "_ca", "_cb")


def relations_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the relations that leave and reach them, and whether they have any."""
    out = edges.select(F.col("src").alias("node"), F.struct(F.lit("out").alias("way"), F.col("dst").alias("other")).alias("relation"))
    back = edges.select(F.col("dst").alias("node"), F.struct(F.lit("in").alias("way"), F.col("src").alias("other")).alias("relation"))
    lists = out.union(back).groupBy("node").agg(F.array_sort(F.collect_list("relation")).alias("relations"))
    joined = nodes.join(lists, "node", "left")
    return joined.withColumn("triangulated", F.coalesce(F.size("relations") > 0, F.lit(False)))


def merged_edges(edges: DataFrame) -> DataFrame:
    """The store's edges: one for each unordered pair.

    ``edges``: src, dst, rel_type, url, day, window_from, window_to, hypothesis, weight.
    """
    pair = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    url = F.when(F.col("url").startswith("http"), F.col("url"))
    return pair.groupBy("a", "b").agg(
        F.array_sort(F.collect_set("rel_type")).alias("types"),
        F.array_sort(F.collect_set(url)).alias("urls"),
        F.array_sort(F.collect_set("day")).alias("observed"),
        F.min("window_from").alias("window_from"),
        F.max("window_to").alias("window_to"),
        F.bool_or("hypothesis").alias("hypothesis"),
        F.max("weight").alias("weight"),
    )


def merged_entities(records: DataFrame) -> DataFrame:
    """The store's entities: greatest probability and score, the change of greatest size, first type, unions."""
    return records.groupBy("entity").agg(
        F.max("prob").alias("prob"),
        F.max("score").alias("score"),
        F.max_by("delta", F.struct(F.abs("delta"), "delta")).alias("delta"),
        F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("ord"))).alias("kind"),
        F.array_sort(F.array_remove(F.collect_set("label"), F.first("entity"))).alias("labels"),
        F.array_sort(F.collect_set("run")).alias("runs"),
    )


def merged_duplicates(records: DataFrame) -> DataFrame:
    """A group of duplicate records as one: labels, the most common one, greatest relevance, first type."""
    counts = records.groupBy("rep", F.upper("label").alias("label")).agg(F.count("*").alias("n"))
    common = counts.groupBy("rep").agg(F.max_by("label", F.struct("n", F.expr("-length(label)"), "label")).alias("common"), F.array_sort(F.collect_set("label")).alias("labels"))
    sums = records.groupBy("rep").agg(F.max("relevance").alias("relevance"), F.min_by("kind", "ord").alias("kind"), F.count("*").alias("n"))
    return sums.join(common, "rep")
