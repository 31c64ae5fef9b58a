"""Merging records across stages, grouping of names, retrieval, connectors and turns over themes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.functions.names import name_tokens, norm_key
from casegraph.operators import graph, inference
from casegraph.operators.picks import top_rows
from casegraph.operators.resolve import nearest, subset_aliases

# Names in a group that is canonicalised together.
GROUP_SIZE = 40


def merge_cascade(new: DataFrame, saved: DataFrame) -> DataFrame:
    """``name, saved_name, rule``: the saved record that each new name is, by the first rule that finds one.

    Rules in turn: the name itself, a label of a saved record, one norm key, all tokens of
    the shorter name in the longer.  ``new``: name; ``saved``: name, labels.
    """
    names = new.select(F.upper("name").alias("name")).distinct()
    exact = saved.select(F.upper("name").alias("name"), F.upper("name").alias("m1"))
    labels = saved.select(F.explode("labels").alias("l"), "name").groupBy(F.upper("l").alias("name")).agg(F.min(F.upper("name")).alias("m2"))
    keys = saved.groupBy(norm_key(F.col("name")).alias("key")).agg(F.min(F.upper("name")).alias("m3"))
    mine = names.select(F.col("name").alias("id"), name_tokens(F.col("name")).alias("tokens"))
    theirs = saved.select(F.upper("name").alias("id"), name_tokens(F.col("name")).alias("tokens")).distinct()
    both = subset_aliases(mine, theirs).union(subset_aliases(theirs, mine).select(F.col("b").alias("a"), F.col("a").alias("b")))
    subsets = both.groupBy(F.col("a").alias("name")).agg(F.min("b").alias("m4"))
    joined = names.withColumn("key", norm_key(F.col("name"))).join(exact.distinct(), "name", "left").join(labels, "name", "left").join(keys, "key", "left").join(subsets, "name", "left")
    found = F.coalesce("m1", "m2", "m3", "m4")
    rule = F.when(F.col("m1").isNotNull(), "name").when(F.col("m2").isNotNull(), "label").when(F.col("m3").isNotNull(), "key").when(F.col("m4").isNotNull(), "tokens")
    return joined.select("name", found.alias("saved_name"), rule.alias("rule"))


def rewritten(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with their ends renamed, self-loops gone, runs of equal edges united.

    ``edges``: src, dst, runs; ``aliases``: name, saved_name.
    """
    one = aliases.select(F.col("name").alias("src"), F.col("saved_name").alias("_s"))
    two = aliases.select(F.col("name").alias("dst"), F.col("saved_name").alias("_d"))
    out = edges.join(one, "src", "left").join(two, "dst", "left").select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "runs")
    return out.filter("src <> dst").groupBy("src", "dst").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))


def merged_fields(rows: DataFrame) -> DataFrame:
    """Fields of a group of records by their kind: numbers to the greatest, lists joined, text to the last.

    ``rows``: key, ord, text, number, items.
    """
    return rows.groupBy("key").agg(
        F.max_by("text", "ord").alias("text"),
        F.max("number").alias("number"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "items"))), lambda x: x["items"]))).alias("items"),
    )


def name_groups(names: DataFrame, most: int = GROUP_SIZE) -> DataFrame:
    """``name, group`` of similar names, at most ``most`` in a group.

    Names that share their rarest token are one block; a block is cut in order of name.
    """
    tokens = names.select("name", F.explode(name_tokens(F.col("name"))).alias("token")).distinct()
    weight = tokens.groupBy("token").agg(F.count("*").alias("n"))
    block = tokens.join(weight.filter("n > 1"), "token").groupBy("name").agg(F.min_by("token", F.struct("n", "token")).alias("block"))
    placed = names.select("name").distinct().join(block, "name", "left").withColumn("block", F.coalesce("block", "name"))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("name"))
    return placed.select("name", F.concat("block", F.lit("#"), F.floor((rank - 1) / most)).alias("group"))


#: Rows of a group that one task splits by itself.
TASK_ROWS = 20_000


def _split(vectors: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows in groups of at most ``most``, by repeated two-means from the ends of the widest way.

    Rows go to the nearer mean, ties to the first.  Where all go to one, or after no
    division at all, they are cut in half by order, so every step makes groups smaller.
    """
    done, left = [], [np.arange(len(vectors))]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        x = vectors[rows]
        one = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        two = x[((x - one) ** 2).sum(axis=1).argmax()]
        side = np.zeros(len(rows), bool)
        for _ in range(8):
            nearer = ((x - two) ** 2).sum(axis=1) < ((x - one) ** 2).sum(axis=1)
            if (nearer == side).all() or nearer.all() or not nearer.any():
                break
            side, one, two = nearer, x[~nearer].mean(axis=0), x[nearer].mean(axis=0)
        if side.all() or not side.any():
            side = np.arange(len(rows)) >= len(rows) // 2
        left += [rows[side], rows[~side]]
    return sorted(done, key=lambda g: g[0])


def vector_groups(names: DataFrame, most: int = GROUP_SIZE, task_rows: int = TASK_ROWS) -> DataFrame:
    """``name, group`` of names whose vectors are alike, never more than ``most`` in a group.

    A group of more than ``task_rows`` is cut by sums over all its rows, at the median of
    the way between two far ends, equal places by a hash of the name; smaller ones are split
    by two-means in a task each.  Names without a vector make groups of their own, by hash.
    A repeated name is one, with its least vector.  ``names``: name, vector (array).
    """
    once = graph.settled(names.groupBy("name").agg(F.min("vector").cast("array<double>").alias("vector")))
    rows = once.filter("vector is not null").select("name", "vector", F.lit("v").alias("group"))
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    while True:
        big = rows.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > task_rows).select("group")
        big = graph.settled(big)
        if big.isEmpty():
            break
        inside = rows.join(F.broadcast(big), "group")  # fewer groups than rows / task_rows
        sums = inside.select("group", F.posexplode("vector").alias("at", "x")).groupBy("group", "at").agg(F.avg("x").alias("x"))
        centre = sums.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("centre"))
        order = lambda d: F.struct(d, "name")
        one = inside.join(centre, "group").groupBy("group").agg(F.max_by("vector", order(gap(F.col("vector"), F.col("centre")))).alias("one"))
        two = inside.join(one, "group").groupBy("group").agg(F.first("one").alias("one"), F.max_by("vector", order(gap(F.col("vector"), F.col("one")))).alias("two"))
        far = inside.join(graph.settled(two), "group").withColumn("way", gap(F.col("vector"), F.col("one")) - gap(F.col("vector"), F.col("two")))
        bounds = far.groupBy("group").agg(F.percentile_approx("way", 0.5).alias("middle"), F.min("way").alias("lo"), F.max("way").alias("hi"))
        far = far.join(bounds, "group")
        same = F.col("lo") == F.col("hi")
        side = F.when(same | ((F.col("way") == F.col("middle")) & (F.col("middle") == F.col("hi"))), F.shiftrightunsigned(F.xxhash64("name", "group"), 63) == 1).otherwise(F.col("way") > F.col("middle"))
        cut = far.select("name", "vector", F.concat("group", F.when(side, "1").otherwise("0")).alias("group"))
        rows = graph.settled(rows.join(F.broadcast(big), "group", "left_anti").select("name", "vector", "group").union(cut))

    def split(group: pd.DataFrame) -> pd.DataFrame:  # task_rows at most
        group = group.sort_values("name", ignore_index=True)
        label = np.empty(len(group), object)
        for i, own in enumerate(_split(np.stack(group["vector"].to_list()), most)):
            label[own] = f"{group['group'].iloc[0]}#{i}"
        return pd.DataFrame({"name": group["name"], "group": label})

    found = rows.groupBy("group").applyInPandas(split, f"name {dict(names.dtypes)['name']}, group string")
    none = once.filter("vector is null").select("name")
    blocks = max(1, -(-none.count() * 2 // most))
    block = F.pmod(F.xxhash64("name"), F.lit(blocks))
    rank = F.row_number().over(Window.partitionBy("block").orderBy("name"))
    rest = none.withColumn("block", block).withColumn("rank", rank)
    return found.union(rest.select("name", F.concat_ws("#", F.lit("none"), "block", F.floor((F.col("rank") - 1) / most)).alias("group")))


def self_dedup(records: DataFrame) -> DataFrame:
    """``id, leader``: records whose texts have one token set or are linked by token subsets."""
    tokens = records.select("id", F.array_sort(name_tokens(F.col("name"))).alias("tokens"))
    same = tokens.groupBy("tokens").agg(F.min("id").alias("leader"))
    leaders = same.select(F.col("leader").alias("id"), "tokens")
    links = subset_aliases(leaders, leaders).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = graph.components(links).select(F.col("node").alias("leader"), "component")
    return tokens.join(same, "tokens").join(found, "leader", "left").select("id", F.coalesce("component", "leader").alias("leader"))


def retrieve(queries: DataFrame, entities: DataFrame, relations: DataFrame, mode: str, k: int = 10, chunks: DataFrame | None = None) -> DataFrame:
    """``query, found, sim`` by mode: local from entities, global from relations, hybrid from
    both, mix from both and from chunks of text, each the k nearest of its kind."""
    parts = {"local": [entities], "global": [relations], "hybrid": [entities, relations], "mix": [entities, relations, chunks]}[mode]
    if None in parts:
        raise ValueError("mix needs chunks")
    rows = None
    for part in parts:
        some = nearest(queries, part, k)
        rows = some if rows is None else rows.union(some)
    return rows.groupBy("query", "found").agg(F.max("sim").alias("sim"))


class Connector(NamedTuple):
    """What connects the chosen nodes."""

    paths: DataFrame  #: a, b, hops, path, rank
    nodes: DataFrame  #: node, role, betweenness, broker
    missing: DataFrame  #: node (or pair), why
    edges: DataFrame  #: src, dst: all edges between these nodes
    stats: DataFrame  #: one row of counts


def connector(nodes: DataFrame, edges: DataFrame, selected: DataFrame, most: int = 4, k: int = 3, mode: str = "hidden") -> Connector:
    """The graph of the chosen nodes and of those on the paths between them.

    ``mode``: ``shortest_path`` (one path a pair), ``hidden`` (k simple paths, shortest
    first) or ``induced`` (direct edges only).  Paths have ``most`` edges at most.  Edges that
    only tie the graph together and loops take no part.  A broker is a connecting node of
    at least half the greatest betweenness among those, within this graph.

    ``nodes``: node; ``edges``: src, dst, type; ``selected``: node, each once or more.
    """
    if mode not in ("shortest_path", "hidden", "induced"):
        raise ValueError(f"not a mode: {mode}")
    chosen = graph.settled(selected.select("node").distinct())
    known = graph.settled(nodes.select("node").join(chosen, "node", "left_semi").distinct())
    missing = chosen.join(known, "node", "left_anti").select("node", F.lit("missing").alias("why"))
    there = known if mode == "induced" else nodes.select("node").distinct()  # of direct edges no other has a part
    named = graph.without_orphans(edges.filter(~F.col("type").isin(graph.STRUCTURAL) & (F.col("src") != F.col("dst"))), there)
    solid = graph.settled(named.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    pairs = known.select(F.col("node").alias("a")).join(known.select(F.col("node").alias("b")), F.col("a") < F.col("b"))  # the reader's choice
    if mode == "induced":
        paths = graph.simple_paths(solid, pairs, 1, 1)
        lost = missing.limit(0)
    else:
        paths = graph.settled(graph.simple_paths(solid, pairs, most, k if mode == "hidden" else 1))
        lost = pairs.join(paths.select("a", "b").distinct(), ["a", "b"], "left_anti").select(F.concat_ws("-", "a", "b").alias("node"), F.lit("unreachable").alias("why"))
    kept = graph.settled(known.union(paths.select(F.explode("path").alias("node"))).distinct())
    inner = graph.settled(graph.without_orphans(solid, kept))
    central = inference.centrality(inner.withColumn("graph", F.lit("g"))).select("node", "betweenness")
    flagged = kept.join(central, "node", "left").join(known.withColumn("chosen", F.lit(True)), "node", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    top = flagged.filter("chosen is null").agg(F.max("betweenness").alias("most"))
    broker = F.col("chosen").isNull() & (F.col("betweenness") > 0) & (F.col("betweenness") >= F.col("most") / 2)
    found = flagged.crossJoin(F.broadcast(top)).select("node", F.when(F.col("chosen"), "selected").otherwise("connector").alias("role"), "betweenness", F.coalesce(broker, F.lit(False)).alias("broker"))  # one row
    found = graph.settled(found)
    unmet = missing.union(lost)
    stats = found.agg(F.count_if(F.col("role") == "selected").alias("selected"), F.count_if(F.col("role") == "connector").alias("connectors"), F.count_if("broker").alias("brokers"))
    for name, of in (("edges", inner), ("paths", paths), ("unreachable", lost)):
        stats = stats.crossJoin(F.broadcast(of.agg(F.count("*").alias(name))))  # one row
    return Connector(paths, found, unmet, inner, stats)


def round_robin(members: DataFrame, n: int, everyone: DataFrame | None = None) -> DataFrame:
    """``node, place``: one fresh member of each theme in turn, best themes first, until n are picked.

    ``members``: theme, weight, node, score.  A theme has n fresh members at most before n
    are picked, and members of n themes make up the first lap, so the best 2n members of the
    best 2n themes are enough where themes share no members; all others wait behind them.
    Where the themes run out, the best of ``everyone`` (node, score) fill the rest.
    """
    best = members.select("theme", "weight").distinct().orderBy(F.desc("weight"), "theme").limit(2 * n)
    rows = top_rows(members.join(best.select("theme"), "theme", "left_semi"), ["theme"], 2 * n, F.desc("score"), "node")

    def pick(group: pd.DataFrame) -> pd.DataFrame:  # 4 n^2 rows at most
        group = group.sort_values(["weight", "theme", "score", "node"], ascending=[False, True, False, True])
        lists = [list(g["node"]) for _, g in group.groupby("theme", sort=False)]
        taken: list = []
        while len(taken) < n and any(lists):
            for queue in lists:
                while queue and queue[0] in taken:
                    queue.pop(0)
                if queue and len(taken) < n:
                    taken.append(queue.pop(0))
        return pd.DataFrame({"node": taken, "place": range(1, len(taken) + 1)})

    picked = rows.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(pick, "node string, place long")
    if everyone is None:
        return picked
    picked = graph.settled(picked)
    left = n - picked.count()
    if left <= 0:
        return picked
    rest = everyone.join(picked.select("node"), "node", "left_anti").orderBy(F.desc("score"), "node").limit(left)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "node")) + F.lit(n - left)  # at most n rows
    return picked.union(rest.select("node", place.cast("long").alias("place")))


def store_entities(rows: DataFrame) -> DataFrame:
    """One row for each entity of a store: fields unite, counts add up.

    ``rows``: entity, kind, prob, runs, n, of the store, of investigations or of both.
    """
    return rows.groupBy("entity").agg(
        F.min("kind").alias("kind"), F.max("prob").alias("prob"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.sum("n").alias("n"),
    )


def of_store(new: DataFrame) -> DataFrame:
    """An investigation's entities that go into the store: events stay out."""
    return new.filter("kind is null or kind <> 'event'")


def store_update(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store's entities after an investigation.  Both: entity, kind, prob, runs, n."""
    return store_entities(store.unionByName(of_store(new)))


def edges_of_store(edges: DataFrame, events: DataFrame, aliases: DataFrame) -> DataFrame:
    """An investigation's edges as the store has them: ``src, dst, runs, n`` by canonical name.

    Edges that touch an event or only tie evidence to the graph go, ends are called by their
    canonical names, and what becomes a loop goes.  ``edges``: src, dst, type, runs, n;
    ``events``: node; ``aliases``: alias (upper case), canonical.
    """
    solid = edges.filter(~F.col("type").isin(graph.STRUCTURAL))
    for end in ("src", "dst"):
        solid = solid.join(events.select(F.col("node").alias(end)), end, "left_anti")
        names = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_name"))
        solid = solid.join(names, F.upper(end) == F.col("_alias"), "left").withColumn(end, F.coalesce("_name", end)).drop("_alias", "_name")
    return store_edges(solid.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "runs", "n"))


def store_edges(rows: DataFrame) -> DataFrame:
    """One row for each edge of a store: ``src, dst, pair, runs, n``; ``pair`` is its key."""
    named = rows.withColumn("pair", F.concat_ws("\u001f", "src", "dst"))
    return named.groupBy("src", "dst", "pair").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"), F.sum("n").alias("n"))
