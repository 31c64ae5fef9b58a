"""Communities of one graph that no task can hold: moves in rounds by joins, then coarser graphs.

In a round every node knows the group that it would gain most by moving to.  Three quarters
of the nodes, told by a hash that changes with the round, move at once.  Once that does not raise
the modularity, the round is taken back, and in the rounds that follow only moves stay that share
no group with a better one: their gains add up exactly.  When a round adds next to nothing, groups become the nodes of a coarser graph, until a whole graph joins nothing or is
small enough for one task.

A lookup by a node or group that has more than a thousandth of all rows (a thousand of them
at most, therefore) is a broadcast; the others meet in a shuffle.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from casegraph.operators.graph import settled
from casegraph.operators.inference import louvain

#: Weights count in millionths, so that their sums are exact and reruns agree.
UNIT = 1_000_000
#: Links (each edge has two) of a coarse graph that one task may hold.
TASK_LINKS = 500_000
#: Modularity that a round must add, or its level is done.
LEAST_GAIN = 1e-4
#: A key is hot with more than this part of all rows.
HOT = 1000


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """The rows with the facts of their key, of which those marked ``hot`` are broadcast.

    ``facts`` has one row a key; no more than ``HOT`` of them may be hot.
    """
    some = F.broadcast(facts.filter("hot").drop("hot").withColumn("_met", F.lit(True)))
    marked = rows.join(some, key, "left")
    plain = marked.filter("_met is null").select(*rows.columns).join(facts.filter("not hot").drop("hot"), key)
    return marked.filter("_met").drop("_met").unionByName(plain)


def _links(edges: DataFrame) -> DataFrame:
    """``src, dst, weight`` both ways, once each, in whole units; nulls and weights of zero and less go."""
    whole = edges.select("src", "dst", F.round(F.col("weight") * UNIT).cast("long").alias("weight")).filter("src <> dst and weight > 0")
    both = whole.unionByName(whole.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return settled(both.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def _best(links: DataFrame, member: DataFrame, count: int, total: int) -> DataFrame:
    """Each node of ``member`` with its group's ``pull``, the best other group and what moving gains.

    ``member``: node, group, weight (of its links), n (of them), size (nodes that it stands for).
    """
    hot = (F.col("n") > count / HOT).alias("hot")
    groups = settled(member.groupBy("group").agg(F.sum("weight").alias("sum"), F.sum("n").alias("n"))).select("group", "sum", hot)
    own = looked_up(member, groups, "group")
    near = looked_up(links.filter("src <> dst"), member.select(F.col("node").alias("dst"), "group", hot), "dst")
    near = near.select(F.col("src").alias("node"), "group", "weight").unionByName(member.select("node", "group", F.lit(0).cast("long").alias("weight")))
    pulls = looked_up(near.groupBy("node", "group").agg(F.sum("weight").alias("pull")), groups.withColumnRenamed("sum", "there"), "group")
    facts = own.select("node", F.col("group").alias("own"), "weight", "n", "size", "sum", hot)
    rows = looked_up(pulls.withColumnRenamed("group", "near"), facts, "node")
    home = F.col("near") == F.col("own")
    after = F.col("pull") - F.col("weight").cast("double") * F.when(home, F.col("there") - F.col("weight")).otherwise(F.col("there")) / total
    scored = rows.groupBy("node", "own", "weight", "n", "size", "sum").agg(
        F.max(F.when(home, F.col("pull"))).alias("pull"), F.max(F.when(home, after)).alias("stay"), F.max(F.when(~home, F.struct(after.alias("gain"), "near"))).alias("best")
    )
    delta = 2 * (F.col("best.gain") - F.col("stay")) / total
    return scored.select("node", F.col("own").alias("group"), "weight", "n", "size", "sum", "pull", F.col("best.near").alias("near"), F.coalesce(delta, F.lit(0.0)).alias("delta"))


def _moved(best: DataFrame, movers: DataFrame | None, turn: int) -> DataFrame:
    """The members after the moves of a round, of all that gain (by hash) or of ``movers`` alone."""
    keep = ["weight", "n", "size"]
    if movers is None:
        moves = (F.col("delta") > 0) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(4)) > 0)
        return best.select("node", F.when(moves, F.col("near")).otherwise(F.col("group")).alias("group"), *keep)
    return best.join(movers, "node", "left").select("node", F.when(F.col("moves"), F.col("near")).otherwise(F.col("group")).alias("group"), *keep)


def _apart(best: DataFrame) -> DataFrame:
    """The moves that are the best of both groups that they touch."""
    touched = best.filter("delta > 0").select("node", "delta", F.explode(F.array("group", "near")).alias("group"))
    first = touched.groupBy("group").agg(F.max(F.struct("delta", "node")).alias("first"))
    return first.groupBy(F.col("first.node").alias("node")).agg((F.count("*") == 2).alias("moves")).filter("moves")


def _level(links: DataFrame, member: DataFrame, total: int) -> tuple[DataFrame, float]:
    """Members after the rounds of one level, and their modularity."""
    count = links.count()
    loops = links.filter("src = dst").agg(F.sum("weight")).first()[0] or 0

    def judged(candidate: DataFrame) -> tuple[DataFrame, float, int]:
        seen = Observation()
        square = F.sum(F.col("weight").cast("double") * F.col("sum") / total)
        best = settled(_best(links, candidate, count, total).observe(seen, F.sum("pull").alias("inside"), square.alias("square"), F.count_if(F.col("delta") > 0).alias("wish")))
        got = seen.get
        return best, ((got["inside"] or 0) + loops) / total - (got["square"] or 0.0) / total, got["wish"]

    best, quality, wish = judged(member)
    at_once = True
    for turn in itertools.count():
        if not wish:
            break
        new, reached, left = judged(_moved(best, None if at_once else _apart(best), turn))
        gained = reached - quality
        if gained > 0:
            best, quality, wish = new, reached, left
        if gained < LEAST_GAIN:
            if not at_once:
                break
            at_once = False
    return best.select("node", "group", "weight", "n", "size"), quality


def _coarser(links: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the groups, and its nodes, each a group of its own."""
    hot = (F.col("n") > links.count() / HOT).alias("hot")
    one = looked_up(links, member.select(F.col("node").alias("src"), F.col("group").alias("a"), hot), "src")
    two = looked_up(one, member.select(F.col("node").alias("dst"), F.col("group").alias("b"), hot), "dst")
    folded = settled(two.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")))
    sizes = member.groupBy(F.col("group").alias("node")).agg(F.sum("size").alias("size"))
    return folded, _nodes(folded, sizes)


def _nodes(links: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    degrees = links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    sized = degrees.withColumn("size", F.lit(1).cast("long")) if sizes is None else degrees.join(sizes, "node")
    return settled(sized.select("node", F.col("node").alias("group"), "weight", "n", "size"))


def _in_one_task(links: DataFrame) -> DataFrame:
    """``group, whole`` of a coarse graph of few links, by moves in order."""
    kind = dict(links.dtypes)["src"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        weights = {(a, b): float(w) / (2 if a == b else 1) for a, b, w in rows[["src", "dst", "weight"]].itertuples(index=False) if a <= b}
        found = louvain(weights)
        least: dict = {}
        for x, c in sorted(found.items()):
            least.setdefault(c, x)
        return pd.DataFrame([(x, least[c]) for x, c in found.items()], columns=["group", "whole"])

    return settled(links.withColumn("graph", F.lit(0)).groupBy("graph").applyInPandas(run, f"group {kind}, whole {kind}"))


def large_communities(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """``node, community`` of each node with a link; a community is named by its least node.

    ``edges``: src, dst, weight, of one graph.  Repeated edges add up whichever way they
    point; loops, nulls and weights of zero or less are no links.
    """
    links = _links(edges)
    total = links.agg(F.sum("weight")).first()[0] or 0
    member = _nodes(links)
    found = member.select("node", "group")
    nodes = member.count()

    def carried(found: DataFrame, whole: DataFrame) -> DataFrame:
        """The nodes in the groups that theirs have joined."""
        return settled(looked_up(found, whole, "group").select("node", F.col("whole").alias("group")))

    left = nodes
    while left > 1 and links.count() > task_links:
        moved, _ = _level(links, member, total)
        moved = settled(moved)
        whole = moved.select(F.col("node").alias("group"), F.col("group").alias("whole"), (F.col("size") > nodes / HOT).alias("hot"))
        found = carried(found, whole)
        links, member = _coarser(links, moved)
        before, left = left, member.count()
        if left == before:
            break
    else:
        if left > 1:
            whole = _in_one_task(links).join(member.select(F.col("node").alias("group"), (F.col("size") > nodes / HOT).alias("hot")), "group")
            found = carried(found, whole)
    least = settled(found.groupBy("group").agg(F.min("node").alias("community"), F.count("*").alias("n")))
    return looked_up(found, least.select("group", "community", (F.col("n") > nodes / HOT).alias("hot")), "group").select("node", "community")


def quality(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row with the ``modularity`` of ``node, community`` in a graph."""
    links = _links(edges)
    count = links.count()
    degree = links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).join(communities, "node")
    hot = (F.col("n") > count / HOT).alias("hot")
    placed = settled(degree)
    one = looked_up(links, placed.select(F.col("node").alias("src"), F.col("community").alias("a"), hot), "src")
    two = looked_up(one, placed.select(F.col("node").alias("dst"), F.col("community").alias("b"), hot), "dst")
    inside = two.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight"))).alias("inside"), F.sum("weight").alias("total"))
    sums = placed.groupBy("community").agg(F.sum("weight").alias("sum")).agg(F.sum(F.col("sum").cast("double") * F.col("sum")).alias("square"))
    return inside.crossJoin(sums).select((F.coalesce("inside", F.lit(0)) / F.col("total") - F.col("square") / F.col("total") / F.col("total")).alias("modularity"))
