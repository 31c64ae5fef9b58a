"""Graphs as edge tables: hops, components, paths, triangulation, as-of views, bridges and leads."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.functions.scores import relevance
from casegraph.operators.pairs import undirected
from casegraph.operators.picks import top_rows
from casegraph.operators.predicates import survives, without_orphans

# Edge types that only tie the graph together.
STRUCTURAL = ["evidence"]
#: Levels after which what has been reached is written as one table.
REWRITE_EVERY = 8


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; it goes with the application.

    A local folder is made only for a local master, where no folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="casegraph-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/casegraph-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so that loops keep short plans."""
    path = shared_path(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node, hops, parent``: breadth-first distance from the seeds, as far as edges lead; the
    least parent of a level wins."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = settled(edges.select("src", "dst").union(back).filter("src <> dst"))  # an edge may come twice: each level groups what it meets
    reached = settled(seeds.select(F.col("node"), F.lit(0).alias("hops"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent")).distinct())
    for level in itertools.count(1):
        front = reached.filter(F.col("hops") == level - 1).select(F.col("node").alias("src"))
        nexts = both.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        met = Observation()
        fresh = nexts.join(reached.select("node"), "node", "left_anti").select("node", F.lit(level).alias("hops"), "parent")
        new = settled(fresh.observe(met, F.count("*").alias("n")))
        if not met.get["n"]:
            break
        reached = reached.union(new)
        if level % REWRITE_EVERY == 0:  # one table in place of one for each level
            reached = settled(reached)
    return reached


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` by least labels with jumps over labels of labels.

    No round sends labels through the driver: joins of nodes with nodes are shuffled.
    """
    both = settled(undirected(edges))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near.hint("merge"), "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("far"))
        new = settled(lower.join(jump.hint("merge"), "label").select("node", F.least("label", "far").alias("component"), "old"))
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def simple_paths(edges: DataFrame, pairs: DataFrame, most: int = 4, k: int = 3) -> DataFrame:
    """``a, b, hops, path, rank``: the k shortest simple paths of at most ``most`` edges of each
    pair, those of one length in the order of their nodes.

    Lengths are tried in turn, and a pair that has its k paths is not followed any further.
    The two halves of a path meet in its middle node.  Only nodes of two neighbours and more
    lie inside a path.  Of the halves of two edges between an end and a middle the first
    k + 2 are enough: one may hold the other end and one a node of the other half, and k are
    left; so a hub costs its neighbours and not its pairs of neighbours.
    """
    both = settled(undirected(edges))
    inside = both.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("src").alias("dst"))
    inner = settled(both.join(inside, "dst", "left_semi").select("src", "dst"))
    asked = settled(pairs.select("a", "b").filter("a <> b").distinct())

    def half(ends: DataFrame, length: int) -> DataFrame:
        """``end, middle, path``: the path from an end to a middle node."""
        out = ends.select("end", F.col("end").alias("middle"), F.array("end").alias("path"))
        for step in range(length):
            grown = out.join(inner.select(F.col("src").alias("middle"), "dst"), "middle").filter(~F.array_contains("path", F.col("dst")))
            out = grown.select("end", F.col("dst").alias("middle"), F.concat("path", F.array("dst")).alias("path"))
            if step == 1 and length == 2:
                out = top_rows(out, ["end", "middle"], k + 2, "path")
        return out

    def of_length(left: DataFrame, n: int) -> DataFrame:
        if n == 1:
            met = left.join(both, (F.col("a") == F.col("src")) & (F.col("b") == F.col("dst")))
            return met.select("a", "b", F.lit(1).alias("hops"), F.array("a", "b").alias("path"))
        one = half(left.select(F.col("a").alias("end")).distinct(), (n + 1) // 2).select(F.col("end").alias("a"), "middle", F.col("path").alias("pa"))
        two = half(left.select(F.col("b").alias("end")).distinct(), n // 2).select(F.col("end").alias("b"), "middle", F.col("path").alias("pb"))
        met = left.join(one, "a").join(two, ["b", "middle"]).filter(F.size(F.array_intersect("pa", "pb")) == 1)
        whole = met.select("a", "b", F.lit(n).alias("hops"), F.concat("pa", F.slice(F.reverse("pb"), 2, most + 1)).alias("path"))
        return top_rows(whole, ["a", "b"], k, "path")

    found, left = [], asked
    for n in range(1, most + 1):
        found.append(settled(of_length(left, n)))
        if n == most:
            break
        enough = reduce(DataFrame.union, found).groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        left = settled(asked.join(enough.select("a", "b"), ["a", "b"], "left_anti"))
        if left.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("a", "b").orderBy("hops", "path"))
    return reduce(DataFrame.union, found).withColumn("rank", rank).filter(F.col("rank") <= k)


def triangulate(edges: DataFrame, probs: DataFrame, root, keep_low: bool = False) -> tuple[DataFrame, DataFrame]:
    """Surviving nodes with relevance and score, and their edges with the wiring of the unreachable.

    ``probs``: node, prob (rows only for nodes with evidence), is_event.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(root,)], edges.select(F.col("src").alias("node")).schema)
    near = hops(edges, start)
    nodes = undirected(edges).select(F.col("src").alias("node")).distinct()
    known = nodes.join(probs, "node", "full").join(near, "node", "left")
    alive = known.filter(survives(F.col("node") == root, F.coalesce("is_event", F.lit(False)), F.col("prob").isNotNull(), F.col("prob"), keep_low))
    rel = F.when(F.col("node") == root, 1.0).otherwise(relevance(F.col("hops")))
    scored = settled(alive.select("node", "prob", rel.alias("relevance"), F.round(rel * F.coalesce("prob", F.lit(0.0)), 6).alias("score")))
    kept = settled(without_orphans(edges, scored).select("src", "dst", F.lit("given").alias("kind")))
    joined = hops(kept, start).select("node")
    lost = scored.select("node").join(joined, "node", "left_anti").filter(F.col("node") != root)
    wires = lost.select(F.col("node").alias("src"), F.lit(root).cast(edges.schema["src"].dataType).alias("dst"), F.lit("evidence").alias("kind"))
    return scored, kept.union(wires)


def corroborated_edges(edges: DataFrame, root, least: int = 2) -> DataFrame:
    """Edges that enough sources attest, and the shortest paths that hold cut-off nodes to the root.

    ``edges``: src, dst, source_count (1 if missing).
    """
    start = edges.sparkSession.createDataFrame([(root,)], edges.select(F.col("src").alias("node")).schema)
    strong = edges.filter(F.coalesce("source_count", F.lit(1)) >= least).select("src", "dst")
    before = settled(hops(edges, start))
    after = hops(strong, start) if not strong.isEmpty() else start
    needed = settled(before.join(after.select("node"), "node", "left_anti"))
    held = []
    for level in range(needed.agg(F.max("hops")).first()[0] or 0, 0, -1):  # each node climbs once
        step = settled(needed.filter(F.col("hops") == level).select(F.col("node").alias("src"), F.col("parent").alias("dst")).distinct())
        held.append(step)
        above = before.join(step.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        needed = needed.filter(F.col("hops") < level).union(above)
    least = lambda e: e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return reduce(DataFrame.union, map(least, held), least(strong)).distinct()


def as_of(nodes: DataFrame, edges: DataFrame, day: str | None = None, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph as known on a day, or what of it falls between two days; what has no date stays.

    ``nodes``: node, is_event, day; ``edges``: src, dst, first_seen, window_from, structural,
    and window_to for a span of days.  An edge begins with its first day, or else its
    window, and ends with its window, or else its first day.  Entities that no other than
    a structural edge holds are pruned.  Without any day the graph stays as it is.
    """
    if day is None and since is None and until is None:
        return nodes, edges
    date = lambda x: F.lit(x).cast("date")
    start = F.coalesce("first_seen", "window_from")
    if day is not None:
        edge_ok, event_ok = start <= date(day), F.col("day") <= date(day)
    else:
        end = F.coalesce(F.col("window_to") if "window_to" in edges.columns else F.lit(None).cast("date"), F.col("first_seen"))
        edge_ok = F.lit(True) if until is None else start <= date(until)
        event_ok = F.lit(True) if until is None else F.col("day") <= date(until)
        if since is not None:
            edge_ok, event_ok = edge_ok & (end.isNull() | (end >= date(since))), event_ok & (F.col("day") >= date(since))
    seen = edges.filter(start.isNull() | edge_ok)
    past = nodes.filter(~F.col("is_event") | F.col("day").isNull() | event_ok)
    live = without_orphans(seen, past)
    solid = live.filter(~F.col("structural"))
    held = solid.select(F.col("src").alias("node")).union(solid.select("dst")).distinct()
    kept = past.filter("is_event").union(past.filter("not is_event").join(held, "node", "left_semi"))
    return kept, without_orphans(live, kept)


def provenance(edges: DataFrame, root) -> DataFrame:
    """``node, path``: a shortest path of each node to the root, as an array of nodes from it."""
    near = settled(hops(edges, edges.sparkSession.createDataFrame([(root,)], edges.select(F.col("src").alias("node")).schema)))
    most = near.agg(F.max("hops")).first()[0] or 0
    up = near.select(F.col("node").alias("at"), "parent")
    paths = near.select("node", F.col("node").alias("at"), F.array("node").alias("path"))
    for level in range(most):
        step = paths.join(up, "at")
        grown = F.when(F.col("parent").isNull(), F.col("path")).otherwise(F.concat("path", F.array("parent")))
        paths = step.select("node", F.coalesce("parent", "at").alias("at"), grown.alias("path"))
        if level % REWRITE_EVERY == REWRITE_EVERY - 1:
            paths = settled(paths)
    return paths.select("node", "path")


def bridges(node_runs: DataFrame) -> DataFrame:
    """``node, runs, n_runs`` of nodes that several runs attest.  ``node_runs``: node, run."""
    g = node_runs.groupBy("node").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    return g.withColumn("n_runs", F.size("runs")).filter("n_runs >= 2")


def leads(edges: DataFrame, node_runs: DataFrame, posterior: DataFrame) -> DataFrame:
    """``a, b, n_bridges, score``: nodes of one run each, of different runs, that share bridges.

    ``posterior``: node, p.  Hubs join their neighbours once; pairs are summed over bridges.
    """
    runs = node_runs.groupBy("node").agg(F.countDistinct("run").alias("n"), F.min("run").alias("run"))
    single = runs.filter("n = 1").select("node", "run")
    bridge = runs.filter("n >= 2").select(F.col("node").alias("src")).join(posterior.select(F.col("node").alias("src"), "p"), "src")
    near = undirected(edges).join(bridge, "src").join(single.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "run", "p")
    one = near.select("src", F.col("dst").alias("a"), F.col("run").alias("ra"), "p")
    two = near.select("src", F.col("dst").alias("b"), F.col("run").alias("rb"))
    pairs = one.join(two, "src").filter("a < b and ra <> rb")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_bridges"), F.sum("p").alias("score"))


def adjacency(edges: DataFrame, most: int | None = None) -> DataFrame:
    """``node, near`` of each node; hubs of more than ``most`` neighbours are left out."""
    both = undirected(edges)
    if most is not None:  # a hub's neighbours are counted and never gathered
        few = both.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("src")
        both = both.join(few, "src", "left_semi")
    return both.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("near"))


def balanced_sample(members: DataFrame, n: int = 25) -> DataFrame:
    """``id, how``: half by score, half in turns over the communities, best community first.

    ``members``: id, community, score.
    """
    top = members.orderBy(F.desc("score"), "id").limit(n // 2).select("id")
    rest = members.join(top, "id", "left_anti")
    order = members.groupBy("community").agg(F.max("score").alias("best"))
    order = order.withColumn("place", F.row_number().over(Window.orderBy(F.desc("best"), "community")))
    lap = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "id"))
    turns = rest.withColumn("lap", lap).join(order, "community").orderBy("lap", "place").limit(n - n // 2)
    return top.withColumn("how", F.lit("top")).union(turns.select("id", F.lit("lap").alias("how")))
