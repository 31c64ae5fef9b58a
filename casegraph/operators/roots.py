"""The root of an investigation: the entity that its subject names, or the most connected one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions.names import found, token_run
from casegraph.operators.picks import first_wins


def match_roots(subjects: DataFrame, entities: DataFrame, representatives: DataFrame, graph_nodes: DataFrame, name_in_subject: bool = True) -> DataFrame:
    """``subject, root``: the first candidate of each subject, those in the graph before others.

    A candidate's name holds the subject's words as a run, or stands as a run in the
    subject (only with ``name_in_subject``).  Entities come before representatives, each in
    order; events name no root.  Subjects and names meet by the first word of the shorter.
    ``subjects``: subject; ``entities``: ord, canonical, names, is_event;
    ``representatives``: ord, canonical, names; ``graph_nodes``: node.
    """
    words = lambda c: found(F.upper(F.coalesce(c, F.lit(""))), "[A-Z0-9]+")
    own = entities.filter("not is_event").select(F.lit(0).alias("kind"), "ord", "canonical", F.explode("names").alias("name"))
    groups = representatives.select(F.lit(1).alias("kind"), "ord", "canonical", F.explode("names").alias("name"))
    names = own.unionByName(groups).select("kind", "ord", F.upper("canonical").alias("canonical"), words(F.col("name")).alias("run")).filter(F.size("run") > 0)
    asked = subjects.select("subject", words(F.col("subject")).alias("q")).filter(F.size("q") > 0)
    inside = asked.withColumn("token", F.col("q")[0]).join(names.withColumn("token", F.explode(F.array_distinct("run"))), "token").filter(token_run(F.col("run"), F.col("q")))
    hits = inside.select("subject", "kind", "ord", "canonical")
    if name_in_subject:
        around = asked.withColumn("token", F.explode(F.array_distinct("q"))).join(names.withColumn("token", F.col("run")[0]), "token").filter(token_run(F.col("q"), F.col("run")))
        hits = hits.union(around.select("subject", "kind", "ord", "canonical"))
    marked = hits.join(graph_nodes.select(F.col("node").alias("canonical"), F.lit(0).alias("outside")).distinct(), "canonical", "left")
    ranked = marked.select("subject", F.struct(F.coalesce("outside", F.lit(1)).alias("outside"), "kind", "ord", "canonical").alias("place"))
    return ranked.groupBy("subject").agg(F.min("place")["canonical"].alias("root"))


def roots_or_most_connected(subjects: DataFrame, roots: DataFrame, degrees: DataFrame) -> DataFrame:
    """``subject, root``: where no entity is named, the node of highest degree, if any exceeds 1."""
    best = degrees.filter("degree > 1").orderBy(F.desc("degree"), "node").limit(1).select(F.col("node").alias("_best"))
    joined = subjects.select("subject").join(roots, "subject", "left").join(F.broadcast(best), how="left")  # one row at most
    return joined.select("subject", F.coalesce("root", "_best").alias("root"))


def merged_events(rows: DataFrame) -> DataFrame:
    """The store's events: dates, sources, participants, runs and investigations united, the
    first text of each kind that says something.

    ``rows``: event, ord, date, kind, description, location, url, participants, runs, investigation.
    """
    first = lambda c: F.min_by(F.trim(c), F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col("ord")))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("event").agg(
        F.array_sort(F.collect_set(F.nullif("date", F.lit("")))).alias("dates"),
        F.coalesce(first("kind"), F.lit("")).alias("kind"),
        F.coalesce(F.substring(first("description"), 1, 500), F.lit("")).alias("description"),
        F.coalesce(first("location"), F.lit("")).alias("location"),
        F.array_sort(F.collect_set(F.when(F.col("url").startswith("http"), F.col("url")))).alias("sources"),
        united("participants").alias("participants"),
        united("runs").alias("runs"),
        F.array_sort(F.collect_set("investigation")).alias("investigations"),
    )


def distinct_orderings(edges: DataFrame) -> DataFrame:
    """Each ordering edge (type, src, dst) once."""
    return edges.select("type", "src", "dst").distinct()


def events_of_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``event, day, event_type, text, participants`` of a day's graph, as patterns take them.

    Participants are those of the event's record and of participation edges.  ``nodes``:
    node, is_event, date, event_type, description, participants; ``edges``: src, dst, type.
    """
    from casegraph.functions.dates import earliest_day

    linked = edges.filter("type = 'event_participation'").select(F.col("src").alias("node"), F.col("dst").alias("who"))
    own = nodes.filter("is_event").select("node", F.explode("participants").alias("who"))
    parts = own.union(linked).filter("who is not null and who <> ''").groupBy("node").agg(F.array_sort(F.collect_set("who")).alias("all"))
    none = F.array().cast("array<string>")
    return nodes.filter("is_event").join(parts, "node", "left").select(
        F.col("node").alias("event"), F.try_to_date(F.substring(earliest_day(F.col("date")), 1, 10), "yyyy-MM-dd").alias("day"), "event_type", F.col("description").alias("text"), F.coalesce("all", none).alias("participants"),
    )


def united_events(stored: DataFrame, fresh: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Stored events, and fresh ones of other ids with their participants by canonical name.

    ``known``: alias (upper case), canonical.
    """
    if known is not None:
        spread = fresh.select("event", F.explode("participants").alias("p")).join(known, F.upper("p") == F.col("alias"), "left")
        named = spread.groupBy("event").agg(F.array_sort(F.collect_set(F.coalesce("canonical", "p"))).alias("named"))
        none = F.array().cast("array<string>")
        fresh = fresh.join(named, "event", "left").withColumn("participants", F.coalesce("named", none)).drop("named")
    new = first_wins(fresh.join(stored.select("event"), "event", "left_anti").select(*stored.columns), ["event"], "day")
    return stored.unionByName(new)
