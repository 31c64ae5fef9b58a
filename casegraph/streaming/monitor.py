"""The standing monitor: watchlists, windows, alerts once, and the daily job on micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from casegraph.functions.dates import recency_decay
from casegraph.functions.scores import event_strength
from casegraph.operators import cep
from casegraph.operators.inference import impact
from casegraph.operators.roots import events_of_graph, united_events

ALERT_SCORE, MOST_IMPACTED = 0.2, 12


def intersect(events: DataFrame, aliases: DataFrame, watched: DataFrame) -> DataFrame:
    """``event, entities, watched`` of the events with a participant that the store knows.

    ``aliases``: alias (upper case), canonical; ``watched``: canonical.
    """
    named = events.select("event", F.explode(F.transform("participants", F.upper)).alias("alias"))
    known = named.join(aliases, "alias").select("event", "canonical")
    seen = known.join(watched.select("canonical", F.lit(True).alias("w")), "canonical", "left")
    return seen.groupBy("event").agg(F.array_sort(F.collect_set("canonical")).alias("entities"), F.bool_or(F.coalesce("w", F.lit(False))).alias("watched"))


def watchlist(entries: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """The upper-cased set of subjects after additions and removals."""
    spark = entries.sparkSession
    one = lambda names: spark.createDataFrame([(x.strip().upper(),) for x in names], "subject string")
    out = entries.select(F.upper(F.trim("subject")).alias("subject")).union(one(add)).distinct()
    return out.join(one(remove), "subject", "left_anti")


def windowed(events: DataFrame, length: str, late: str | None = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and type; with ``late``, under a watermark for streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def alerts_once(matches: DataFrame) -> DataFrame:
    """A stream's matches of which no (rule, final) has gone out before; of several in one
    batch the least goes out.  The state outlives restarts; it is a flag for each story."""

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if not state.exists:
            state.update((1,))
            yield rows.sort_values(list(rows.columns), key=lambda c: c.map(repr) if c.dtype == object else c).head(1)

    schema = matches.schema
    return matches.groupBy("rule", "final").applyInPandasWithState(first, schema, "fired int", "append", GroupStateTimeout.NoTimeout)


def digest(impacted: DataFrame, events: DataFrame) -> DataFrame:
    """Events by the score of what they touch most, with at most 12 impacted nodes each, and alerts."""
    from casegraph.operators.picks import top_rows

    top = top_rows(impacted, ["event"], MOST_IMPACTED, F.desc("score"), "node")
    sums = top.groupBy("event").agg(F.max("score").alias("top_score"), F.count("*").alias("n"))
    return events.join(sums, "event").withColumn("alert", F.col("top_score") >= ALERT_SCORE).orderBy(F.desc("top_score"), "event")


def longest_window(rules: list[dict]) -> int:
    """Days that the longest rule looks back."""
    return max((int(r.get("windowDays") or 30) for r in rules), default=30)


def recent(matches: DataFrame, rules: list[dict], today: str) -> DataFrame:
    """Chains whose last event is no older than the longest window of the rules."""
    return matches.filter(F.col("last") >= F.date_sub(F.lit(today).cast("date"), longest_window(rules)))


def day_intake(subjects: list[str], fetch: Callable[[str], list[dict]], extract: Callable[[list[dict]], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Nodes and edges of the day's articles about all subjects, and the subjects that failed.

    ``fetch`` gives a subject's articles and ``extract`` the graph of all of them; a subject
    that cannot be fetched costs only itself.
    """
    articles, failed = [], []
    for subject in subjects:
        try:
            articles += fetch(subject) or []
        except Exception:  # noqa: BLE001  the fetcher is the caller's
            failed.append(subject)
    return (*extract(articles), failed)


def run_once(
    nodes: DataFrame, edges: DataFrame, *, aliases: DataFrame, stored: DataFrame, store_edges: DataFrame, store_nodes: DataFrame, fired: DataFrame, watched: list[str], rules: list[dict], today: str
) -> dict[str, DataFrame]:
    """The day's loop: the events of its graph that touch the store, their impact, the digest,
    and the stories that they and the stored events make, told once.

    ``nodes`` and ``edges`` are the day's graph as :func:`events_of_graph` takes it, with
    ``strength`` on nodes; ``aliases``: alias (upper case), canonical; ``stored``: events;
    ``store_edges``: src, dst, weight; ``store_nodes``: node, prob; ``fired``: rule, final,
    day.  Returns ``digest``, ``impact``, ``patterns`` (new), ``seen`` and ``fired``.
    """
    day = events_of_graph(nodes, edges)
    names = aliases.sparkSession.createDataFrame([(w,) for w in watched], "canonical string")
    touching = intersect(day, aliases, names)
    strength = touching.join(nodes.select(F.col("node").alias("event"), "strength"), "event").join(day.select("event", "day"), "event")
    touched = strength.select("event", F.col("entities").alias("touched"), event_strength(F.col("strength")).alias("strength"), recency_decay(F.col("day"), F.lit(today).cast("date")).alias("recency"))
    ripples = impact(touched, store_edges, store_nodes, watched=watched)
    every = united_events(stored, day, aliases)
    since = str(date.fromisoformat(today) - timedelta(days=longest_window(rules)))
    stories = cep.collapsed(cep.match_rules(every, rules, store_edges, watched, since))
    new, seen = cep.new_and_fired(stories, fired)
    return {"digest": digest(ripples, touching), "impact": ripples, "patterns": new, "seen": seen, "fired": cep.marked(fired, new, today)}


def run_daily(stream: DataFrame, stored: Callable[[], DataFrame], fired_path: str, out_path: str, rules: list[dict], checkpoint: str):
    """The daily job over a stream of events: match with stored ones, collapse, alert once, record.

    A micro-batch is the single writer; a batch that is run again finds its own alerts
    recorded under its id and leaves them be.  Stored events older than the rules can reach
    back from the batch are not matched again, and of one event the latest record counts.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = stored()
        oldest = batch.agg(F.min("day")).first()[0]
        if oldest is not None:
            reach = longest_window(rules) * max(len(r["steps"]) for r in rules)
            known = known.filter(F.col("day") >= F.date_sub(F.lit(oldest), reach))
        rank = F.struct(F.col("fresh"), "day", "event_type", "text")
        both = known.withColumn("fresh", F.lit(0)).unionByName(batch.select(*known.columns).withColumn("fresh", F.lit(1)))
        rest = [c for c in known.columns if c != "event"]
        every = both.groupBy("event").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("event", "r.*").select(*known.columns)
        fired_schema = "rule string, final long, batch long"
        spark.createDataFrame([], fired_schema).write.mode("append").parquet(fired_path)
        fired = spark.read.schema(fired_schema).parquet(fired_path).filter(F.col("batch") != batch_id)
        for rule in rules:
            stories = cep.collapsed(cep.match_rule(every, rule))
            fresh = stories.join(batch.select(F.col("event").alias("final")), "final", "left_semi").join(fired.select("rule", "final"), ["rule", "final"], "left_anti")
            new = fresh.select("rule", "final", F.col("days").cast("long").alias("days"), F.lit(batch_id).cast("long").alias("batch"))
            name = rule["name"].replace(" ", "_")
            new.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}/rule={name}")
            spark.read.parquet(f"{out_path}/batch={batch_id}/rule={name}").select("rule", "final", F.lit(batch_id).cast("long").alias("batch")).write.mode("append").parquet(fired_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
