"""Event patterns on a stream, from state: open chains wait for their next event.

Each step of a rule after the first joins two streams by participant: the chains so far and
the events that the step takes, so that either may come first.  Both are state until the
watermark has passed the window after a chain's last event, or an event that no chain can
come before any more: the state is bounded by the window, whatever the stream's length.
What a step completes goes on to the next one with the day of its last event as event time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.operators.cep import MOST_BRIDGES
from casegraph.operators.predicates import step_matches, valid_rule
from casegraph.streaming.monitor import alerts_once

#: The state store that holds more than a task's memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _days(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def match_stream(events: DataFrame, rule: dict, late: str = "1 day") -> DataFrame:
    """``chain, first, last, days, bridges, rule, severity`` of the rule's chains on a stream.

    ``events``: event, day, event_type, text, participants, as for the batch form, whose
    chains these are in any batching.  An event that comes more than ``late`` after the
    newest day is dropped, as is one without a day; one that comes again counts once while
    it can matter.  A chain is told when its last event or the last link of it arrives.
    The session's state store has to be RocksDB (:data:`STORE`).
    """
    if not valid_rule(rule):
        raise ValueError(f"not a rule: {rule}")
    window = int(rule.get("windowDays") or 30)
    parts = F.array_sort(F.array_distinct(F.transform(F.filter("participants", lambda p: p.isNotNull()), lambda p: p.cast("string"))))
    timed = events.filter("day is not null").select("event", "day", "event_type", "text", parts.alias("parts"), F.col("day").cast("timestamp").alias("ts")).withWatermark("ts", late)
    takes = [step_matches(s, F.col("event_type"), F.concat_ws(" ", "text", F.col("event").cast("string"))) for s in rule["steps"]]
    once = [timed.filter(take).dropDuplicatesWithinWatermark(["event"]) for take in takes]
    none = F.array().cast("array<string>")
    chains = once[0].select(
        F.array(F.col("event").cast("long")).alias("chain"), _days(F.col("day")).alias("first"), _days(F.col("day")).alias("last"), none.alias("bridges"), "parts", F.col("parts").alias("seen"), "ts"
    )
    for taken in once[1:]:
        nexts = taken.select(F.col("event").cast("long").alias("event"), _days(F.col("day")).alias("next"), F.col("parts").alias("names"), F.col("ts").alias("at"), F.explode("parts").alias("who"))
        waiting = chains.withColumn("tie", F.explode("parts"))
        common = F.array_intersect("parts", "names")
        soon = F.col("at").between(F.col("ts"), F.col("ts") + F.expr(f"interval {window + 1} days"))  # bounds the state; days of a clock's change have other hours
        follows = (F.col("next") - F.col("last")).between(0, window) & (F.col("event") != F.element_at("chain", -1))
        met = waiting.join(nexts, (F.col("tie") == F.col("who")) & soon & follows & (F.array_min(common) == F.col("tie")))  # of several participants the least tells it
        united = lambda a, b: F.concat(a, F.array_except(b, a))
        chains = met.select(F.concat("chain", F.array("event")).alias("chain"), "first", F.col("next").alias("last"), united("bridges", common).alias("bridges"), F.col("names").alias("parts"), united("seen", "names").alias("seen"), F.col("at").alias("ts"))
    date = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c)).alias(c)
    shown = F.slice(F.array_sort("bridges"), 1, MOST_BRIDGES).alias("bridges")
    return chains.select("chain", date("first"), date("last"), (F.col("last") - F.col("first")).alias("days"), shown, F.lit(rule["name"]).alias("rule"), F.lit(rule.get("severity", "medium")).alias("severity"))


def match_streams(events: DataFrame, rules: list[dict], late: str = "1 day") -> DataFrame:
    """The chains of all rules; one that several rules find is told by each."""
    return reduce(DataFrame.unionByName, [match_stream(events, r, late) for r in rules])


def watch(events: DataFrame, rules: list[dict], out_path: str, checkpoint: str, late: str = "1 day"):
    """The standing monitor: each story of the stream (a rule and a final event) goes out once.

    Of the chains of a story that a batch completes the one with most bridges goes out, then
    the shortest.  Nothing is matched again: open chains and told stories are state, and the
    file sink writes each batch once, also after a restart.
    """
    final = F.element_at("chain", -1).alias("final")
    told = match_streams(events, rules, late).select("rule", final, (-F.size("bridges")).alias("order"), "days", "chain", "bridges", "first", "last", "severity")
    rows = alerts_once(told).drop("order")
    return rows.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
