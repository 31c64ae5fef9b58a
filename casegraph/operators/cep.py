"""Event patterns: chains of events by rule, one story for each final event, alerts once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegraph.operators.pairs import undirected
from casegraph.operators.picks import first_wins
from casegraph.operators.predicates import step_matches, valid_rule

# The built-in rules, the hub bound, the most bridges and matches shown.
DEFAULT_RULES = [
    {"name": "sanctioned actor's network transacts", "windowDays": 60, "severity": "high", "steps": [{"types": ["sanctions"]}, {"types": ["financial_crime", "corporate_action"], "keywords": ["transact", "transfer", "payment", "funnel", "launder"]}]},
    {"name": "indictment followed by sanctions", "windowDays": 90, "severity": "medium", "steps": [{"types": ["indictment"]}, {"types": ["sanctions"]}]},
    {"name": "strike then diplomatic fallout", "windowDays": 30, "severity": "medium", "steps": [{"types": ["military_action"]}, {"types": ["diplomatic"]}]},
]
HUB_DEGREE, MOST_BRIDGES, MOST_MATCHES = 25, 8, 200


def hubs(edges: DataFrame) -> DataFrame:
    """``node`` of the nodes with too many neighbours to link anything."""
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).filter(F.col("n") > HUB_DEGREE).select("node")


def links(events: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``event, tie`` of each event's participants, and ``event, tie, via`` of what it may meet.

    An event meets another in a common participant, or where a participant of the one is
    a neighbour (``via``) of one of the other; hubs link nothing on either side.
    ``events``: event, participants.
    """
    own = events.select("event", F.explode("participants").alias("tie")).distinct()
    if edges is None:
        return own, own.withColumn("via", F.col("tie"))
    out = hubs(edges)
    own = own.join(out.withColumnRenamed("node", "tie"), "tie", "left_anti").select("event", "tie")
    plain = undirected(edges).join(out.withColumnRenamed("node", "src"), "src", "left_anti").join(out.withColumnRenamed("node", "dst"), "dst", "left_anti")
    near = own.join(plain.select(F.col("src").alias("tie"), "dst"), "tie").select("event", F.col("dst").alias("tie"), F.col("tie").alias("via"))
    return own, own.withColumn("via", F.col("tie")).union(near)


def match_rule(events: DataFrame, rule: dict, edges: DataFrame | None = None, watched: list[str] | None = None) -> DataFrame:
    """Chains ``chain, days, first, last, bridges, rule``: each event follows the one before it
    within the window and is linked with it.

    ``events``: event, day, event_type, text, participants.  A step is a join on the tie;
    what it joins is filtered by the step first.  With ``watched`` names, a chain has one of
    them among its participants, and shows those of its bridges if there are any;
    ``bridges`` are eight at most.
    """
    if not valid_rule(rule):
        raise ValueError(f"not a rule: {rule}")
    window = int(rule.get("windowDays") or 30)
    dated = events.filter("day is not null")
    own, ties = links(dated.select("event", "participants"), edges)
    steps = [dated.filter(step_matches(s, F.col("event_type"), F.concat_ws(" ", "text", F.col("event").cast("string")))) for s in rule["steps"]]
    names = F.transform("participants", lambda p: p.cast("string")).alias("parts")
    chains = steps[0].select(F.array("event").alias("chain"), F.col("day").alias("first"), F.col("day").alias("last"), F.col("event").alias("at"), F.array().cast("array<string>").alias("bridges"), names)
    for step in steps[1:]:
        nexts = step.select(F.col("event").alias("next"), F.col("day").alias("next_day"), F.transform("participants", lambda p: p.cast("string")).alias("next_parts"))
        nexts = nexts.join(own.withColumnRenamed("event", "next"), "next")
        met = chains.join(ties.withColumnRenamed("event", "at"), "at").join(nexts, "tie")
        met = met.filter((F.col("at") != F.col("next")) & F.datediff("next_day", "last").between(0, window))
        ends = F.flatten(F.collect_set(F.array(F.col("tie").cast("string"), F.col("via").cast("string"))))
        grown = met.groupBy("chain", "first", "last", "at", "bridges", "parts", "next", "next_day", "next_parts").agg(ends.alias("new"))
        chains = grown.select(F.concat("chain", F.array("next")).alias("chain"), "first", F.col("next_day").alias("last"), F.col("next").alias("at"), F.array_union("bridges", "new").alias("bridges"), F.array_union("parts", "next_parts").alias("parts"))
    shown = F.col("bridges")
    if watched is not None:
        of = F.array(*[F.lit(w) for w in watched]).cast("array<string>")
        chains = chains.filter(F.arrays_overlap("parts", of))
        shown = F.when(F.arrays_overlap("bridges", of), F.array_intersect("bridges", of)).otherwise(F.col("bridges"))
    return chains.select("chain", "first", "last", F.datediff("last", "first").alias("days"), F.slice(F.array_sort(shown), 1, MOST_BRIDGES).alias("bridges"), F.lit(rule["name"]).alias("rule"), F.lit(rule.get("severity", "medium")).alias("severity"))


def match_rules(events: DataFrame, rules: list[dict], edges: DataFrame | None = None, watched: list[str] | None = None, since: str | None = None) -> DataFrame:
    """Chains of all rules, those of several rules under the first; with ``since``, only those
    whose last event is no older."""
    found = [match_rule(events, r, edges, watched).withColumn("order", F.lit(i)) for i, r in enumerate(rules)]
    every = reduce(DataFrame.unionByName, found)
    if since is not None:
        every = every.filter(F.col("last") >= F.lit(since).cast("date"))
    return first_wins(every, ["chain"], "order").drop("order")


def latest(matches: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """What is shown of the matches: the most recent ones, ties by rule and chain."""
    return matches.orderBy(F.desc("last"), "rule", "chain").limit(most)


def collapsed(matches: DataFrame) -> DataFrame:
    """The best chain of each rule and final event, with the number of others."""
    final = F.element_at("chain", -1)
    w = Window.partitionBy("rule", "final")
    best = w.orderBy(F.desc(F.size("bridges")), "days", "chain")
    rows = matches.withColumn("final", final).withColumns({"_r": F.row_number().over(best), "alternates": F.count("*").over(w) - 1})
    return rows.filter("_r = 1").drop("_r")


def new_and_fired(matches: DataFrame, fired: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches whose (rule, final) has not fired yet, and the others.  ``fired``: rule, final, day."""
    keys = fired.select("rule", "final").distinct()
    return matches.join(keys, ["rule", "final"], "left_anti"), matches.join(keys, ["rule", "final"], "left_semi")


def marked(fired: DataFrame, matches: DataFrame, day: str) -> DataFrame:
    """The fired state with new matches; the first day stays."""
    new = matches.select("rule", "final", F.lit(day).cast("date").alias("day"))
    return fired.select("rule", "final", "day").union(new).groupBy("rule", "final").agg(F.min("day").alias("day"))
