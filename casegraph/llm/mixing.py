"""Mixing sources to target weights by weighted fair queueing, on DataFrame functions only.

The documents of a source, in the order of a seeded hash, form a stream that may run
``max_repeats`` times.  Each document of it gets a virtual finish time: the words that its
source has sent by then over its target.  All streams are sorted together by that time
and truncated where the budget is spent, which leaves each source near its target.

Rows are measured once and written; what is sorted carries no texts, and decisions find
their rows by number.  Running totals are taken in two levels, over hash
blocks of a source and within a block, and again over ranges of the finish time and within
a range, so that no task holds a source; a hot key is cut into blocks of its own.  One
task sees a row for each source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.llm.columns import packed, unpacked
from casegraph.llm.hot import LEAST_ROWS, MOST_KEYS
from casegraph.llm.scratch import materialize
from casegraph.llm.text import n_words

#: Least numbers of hash blocks (16 to this power) and of ranges of the finish time, and the
#: rows or entries that one of them has on average in larger inputs.
BLOCK_DIGITS, TIME_RANGES, ROWS_EACH = 3, 4096, 100_000


def _targets(per_source: DataFrame, weights: tuple, budget_share: float, max_repeats: int) -> DataFrame:
    """Rank, weight and target of each source: the weights' shares, none above the cap.

    With the sources in the order of cap over weight, the first k held at their caps and
    the others sharing what is left, the level of the others is highest for the right k.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    ranked = per_source.withColumn("rank", rank).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.col("source_size") * max_repeats)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    budget = F.sum("source_size").over(every) * F.lit(float(budget_share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("budget", budget).withColumn("_level", level)
    share = F.max("_level").over(every) * F.col("weight")
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), share)).drop("_level", "cap")


def _measured(docs: DataFrame, key: str, text: str, source: str, seed: int, owner: str) -> DataFrame:
    """Each row with its size, its place in the order of hashes and its number, written once."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")).cast("string")).cast("binary"))
    name = F.col(source).cast("string")
    base = docs.select(
        packed(docs).alias("_row"),
        F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name)).alias("_source"),
        F.col(key).alias("_key"),
        n_words(F.col(text)).alias("_size"),
        order.alias("_order"),
        F.xxhash64(key, text).alias("_tie"),
    )
    return materialize(base.withColumn("_no", F.monotonically_increasing_id()), "measured", owner)


def _blocked(base: DataFrame, total: int) -> DataFrame:
    """The rows with the block of the order that each is in.

    Blocks are ranges of the order, but rows of a hot key follow at the end of their range
    by ranges of their tie, and rows that are hot in key and text by ranges of their number.
    """
    names = ["_source", "_order"]
    keys = base.groupBy(*names).agg(F.count("*").alias("n"))
    limit = max(LEAST_ROWS, total // MOST_KEYS)
    head = max(BLOCK_DIGITS, math.ceil(math.log(max(1, total / ROWS_EACH), 16)))
    hot = keys.filter(F.col("n") > limit).select(*names, F.lit(True).alias("_hot"))
    same = base.join(F.broadcast(hot), names, "left_semi").groupBy(*names, "_tie").agg(F.count("*").alias("n"))
    alike = same.filter(F.col("n") > limit).select(*names, "_tie", F.lit(True).alias("_alike"))
    marked = base.join(F.broadcast(hot), names, "left").join(F.broadcast(alike), [*names, "_tie"], "left")
    digits = lambda c, n: F.substring(F.hex(c), -n, n)
    tie = F.lpad(F.hex("_tie"), 16, "0")
    ranges = F.when(F.col("_alike"), F.concat(tie, F.lit("~"), F.lpad(digits(F.xxhash64("_no"), 2), 2, "0"))).otherwise(F.substring(tie, 1, 2))
    block = F.concat(F.substring("_order", 1, head), F.when(F.col("_hot"), F.concat(F.lit("~"), "_order", ranges)).otherwise(""))
    return marked.withColumn("_block", block).drop("_hot", "_alike")


def _finish_times(base: DataFrame, total: int, weights: tuple, budget_share: float, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """Each row with the words its source has sent up to it; the sources."""
    base = _blocked(base, total)
    blocks = base.groupBy("_source", "_block").agg(F.sum("_size").alias("_words"), F.max("_size").alias("_longest"))
    per_source = blocks.groupBy("_source").agg(F.sum("_words").alias("source_size"), F.max("_longest").alias("longest"))
    per_source = per_source.withColumn("source", F.when(F.col("_source") != "-", F.substring("_source", 2, 2**31 - 1)))
    targets = _targets(per_source, weights, budget_share, max_repeats)
    earlier = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sent = F.coalesce(F.sum("_words").over(earlier), F.lit(0))
    table = blocks.select("_source", "_block", sent.alias("_sent")).join(targets.drop("source"), "_source")
    within = Window.partitionBy("_source", "_block").orderBy("_order", "_key", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    timed = base.join(table, ["_source", "_block"]).withColumn("_sent", F.col("_sent") + F.sum("_size").over(within))
    return timed, targets


def _entry(epoch: Column) -> Column:
    """A document's place in the global order on one run of its source's stream."""
    time = (epoch * F.col("source_size") + F.col("_sent")) / F.when(F.col("target") > 0, F.col("target"))
    return F.struct(time.alias("time"), F.col("rank").alias("rank"), epoch.cast("int").alias("epoch"), F.col("_order").alias("order"), F.col("_tie").alias("tie"))


def _cut(timed: DataFrame, total: int, budget: float, latest: float, max_repeats: int):
    """The last entry within the budget, by a range-sort of the entries; null if there is none."""
    epochs = F.explode(F.array(*[F.lit(e) for e in range(max_repeats)]))
    entries = timed.filter("_size > 0 and target > 0").withColumn("_epoch", epochs)
    entries = entries.select(_entry(F.col("_epoch")).alias("entry"), "_size").filter(F.col("entry.time") <= latest)
    n_ranges = max(TIME_RANGES, total * max_repeats // ROWS_EACH)
    entries = entries.withColumn("_range", F.floor(F.col("entry.time") / latest * n_ranges).cast("int"))
    ranges = entries.groupBy("_range").agg(F.sum("_size").alias("_words"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select("_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.col("_before") + F.sum("_size").over(within)
    sorted_entries = entries.join(F.broadcast(ranges), "_range").withColumn("_spent", spent)
    return sorted_entries.filter(F.col("_spent") <= F.lit(budget)).agg(F.max("entry")).first()[0]


def mix_documents(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple = (5, 2, 1),
    budget_share: float = 1.0,
    max_repeats: int = 3,
    seed: int = 11,
    owner: str = "query",
) -> DataFrame:
    """Every row with its ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    ``mix_copies`` (0..max_repeats) is how often the mix takes the row; ``mix_time`` is the
    finish time of its first copy.  Sources, by code point with null last, weigh
    ``weights`` over and over and share ``budget_share`` of all words; a target stops at
    ``max_repeats`` times its source's words and the excess is shared by the others.

    A null source is a source; a null or blank text has no words and is never taken; rows
    of a source without words have target 0.  Ties in the order fall to key, size and a
    hash of the text, rows of a key with more than a thousandth of all rows come last in
    their block; rows alike in all of these are interchangeable.  Reruns agree.  An
    empty table gives an empty table.  Input columns named ``mix_...`` are replaced.
    """
    names = docs.columns
    base = _measured(docs, key, text, source, seed, owner)
    total = base.count()
    timed, targets = _finish_times(base.drop("_row"), total, weights, budget_share, max_repeats)
    budget, longest = targets.agg(F.max("budget"), F.sum("longest")).first()
    cut = None
    if budget:
        cut = _cut(timed, total, budget, 1 + (longest + 1) / budget, max_repeats)
    copies = F.lit(0)
    if cut is not None:
        last = F.struct(F.lit(cut.time).alias("time"), F.lit(cut.rank).alias("rank"), F.lit(cut.epoch).alias("epoch"), F.lit(cut.order).alias("order"), F.lit(cut.tie).cast("long").alias("tie"))
        for e in range(max_repeats):
            copies = copies + F.when((F.col("_size") > 0) & (F.col("target") > 0) & (_entry(F.lit(e)) <= last), 1).otherwise(0)
    added = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies, "time": _entry(F.lit(0)).getField("time")}
    decided = timed.select("_no", *[c.alias(f"mix_{n}") for n, c in added.items()])
    joined = base.select("_no", "_row").join(decided, "_no")
    return unpacked(joined, "_row", names, **{f"mix_{n}": F.col(f"mix_{n}") for n in added})


def mixed_stream(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: one row for each taken copy, range-sorted by finish time."""
    names = [c for c in mixed.columns if not c.startswith("mix_")]
    copies = mixed.filter("mix_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    time = F.col("mix_time") + F.col("_epoch") * F.col("mix_source_size") / F.col("mix_target")
    return copies.withColumn("mix_time", time).orderBy("mix_time", key).select(*names, "mix_time")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words of each, its source's target and words taken."""
    mixed = mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk FROM s),
w AS (SELECT *, CAST(CASE (rnk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
      source_size * 3 AS cap, CAST((SELECT sum(size) FROM d) AS DOUBLE) AS budget FROM r),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM w),
t AS (SELECT *, least(CAST(cap AS DOUBLE), (SELECT max(lvl) FROM v) * weight) AS target FROM v),
c AS (SELECT d.doc_id, d.h, d.size, t.rnk, t.source_size, t.target, t.budget,
      sum(d.size) OVER (PARTITION BY t.rnk ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (epoch * source_size + sent) / target AS f FROM c, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND target > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY f, rnk, epoch, h, doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM e),
k AS (SELECT doc_id, count(*) AS copies FROM g WHERE spent <= budget GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM c LEFT JOIN k ON c.doc_id = k.doc_id
"""
