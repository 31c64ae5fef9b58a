"""Evidence: signed probability, tiers, verdicts, causal weights, consolidation, corroboration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.scores import VERDICT_LADDER, VERDICT_LAST, clamped, ladder, tier
from casegraph.operators.pairs import resolved
from casegraph.operators.picks import first_wins, top_rows

# Gain and cap of corroboration.
CORROBORATION_GAIN, CORROBORATION_CAP = 0.35, 8
# Similarity of one claim, of a syndicated copy, and the pool of a polarity.
CLAIM_SIMILARITY, SYNDICATION_SIMILARITY, POOL = 0.78, 0.97, 300
SOURCES_FOR_FULL = 3


def source_key(doc_id: Column, source: Column, link: Column) -> Column:
    """The first of the three that says something, lower-case."""
    some = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return F.coalesce(some(doc_id), some(source), some(link))


def assess(evidence: DataFrame) -> DataFrame:
    """``entity, prob, n_sources, tier`` from rows of entity, source, strength, confidence, supports.

    The signal is the mean of the signed strengths by confidence; several sources on the
    winning side amplify it.  Rows without confidence do not vote.  Rows are summed by
    source first, so that each source is counted where it is.
    """
    sign = F.when(F.col("supports"), 1.0).otherwise(-1.0)
    strength = F.coalesce("strength", F.lit(0.0))
    votes = evidence.filter(F.col("confidence") > 0)
    sides = votes.groupBy("entity", "source", "supports").agg(F.sum(sign * strength * F.col("confidence")).alias("signed"), F.sum("confidence").alias("weight"), F.max(strength).alias("most"))
    backing = lambda side: F.count_if(side & (F.col("most") > 0) & F.col("source").isNotNull())
    sums = sides.groupBy("entity").agg(
        (F.sum("signed") / F.sum("weight")).alias("signal"),
        backing(F.col("supports")).alias("pro"),
        backing(~F.col("supports")).alias("con"),
    )
    n = F.when(F.col("signal") >= 0, F.col("pro")).otherwise(F.col("con"))
    many = F.least(n, F.lit(CORROBORATION_CAP))
    boost = F.when(many > 1, 1 + CORROBORATION_GAIN * F.log2(many)).otherwise(1.0)
    prob = (clamped(F.col("signal") * boost, -1.0, 1.0) + 1) / 2
    return sums.select("entity", prob.alias("prob"), n.alias("n_sources"), tier(n).alias("tier"))


def consolidate(evidence: DataFrame, keys: DataFrame) -> DataFrame:
    """Evidence attached to canonical entities, first row of each (entity, source, polarity).

    ``keys`` maps a name to ``canonical``.
    """
    joined = evidence.join(keys.select(F.col("name").alias("entity"), "canonical"), "entity").drop("entity").withColumnRenamed("canonical", "entity")
    return first_wins(joined, ["entity", "source", "supports"], "ord")


def annotated(evidence: DataFrame, paths: DataFrame) -> DataFrame:
    """Consolidated evidence with the chain that ties its entity to the root written before
    the reasoning of what supports, and ``routed`` where there is one.

    ``evidence``: entity, supports, reasoning; ``paths``: node, path (from the node to the root).
    """
    near = paths.filter(F.size("path") > 1).select(F.col("node").alias("entity"), F.array_join("path", "->").alias("_chain"))
    joined = evidence.join(near, "entity", "left")
    routed = F.col("supports") & F.col("_chain").isNotNull()
    line = F.concat(F.lit("Evidence through affiliations "), "_chain", F.lit(".\n"))
    return joined.withColumns({"routed": routed, "reasoning": F.when(routed, F.concat(line, F.coalesce("reasoning", F.lit("")))).otherwise(F.col("reasoning"))}).drop("_chain")


def gated(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entities with ``prob``, ``leaf`` (some probability) and ``hypothesis`` (one half at
    least), all by their evidence; without any they have 0, false and null."""
    found = assess(evidence).select("entity", F.col("prob").alias("_p"))
    joined = entities.join(found, "entity", "left")
    return joined.withColumns({"prob": F.coalesce("_p", F.lit(0.0)), "leaf": F.coalesce(F.col("_p") > 0, F.lit(False)), "hypothesis": F.col("_p") >= 0.5}).drop("_p")


def verdict(items: DataFrame) -> DataFrame:
    """One row: support and refutation by confidence, distinct sources, tempered net and its name.

    ``items``: stance (SUPPORTS, REFUTES, NEUTRAL), confidence, source.
    """
    total = lambda s: F.coalesce(F.sum(F.when(F.col("stance") == s, F.col("confidence"))), F.lit(0.0))
    sources = lambda s: F.countDistinct(F.when(F.col("stance") == s, F.col("source")))
    sums = items.agg(total("SUPPORTS").alias("pro"), total("REFUTES").alias("con"), sources("SUPPORTS").alias("pro_sources"), sources("REFUTES").alias("con_sources"), F.count_if(F.col("stance") == "NEUTRAL").alias("neutral"))
    both = F.col("pro") + F.col("con")
    net = F.when(both > 0, (F.col("pro") - F.col("con")) / both).otherwise(0.0)
    winning = F.when(net >= 0, F.col("pro_sources")).otherwise(F.col("con_sources"))
    tempered = net * F.least(F.lit(1.0), winning / F.lit(float(SOURCES_FOR_FULL)))
    named = sums.withColumn("net", net).withColumn("tempered", tempered)
    return named.withColumn("verdict", ladder(F.col("tempered"), VERDICT_LADDER, VERDICT_LAST))


def top_items(items: DataFrame, n: int = 10) -> DataFrame:
    """The surest items of each stance."""
    return top_rows(items, ["stance"], n, F.desc("confidence"), "item")


def causal_edges(claims: DataFrame) -> DataFrame:
    """Claims of (cause, effect) summed: ``weight`` = strength x confidence x attestation, texts at most 3.

    ``claims``: cause, effect, strength, confidence, url, claim_text, ord; self-pairs go.
    With ``hedging`` or ``direction``, their distinct values are kept as well.
    """
    rows = claims.filter("cause is not null and effect is not null and cause <> effect")
    more = [F.array_sort(F.collect_set(F.nullif(c, F.lit("")))).alias(c) for c in ("hedging", "direction") if c in claims.columns]
    sums = rows.groupBy("cause", "effect").agg(
        *more,
        F.max("strength").alias("s"),
        F.max("confidence").alias("c"),
        F.countDistinct("url").alias("n_urls"),
        F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct("ord", "claim_text"))), lambda x: x["claim_text"])), 1, 3).alias("texts"),
    )
    attested = F.least(F.lit(2.0), 1 + 0.3 * F.greatest(F.col("n_urls") - 1, F.lit(0)))
    return sums.withColumn("weight", F.round(F.col("s") * F.col("c") * attested, 4))


def resolved_claims(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """Claims with cause and effect by canonical name; where either is unknown, or both are
    one, the claim goes.  ``keys``: name (upper case), canonical."""
    return resolved(claims, keys, "cause", "effect")


def claim_items(evidence: DataFrame) -> DataFrame:
    """``entity, supports, ord, claim, sources, tier``: each item with the claim it belongs to.

    ``evidence``: entity, supports, source, strength, confidence, vector, ord.  Within an
    entity and polarity the first ``POOL`` items in order join the first claim whose leader
    (``claim`` is its ord) they are similar to.  A claim's sources are told apart by the
    first item of each; those of one text count once.
    """
    eligible = evidence.filter("confidence > 0 and strength > 0 and source is not null and vector is not null")
    pooled = top_rows(eligible, ["entity", "supports"], POOL, "ord")

    def clustered(group: pd.DataFrame) -> pd.DataFrame:  # at most POOL rows
        group = group.sort_values("ord")
        vectors = np.stack(group["vector"].to_list()).astype(float)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors /= np.where(norms == 0, 1.0, norms)
        alike = vectors @ vectors.T
        leader = np.empty(len(group), int)
        leaders: list[int] = []
        for i in range(len(group)):
            leader[i] = next((k for k in leaders if alike[i, k] >= CLAIM_SIMILARITY), i)
            if leader[i] == i:
                leaders.append(i)
        sources, n = group["source"].to_numpy(), np.empty(len(group), int)
        for k in leaders:
            inside = np.flatnonzero(leader == k)
            firsts = sorted({s: i for i, s in reversed(list(zip(inside, sources[inside], strict=True)))}.values())
            name = {i: i for i in firsts}
            for i in firsts:
                for j in firsts:
                    if i < j and alike[i, j] >= SYNDICATION_SIMILARITY and name[i] != name[j]:
                        name = {x: name[i] if y == name[j] else y for x, y in name.items()}
            n[inside] = len(set(name.values()))
        ords = group["ord"].to_numpy()
        return pd.DataFrame({"entity": group["entity"], "supports": group["supports"], "ord": ords, "claim": ords[leader], "sources": n})

    found = pooled.groupBy("entity", "supports").applyInPandas(clustered, f"entity {dict(evidence.dtypes)['entity']}, supports boolean, ord long, claim long, sources long")
    return found.withColumn("tier", tier(F.col("sources")))


def corroborated_claims(evidence: DataFrame) -> DataFrame:
    """``entity, supports, sources, claim, corroborated_claims, tier``: a row for each entity.

    ``supports`` is the side of the signed evidence, with or without sources, and what is
    told is about that side.  ``claim`` is the first of the claims of most sources;
    corroborated ones have two at least.  Where only the other side has items, one source
    counts and there is no claim; without any items there is no source and no side.
    """
    sign = F.when(F.col("supports"), 1.0).otherwise(-1.0)
    counts = F.coalesce((F.col("confidence") > 0) & (F.col("strength") > 0), F.lit(False))
    sides = evidence.groupBy("entity").agg((F.coalesce(F.sum(F.when(counts, sign * F.col("strength") * F.col("confidence"))), F.lit(0.0)) >= 0).alias("side"))
    items = claim_items(evidence).join(sides, "entity")
    own = F.col("supports") == F.col("side")
    sums = items.groupBy("entity").agg(
        F.first("side").alias("supports"),
        F.max(F.when(own, F.col("sources"))).alias("sources"),
        F.min_by(F.when(own, F.col("claim")), F.when(own, F.struct(-F.col("sources"), "claim"))).alias("claim"),
        F.countDistinct(F.when(own & (F.col("sources") >= 2), F.col("claim"))).alias("corroborated_claims"),
        F.lit(1).cast("long").alias("least"),
    )
    every = sides.select("entity").join(sums, "entity", "left")
    found = F.coalesce("sources", "least", F.lit(0)).cast("long")
    return every.select("entity", "supports", found.alias("sources"), "claim", F.coalesce("corroborated_claims", F.lit(0)).alias("corroborated_claims"), tier(found).alias("tier"))
