"""Scores, weights and verbal ladders as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base weight of each edge type, and the weight of structural edges.
EDGE_BASES = {"affiliation": 1.0, "claimed_caused_by": 1.0, "event_participation": 0.5, "event_followed_by": 0.15, "event_coincident": 0.15}
DEFAULT_BASE, EVIDENCE_WEIGHT, LEAST_WEIGHT, RUN_BUMP = 0.5, 0.3, 0.05, 0.25

# Verbal ladders, highest first.
CONFIDENCE_LADDER = [(0.93, "Almost certain"), (0.80, "Highly likely"), (0.65, "Likely"), (0.45, "Even chance"), (0.25, "Unlikely"), (0.07, "Very unlikely")]
CONFIDENCE_LAST = "Almost no chance"
VERDICT_LADDER = [(0.80, "Almost Certainly"), (0.55, "Highly Likely"), (0.25, "Likely"), (-0.25, "Roughly Even Chance"), (-0.55, "Unlikely"), (-0.80, "Highly Unlikely")]
VERDICT_LAST = "Almost Certainly Not"

RELEVANCE_DECAY, FAR_HOPS = 0.7, 2


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ladder(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the highest step that x reaches."""
    out = F.lit(last)
    for least, name in reversed(steps):
        out = F.when(x >= least, F.lit(name)).otherwise(out)
    return out


def relevance(hops: Column) -> Column:
    return F.pow(F.lit(RELEVANCE_DECAY), F.coalesce(hops, F.lit(FAR_HOPS)).cast("double"))


def given_prob(prob: Column) -> Column:
    """A probability, one half if it is missing or 0."""
    return F.coalesce(F.nullif(prob, F.lit(0.0)), F.lit(0.5))


def edge_weight(edge_type: Column, p: Column, q: Column, n_runs: Column) -> Column:
    """Type base x geometric mean of the ends' probabilities x attestation."""
    base = F.lit(DEFAULT_BASE)
    for name, value in EDGE_BASES.items():
        base = F.when(edge_type == name, F.lit(value)).otherwise(base)
    runs = 1 + RUN_BUMP * F.greatest(n_runs - 1, F.lit(0))
    weight = F.greatest(F.lit(LEAST_WEIGHT), base * F.sqrt(given_prob(p) * given_prob(q)) * runs)
    return F.when(edge_type == "evidence", F.lit(EVIDENCE_WEIGHT)).otherwise(weight)


def normal_weight(weight: Column, most: float = 5.0) -> Column:
    return clamped(weight / F.lit(most), 0.0, 1.0)


def event_strength(confidence: Column) -> Column:
    return F.coalesce(F.when(confidence.isNotNull(), clamped(confidence.try_cast("double"), 0.1, 1.0)), F.lit(0.7))


def tier(n_sources: Column) -> Column:
    return F.when(n_sources >= 3, "strong").when(n_sources == 2, "moderate").otherwise("weak")
