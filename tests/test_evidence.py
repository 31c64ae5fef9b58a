"""Evidence probability, verdicts, pairs and causal weights against goldens."""

import pytest
from pyspark.sql import functions as F

from casegraph.operators import evidence as E
from casegraph.operators import pairs as R

CASES = {
    "full": ([(1.0, 1.0, True, "a")], 1.0),
    "half": ([(0.5, 1.0, True, "a")], 0.75),
    "none": ([(0.0, 1.0, True, "a")], 0.5),
    "balanced": ([(1.0, 1.0, True, "a"), (1.0, 1.0, False, "b")], 0.5),
    "against": ([(1.0, 1.0, False, "a")], 0.0),
    "weighted": ([(0.8, 0.7, True, "a")], 0.9),
    "no strength": ([(None, 1.0, True, "a")], 0.5),
    "no source": ([(0.5, 1.0, True, None)] * 3, 0.75),
    "one source": ([(0.4, 1.0, True, "a")] * 2, 0.70),
    "two sources": ([(0.4, 1.0, True, "a"), (0.4, 1.0, True, "b")], 0.77),
    "four sources": ([(0.4, 1.0, True, s) for s in "abcd"], 0.84),
}


def test_probability(spark):
    rows = [(name, *r) for name, (evidence, _) in CASES.items() for r in evidence] + [("unsure", 1.0, 0.0, True, "a")]
    df = spark.createDataFrame(rows, "entity string, strength double, confidence double, supports boolean, source string")
    got = {r.entity: r.prob for r in E.assess(df).collect()}
    assert "unsure" not in got
    assert got == pytest.approx({k: v for k, (_, v) in CASES.items()})


def test_causal_weight(spark):
    rows = [("a", "b", 0.8, 0.9, "u1", "t", 1)] + [("c", "d", 0.8, 0.9, f"u{i}", f"t{i}", i) for i in range(4)] + [("e", "f", 0.5, 1.0, f"u{i}", "t", i) for i in range(10)] + [("g", "g", 1.0, 1.0, "u", "t", 1)]
    df = spark.createDataFrame(rows, "cause string, effect string, strength double, confidence double, url string, claim_text string, ord long")
    got = {r.cause: (r.weight, len(r.texts)) for r in E.causal_edges(df).collect()}
    assert got == {"a": (0.72, 1), "c": (1.368, 3), "e": (1.0, 1)}


def test_pairs(spark):
    rows = [("a", "b", 1, "affiliation", 0.5, 1.0, 1), ("b", "a", 2, "partnership", 0.5, 1.0, 2), ("b", "c", 1, "financial", 0.0, 1.0, 3), ("c", "b", 1, "financial", 0.2, 1.0, 4), ("d", "d", 1, "affiliation", 1.0, 1.0, 5)]
    df = spark.createDataFrame(rows, "a string, b string, chunk long, rel_type string, strength double, confidence double, ord long")
    got = {(r.src, r.dst): (r.source_count, r.types, round(r.weight, 3)) for r in R.pair_edges(df).collect()}
    assert got == {("a", "b"): (2, ["affiliation", "partnership"], 0.5), ("b", "c"): (1, ["financial"], 1.0), ("c", "b"): (1, ["financial"], 0.2)}


def test_corroborated_claims(spark):
    v = {"x": [1.0, 0.0], "y": [0.85, 0.5], "z": [0.0, 1.0]}
    rows = [(1, True, s, 1.0, 1.0, v["x"], i) for i, s in enumerate("abc")] + [(2, True, "a", 1.0, 1.0, v["x"], 1), (2, True, "b", 1.0, 1.0, v["y"], 2), (3, True, "a", 1.0, 1.0, v["x"], 1), (3, True, "b", 1.0, 1.0, v["z"], 2)]
    df = spark.createDataFrame(rows, "entity long, supports boolean, source string, strength double, confidence double, vector array<double>, ord long")
    got = {r.entity: (r.corroborated_claims, r.sources, r.tier) for r in E.corroborated_claims(df).collect()}
    assert got == {1: (0, 1, "weak"), 2: (1, 2, "moderate"), 3: (0, 1, "weak")}
    against = [(4, False, s, 1.0, 1.0, v["x"], i) for i, s in enumerate("ab")] + [(4, True, "c", 0.1, 1.0, v["z"], 9), (4, False, "b", 1.0, 1.0, v["y"], 5)]
    more = spark.createDataFrame(against, df.schema)
    assert [(r.supports, r.claim, r.sources) for r in E.corroborated_claims(more).collect()] == [(False, 0, 1)]  # one representative a source
    items = {r.ord: (r.claim, r.sources) for r in E.claim_items(more).collect()}
    assert items == {0: (0, 1), 1: (0, 1), 5: (0, 1), 9: (9, 1)}
    early = spark.createDataFrame([(5, True, f"s{i}", 0.1, 1.0, v["x"] if i < 300 else v["z"], i) for i in range(301)] + [(5, True, "late", 1.0, 1.0, v["z"], 999)], df.schema)
    assert {r.claim for r in E.claim_items(early).collect()} == {0}  # the first in order, not the strongest


def test_alias_keys(spark):
    own = spark.createDataFrame([("A", ["x", "y"], 1), ("B", ["y"], 2)], "canonical string, names array<string>, ord long")
    groups = spark.createDataFrame([("C", ["Y", "z"])], "canonical string, names array<string>")
    assert {tuple(r) for r in R.alias_keys(own, groups).collect()} == {("X", "A"), ("Y", "B"), ("Z", "C")}
    edges = spark.createDataFrame([("x", "z"), ("x", "nobody"), ("z", "Z")], "a string, b string")
    assert [tuple(r) for r in R.resolved(edges, R.alias_keys(own, groups)).collect()] == [("A", "C")]


def test_empty_evidence(spark):
    df = spark.createDataFrame([], "entity string, strength double, confidence double, supports boolean, source string")
    assert E.assess(df).count() == 0
    assert E.verdict(df.select(F.lit("SUPPORTS").alias("stance"), "confidence", "source")).first().verdict == "Roughly Even Chance"


def test_every_entity_has_its_corroboration(spark):
    """As much as is known: another side alone, nothing that counts, both sides."""
    rows = [
        (1, True, None, 1.0, 1.0, [1.0, 0.0], 0), (1, False, "s", 0.5, 0.5, [1.0, 0.0], 1),
        (2, True, "s", 0.0, 1.0, [1.0, 0.0], 0), (2, True, "s", None, None, [1.0, 0.0], 1),
        (3, False, "s", 1.0, 1.0, [1.0, 0.0], 0), (3, False, "t", 1.0, 1.0, [0.9, 0.3], 1), (3, True, "u", 0.1, 0.1, [0.0, 1.0], 2),
    ]
    df = spark.createDataFrame(rows, "entity long, supports boolean, source string, strength double, confidence double, vector array<double>, ord long")
    got = {r.entity: (r.supports, r.sources, r.claim, r.corroborated_claims, r.tier) for r in E.corroborated_claims(df).collect()}
    assert got == {1: (True, 1, None, 0, "weak"), 2: (None, 0, None, 0, "weak"), 3: (False, 2, 0, 1, "moderate")}
