"""Patterns from state against the batch form."""

import random

import pytest
from casegraph.operators import cep
from casegraph.streaming import chains
from pyspark.sql import functions as F

SCHEMA = "event long, day date, event_type string, text string, participants array<string>"
PAIR = {"name": "pair", "windowDays": 3, "steps": [{"types": ["signup"]}, {"types": ["purchase"]}]}
TRIPLE = {"name": "triple", "windowDays": 4, "severity": "high", "steps": [{"types": ["signup"]}, {"types": ["view", "click"]}, {"keywords": ["buy"]}]}


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", chains.STORE)
    yield
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def make(spark, rows):
    plain = "event long, day string, event_type string, text string, participants array<string>"
    return spark.createDataFrame(rows, plain).withColumn("day", F.col("day").cast("date"))


def sample(n, days, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["signup", "view", "click", "purchase"])
        day = f"2024-01-{1 + rng.randrange(days):02d}" if rng.random() < 0.97 else None
        rows.append((i, day, kind, "they buy it" if kind == "purchase" else "", rng.sample(["A", "B", "C", "D", "E", None], rng.randrange(3))))
    return rows


def run(spark, rule, tmp_path, batches, late, name="out"):
    """Chains after each call of the stream over one more folder of files."""
    paths = {k: str(tmp_path / f"{name}-{k}") for k in ("in", "out", "state")}
    for rows in batches:
        make(spark, rows).coalesce(1).write.mode("append").parquet(paths["in"])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(paths["in"])
        q = chains.match_stream(stream, rule, late).writeStream.format("parquet").option("path", paths["out"]).option("checkpointLocation", paths["state"]).trigger(availableNow=True).start()
        q.awaitTermination()
    return keyed(spark.read.parquet(paths["out"])), q


def keyed(df):
    return sorted((tuple(r.chain), str(r.first), str(r.last), r.days, tuple(r.bridges), r.rule, r.severity) for r in df.select("chain", "first", "last", "days", "bridges", "rule", "severity").collect())


@pytest.mark.parametrize(("rule", "cuts"), [(PAIR, 1), (PAIR, 4), (TRIPLE, 3)])
def test_stream_equals_batch_in_any_batching(spark, store, tmp_path, rule, cuts):
    rows = sample(60, 12)
    want = keyed(cep.match_rule(make(spark, rows), rule))
    assert want
    random.Random(cuts).shuffle(rows)
    got, _ = run(spark, rule, tmp_path, [rows[i::cuts] for i in range(cuts)], "30 days")
    assert got == want


def test_late_events_and_the_bound_of_the_state(spark, store, tmp_path):
    first = [(1, "2024-01-01", "signup", "", ["A"]), (2, "2024-01-02", "signup", "", ["B"])]
    far = [(9, "2024-02-01", "signup", "", ["C"])]
    late = [(3, "2024-01-03", "purchase", "", ["A"]), (4, "2024-01-31", "purchase", "", ["C"]), (5, "2024-02-02", "purchase", "", ["C"]), (5, "2024-02-02", "purchase", "", ["C"])]
    got, q = run(spark, PAIR, tmp_path, [first], "1 day")
    open_rows = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert not got and open_rows
    got, q = run(spark, PAIR, tmp_path, [far], "1 day")
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < open_rows  # A and B wait for nothing any more
    got, q = run(spark, PAIR, tmp_path, [late], "1 day")
    assert [x[0] for x in got] == [(9, 5)]  # 3 comes too late, 4 is before what it would follow


def test_stories_go_out_once_over_restarts(spark, store, tmp_path):
    batches = [
        [(1, "2024-01-01", "signup", "", ["A", "B"]), (2, "2024-01-02", "signup", "", ["A"])],
        [(3, "2024-01-03", "purchase", "", ["A", "B"])],
        [(3, "2024-01-03", "purchase", "", ["A", "B"]), (4, "2024-01-03", "signup", "", ["B"]), (5, "2024-01-04", "purchase", "", ["B"])],
    ]
    for rows in batches:
        make(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        chains.watch(stream, [PAIR], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.final: (list(r.chain), list(r.bridges)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {3: ([1, 3], ["A", "B"]), 5: ([4, 5], ["B"])}


def test_steps_are_joins_of_days_over_a_change_of_clocks(spark, store, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # three days of 73 hours, then one too many
        got, q = run(spark, PAIR, tmp_path, [[(1, "2024-11-01", "signup", "", ["A"]), (2, "2024-11-04", "purchase", "", ["A"]), (3, "2024-11-05", "purchase", "", ["A"])]], "30 days")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [x[0] for x in got] == [(1, 2)]
    assert q.lastProgress["stateOperators"][0]["operatorName"] == "symmetricHashJoin"  # no Python worker has the keys one by one
