"""Streams against their batch twins."""

from pyspark.sql import functions as F

from casegraph.operators import cep
from casegraph.sources.ingest import split_text
from casegraph.streaming import monitor

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_window_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = monitor.windowed(stream, "1 day", "60 days").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r.day, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("windows")) == key(monitor.windowed(batch, "1 day", None))


def test_alerts_go_out_once(spark, tmp_path):
    rows = [("r", 1, "a"), ("r", 1, "b"), ("r", 2, "c"), ("s", 1, "d")]
    schema = "rule string, final long, what string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = monitor.alerts_once(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        out.awaitTermination()
        spark.createDataFrame(rows[:2], schema).write.mode("append").parquet(str(tmp_path / "in"))
    got = [(r.rule, r.final) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("r", 1), ("r", 2), ("s", 1)]


def test_daily_run_completes_a_stored_prefix(spark, tmp_path):
    schema = "event long, day date, event_type string, text string, participants array<string>"
    make = lambda rows: spark.createDataFrame(rows, "event long, day string, event_type string, text string, participants array<string>").withColumn("day", F.col("day").cast("date"))
    stored = make([(1, "2024-01-01", "sanctions", "", ["A"])])
    rule = {"name": "r one", "windowDays": 30, "steps": [{"types": ["sanctions"]}, {"types": ["financial_crime"]}]}
    paths = {k: str(tmp_path / k) for k in ("in", "fired", "out", "state")}
    make([(2, "2024-01-10", "financial_crime", "", ["A"])]).write.parquet(paths["in"])
    for _ in range(2):
        stream = spark.readStream.schema(schema).parquet(paths["in"])
        monitor.run_daily(stream, lambda: stored, paths["fired"], paths["out"], [rule], paths["state"]).awaitTermination()
        make([(2, "2024-01-10", "financial_crime", "", ["A"])]).write.mode("append").parquet(paths["in"])
    assert [(r.rule, r.final) for r in spark.read.parquet(paths["fired"]).collect()] == [("r one", 2)]
    assert cep.valid_rule(rule)


def test_watchlist(spark):
    w = spark.createDataFrame([("acme",), ("Beta",)], "subject string")
    assert {r[0] for r in monitor.watchlist(w, [" gamma "], ["beta"]).collect()} == {"ACME", "GAMMA"}


def test_split_text():
    assert split_text(None) == [] and split_text("") == [""] and split_text(" a\n\n") == [" a\n\n"]
    assert split_text("aa\nbb\ncc", 6) == ["aa\nbb", "cc"]
    assert split_text("\n\naaaa\n\nb\nc", 6) == ["aaaa\n", "b\nc"]
    assert split_text("abcdefgh", 3) == ["abc", "def", "gh"]
    assert split_text("a\nbcdefgh\ni\nj", 3) == ["a", "bcd", "efg", "h", "i\nj"]
    text = "\n".join(f"line {i} {'x' * (i * 7 % 50)}" for i in range(300))
    assert all(len(x) <= 120 for x in split_text(text, 120)) and "\n".join(split_text(text, 120)) == text
