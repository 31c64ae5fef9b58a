"""Connectors, rules and stores in versions."""

import json

from pyspark.sql import functions as F

from casegraph.operators.merge import vector_groups
from casegraph.sources import connectors, ingest, rules, stores


def test_connectors_tolerate_what_fails(spark):
    def fetch(q):
        if q == "bad":
            raise TimeoutError("late")
        return "no json" if q == "odd" else json.dumps({"items": [{"title": "T " + q, "link": "https://www.a.example/x", "snippet": "s"}, {"title": "", "snippet": ""}]})

    got = connectors.asked(spark.createDataFrame([("good",), ("bad",), ("odd",)], "query string"), fetch)
    assert {r.query: r.error for r in got.collect()} == {"good": None, "bad": "TimeoutError: late", "odd": None}
    assert [(r.query, r.title, r.publisher, r.text) for r in connectors.web_search(got).collect()] == [("good", "T good", "a.example", "s")]


def test_rules(spark):
    text = "On 2024-05-10 the Acme Group met. John Smith left. Cost Rise led to Market Fall today! North Port closed because of Heavy Storm."
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    one = df.select(rules.entities(F.col("t")).alias("e"), rules.dated_events(F.col("t")).alias("d"), rules.causal_claims(F.col("t")).alias("c")).collect()
    assert one[0].e == ["Acme Group", "John Smith", "Cost Rise", "Market Fall", "North Port", "Heavy Storm"]
    assert [(x.day, x.names) for x in one[0].d] == [("2024-05-10", ["Acme Group"])]
    assert [(x.cause, x.effect) for x in one[0].c] == [("Cost Rise", "Market Fall"), ("Heavy Storm", "North Port")]
    assert all(r.e == r.d == r.c == [] for r in one[1:])
    v = {r.t: r.vector for r in rules.with_vectors(df, rules.hashed_vectors, "t").collect()}
    assert v[None] is None and len(v[text]) == 64 and abs(sum(x * x for x in v[text]) - 1) < 1e-9


def test_collections_in_versions(spark, tmp_path):
    path, schema = str(tmp_path / "store"), {"a": "id long", "b": "x string"}
    assert stores.load_collections(spark, path, schema)["a"].count() == 0
    make = lambda n: {"a": spark.range(n), "b": spark.createDataFrame([("v",)], "x string")}
    assert stores.save_collections(make(2), path) == 1 and stores.save_collections(make(3), path) == 2
    spark.range(9).write.parquet(f"{path}/version=3/a")  # a writer that did not come to its end
    got = stores.load_collections(spark, path, schema)
    assert (got["a"].count(), got["b"].first().x) == (3, "v")
    audit = str(tmp_path / "audit")
    for _ in range(2):
        stores.append_csv(spark.createDataFrame([("n", "t")], "node string, text string"), audit)
    assert spark.read.option("header", True).csv(audit).count() == 2
    record = spark.createDataFrame([("s", '{"k": {"x": 1}}')], "session_id string, record string")
    assert [r.value for r in stores.field_of(record, "s", "k.x").collect()] == ["1"] and stores.field_of(record, "t", "k").count() == 0


def test_batches_and_groups(spark):
    one = spark.createDataFrame([("a", "x" * 7000), ("b", " ")], "title string, text string")
    two = spark.createDataFrame([("c", "short", "u")], "title string, text string, url string")
    assert sorted((r.title, r.part) for r in ingest.ingested([one, two]).collect()) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    rows = [(f"n{i:03}", [float(i // 50) * 10, float(i % 50) / 1000]) for i in range(200)] + [(f"none{i}", None) for i in range(90)]
    rows += [(f"same{i:03}", [500.0, 500.0]) for i in range(150)] + [("n000", None), ("n001", [0.0, 0.001])]
    df = spark.createDataFrame(rows, "name string, vector array<double>")
    for task_rows in (20_000, 60):
        groups = {}
        for r in vector_groups(df, task_rows=task_rows).collect():
            groups.setdefault(r.group, set()).add(r.name)
        assert max(map(len, groups.values())) <= 40 and sum(map(len, groups.values())) == 440
        kinds = lambda names: {("none" if x.startswith("none") else "same" if x.startswith("same") else int(x[1:]) // 50) for x in names}
        mixed = [g for g in groups.values() if len(kinds(g)) > 1]
        assert not mixed if task_rows > 400 else all("none" not in kinds(g) for g in mixed)


def test_a_payload_is_cut_into_maps(spark):
    """A run's payload is in maps of bounded size that hold each body once."""
    rows = spark.range(500).selectExpr("id as ord", "if(id % 5 = 0, null, 'r') as run", "'p' as publisher", "'t' as title", "if(id % 7 = 0, null, concat('body', id)) as text", "'403' as error")
    maps = ingest.combined_payload(rows, "X", 40).collect()
    assert max(len(r.articles) for r in maps) < 100 and len({(r.run, r.part) for r in maps}) == len(maps)
    held = [(r.run, k, v) for r in maps for k, v in r.articles.items()]
    assert sorted(held, key=str) == sorted(((None if i % 5 == 0 else "r", f"p__X__{i}", f"body{i}") for i in range(500) if i % 7), key=str)


def test_sessions_of_odd_rows(spark):
    kind = "session_id string, ord long, changed boolean"
    store = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 3, False), (None, 4, False)], kind)
    other = spark.createDataFrame([("b", 8, True), ("b", 9, None), ("c", 5, True), ("c", 6, False), (None, 7, True)], kind)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(stores.updated(store, other)) == rows(spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 9, None), (None, 4, False)], kind))
    assert rows(stores.added(store, other)) == rows(store.union(spark.createDataFrame([("c", 6, False), (None, 7, True)], kind)))
    assert rows(stores.added(store.limit(0), other)) == rows(spark.createDataFrame([("b", 9, None), ("c", 6, False), (None, 7, True)], kind))
