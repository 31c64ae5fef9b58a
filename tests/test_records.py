"""Nested records, cascades, roots, networks and the day's loop against goldens."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from casegraph.functions import labels, records
from casegraph.operators import cascade, network, roots
from casegraph.operators.merge import round_robin
from casegraph.operators.resolve import match_companies, nearest, similar_aliases
from casegraph.sources import ingest, stores
from casegraph.streaming import monitor

RECORD = {"a": {"b": {"c": 1, "none": None}, "list": []}, "text": "x" * 30, "query": "q" * 120, "response_text": "raw", "items": [{"k": "v"}, ""], "e": ""}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "r string").select(column(F.col("r")).alias("x")).first().x


def test_nested_records(spark):
    text = json.dumps(RECORD)
    assert one(spark, records.flattened, text) == {"a.b.c": "1", "text": "x" * 30, "query": "q" * 120, "response_text": "raw", "items": '[{"k": "v"}, ""]'}
    assert one(spark, lambda r: records.found_value(r, "k"), text) == "v" and one(spark, lambda r: records.found_value(r, "zzz"), text) is None
    assert json.loads(one(spark, records.without_empty, text))["a"] == {"b": {"c": 1}} and json.loads(one(spark, records.without_empty, text))["items"] == [{"k": "v"}]
    assert json.loads(one(spark, lambda r: records.without_long_texts(r, 29), text)).keys() == {"a", "items", "e"}
    assert "text" in json.loads(one(spark, records.preprocessed, text.replace(", ", ",\n")))
    for bad in (None, "{", ""):
        assert one(spark, records.flattened, bad) is None and one(spark, records.is_json, bad) is False


@pytest.mark.parametrize("most", [60, 120, 100_000])
def test_json_pieces_put_together_are_the_record(most):
    record = {"id": 7, "turns": [{"role": "user", "text": "w" * (i % 50)} for i in range(12)], "deep": {"x": {"y": {"z": list(range(5))}}}}

    def leaves(x, path=()):
        return {p for k, v in x.items() for p in leaves(v, (*path, k))} if isinstance(x, dict) and x else {(path, json.dumps(x))}

    pieces = records.json_pieces(record, most)
    assert set().union(*map(leaves, pieces)) == leaves(records._as_objects(record))
    assert len(pieces) == 1 or all(len(json.dumps(p)) <= most + 100 for p in pieces)


def test_claim_texts_and_labels(spark):
    df = spark.createDataFrame([("Evidence through affiliations A->B.\nthe fact", ["a quote", " "]), ("Evidence through affiliations A->B.", None), (None, None)], "r string, q array<string>")
    assert [r[0] for r in df.select(records.claim_text(F.col("r"), F.col("q"))).collect()] == ["the fact a quote", "", ""]
    x = spark.createDataFrame([("2024-02-30", "run_one-two", ["a_b", "c", "d", "e"])], "d string, r string, l array<string>")
    got = x.select(labels.valid_date(F.col("d")), labels.run_name(F.col("r")), labels.title_of_runs(F.col("l")), labels.delta_colour(F.lit(0.3)), labels.level(F.lit(None).cast("double"))).first()
    assert tuple(got) == (False, "Run One Two", "A B, C, D and 1 more", "#15803d", "low")


def test_roots(spark):
    subjects = spark.createDataFrame([("Globalaid",), ("UN",), ("who funds Acme Fund now",), ("nobody",)], "subject string")
    entities = spark.createDataFrame([(1, "GLOBALAID, INC.", ["Globalaid, Inc."], False), (2, "UNITED", ["United"], False), (3, "ACME FUND", ["Acme Fund"], False), (0, "GLOBALAID SCANDAL", ["Globalaid scandal"], True)], "ord long, canonical string, names array<string>, is_event boolean")
    reps = spark.createDataFrame([(1, "Globalaid Group", ["globalaid"])], "ord long, canonical string, names array<string>")
    nodes = spark.createDataFrame([("GLOBALAID GROUP",)], "node string")
    assert {tuple(r) for r in roots.match_roots(subjects, entities, reps, nodes).collect()} == {("Globalaid", "GLOBALAID GROUP"), ("who funds Acme Fund now", "ACME FUND")}
    assert {tuple(r) for r in roots.match_roots(subjects, entities, reps, nodes, False).collect()} == {("Globalaid", "GLOBALAID GROUP")}
    degrees = spark.createDataFrame([("H", 5), ("A", 5), ("B", 1)], "node string, degree long")
    found = roots.roots_or_most_connected(subjects, spark.createDataFrame([("UN", "U")], "subject string, root string"), degrees)
    assert {r.subject: r.root for r in found.collect()}["nobody"] == "A"
    none = roots.roots_or_most_connected(subjects, spark.createDataFrame([], "subject string, root string"), degrees.filter("degree = 1"))
    assert {r.root for r in none.collect()} == {None}


def test_cascade(spark):
    tables = {
        "nodes": spark.createDataFrame([("Daily News",), ("ACME",), ("BETA",)], "node string"),
        "edges": spark.createDataFrame([("ACME", "Daily News"), ("ACME", "BETA")], "src string, dst string"),
        "themes": spark.createDataFrame([(1, ["ACME", "Daily News"]), (2, ["ACME", "BETA"])], "id long, members array<string>"),
        "promoted": spark.createDataFrame([("Daily News",)], "node string"),
    }
    kept, counts = cascade.publisher_cascade(tables, spark.createDataFrame([("daily news",)], "publisher string"))
    assert {tuple(r) for r in counts.collect()} == {("nodes", 3, 2), ("edges", 2, 1), ("themes", 2, 1), ("promoted", 1, 0)}
    assert [tuple(r) for r in kept["edges"].collect()] == [("ACME", "BETA")]


def test_themes_are_inferred_once(spark, monkeypatch):
    from casegraph.plans import graph_queries, record_queries

    def themes(spark, d):
        rows = spark.createDataFrame([("g", "belief", ["a"], 0.5, 0.2), ("g", "tetrahedron", ["a", "b", "c", "d"], 1.0, 0.0)], "graph string, kind string, members array<string>, value double, delta double")
        return rows.mapInPandas(lambda batches: batches, rows.schema)

    monkeypatch.setattr(graph_queries, "gr_themes", themes)
    for query in (record_queries.gr_promoted, record_queries.gr_theme_rows, record_queries.gr_hypotheses):
        assert "MapInPandas" not in query(spark, "")._jdf.queryExecution().toString()


def test_similar_aliases(spark):
    new = spark.createDataFrame([(1, ["US", "TREASURY"], [1.0, 0.0]), (2, ["HAMAS"], [1.0, 0.0]), (3, ["BANK", "OF", "NORTH"], [0.0, 1.0])], "id long, tokens array<string>, vector array<double>")
    saved = spark.createDataFrame([(10, ["US", "DEPARTMENT", "TREASURY"], [0.0, 1.0]), (11, ["HAMAS", "PROXIES"], [1.0, 0.01]), (12, ["BANK", "OF", "SOUTH"], [0.0, 1.0]), (13, ["HAMAS", "IN", "GAZA"], [1.0, 0.0])], "id long, tokens array<string>, vector array<double>")
    assert {tuple(r) for r in similar_aliases(new, saved).collect()} == {(1, 10), (2, 11), (3, 12)}


def test_names_of_equal_tokens_meet_others_as_one(spark, monkeypatch):
    from casegraph.operators import resolve

    schema = "id long, tokens array<string>, vector array<double>"
    rows = [(2 * i, ["BANK", "OF", "NORTH"] if i % 2 else ["NORTH", "RING", "7"], [1.0, float(i % 3)]) for i in range(40)]
    new = spark.createDataFrame(rows, schema)
    saved = spark.createDataFrame([(2 * i + 1, ["NORTH", "BANK"] if i % 2 else ["RING", "NORTH", "8"], [1.0, float(i % 3)]) for i in range(40)], schema)
    asked, subsets = [], resolve.subset_aliases
    monkeypatch.setattr(resolve, "subset_aliases", lambda small, large, *a: asked.append((small.count(), large.count())) or subsets(small, large, *a))
    got = dict(similar_aliases(new, saved).collect())
    assert asked == [(2, 2), (2, 2)]
    first = {0: 1, 2: 5, 1: 9}  # the least of the saved names of these tokens whose vector is the same
    assert got == {2 * i: 3 if i % 2 else first[i % 3] for i in range(40)}


def test_nearest_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    v[17] = v[5]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.query, r.found) for r in nearest(df.filter("vec_id % 20 = 0"), df, 3).collect()}
    want = set()
    for q in range(0, 300, 20):
        sims = unit[q] @ unit.T
        sims[q] = -2
        want |= {(q, int(j)) for j in np.lexsort((np.arange(300), -sims))[:3]}
    assert got == want


def test_likeness_is_of_the_precision_of_the_vectors(spark):
    """Near 0.00005 a likeness in double precision is rounded the other way than SQL's over floats."""
    import duckdb
    import numpy as np
    import pandas as pd

    v = np.random.default_rng(4).normal(size=(600, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    rows = nearest(df.filter("vec_id % 20 = 0"), df, 600).collect()
    e = pd.DataFrame({"vec_id": range(600), "embedding": v.tolist()})
    sql = "SELECT q.vec_id, x.vec_id, CAST(list_cosine_similarity(CAST(q.embedding AS FLOAT[]), CAST(x.embedding AS FLOAT[])) AS DOUBLE) FROM e q JOIN e x ON x.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0"
    want = {(a, b): s for a, b, s in duckdb.connect().register("e", e).execute(sql).fetchall()}
    assert {(r.query, r.found): r.sim for r in rows} == want


def test_companies_meet_by_their_rarest_token(spark):
    names = spark.createDataFrame([(1, "Acme Holdings"), (2, "Acme Steel Works Ltd"), (3, "Steel"), (4, "The Group")], "id long, name string")
    register = spark.createDataFrame([("ACME CORP",), ("ACME STEEL INC",), ("STEEL WORKS",)], "title string")
    assert {(r.id, r.title) for r in match_companies(names, register).collect()} == {(1, "ACME CORP"), (2, "ACME STEEL INC")}


def test_turns_are_filled_up(spark):
    members = spark.createDataFrame([("t", 1.0, "a", 0.5), ("u", 0.5, "a", 0.5), ("u", 0.5, "b", 0.4)], "theme string, weight double, node string, score double")
    everyone = spark.createDataFrame([("a", 0.5), ("c", 0.9), ("d", 0.1)], "node string, score double")
    assert [r.node for r in round_robin(members, 4, everyone).orderBy("place").collect()] == ["a", "b", "c", "d"]


def test_sources_and_stores(spark):
    legacy = spark.createDataFrame([("s", 1, "old"), ("s", 2, "new")], "session_id string, ord long, v string")
    assert [r.v for r in stores.migrated(legacy, legacy.limit(0)).collect()] == ["new"]
    assert [r.v for r in stores.migrated(legacy, legacy.filter("ord = 1")).collect()] == ["old"]
    props = spark.createDataFrame([({"b": ["2", None], "a": ["1", " "], "c": []},)], "p map<string,array<string>>")
    assert props.select(ingest.property_text(F.col("p"))).first()[0] == "a: 1\nb: 2"


def test_network_rows(spark):
    found = spark.createDataFrame([("g", "tetrahedron", ["A", "B", "C", "D"], 2.0, 0.0), ("g", "fill_in", ["D", "A"], 0.1, 0.0), *[("g", "belief", [x], p, delta) for x, p, delta in (("A", 0.9, 0.2), ("B", 0.5, 0.0), ("C", 0.5, 0.05), ("D", 0.6, -0.2))]], "graph string, kind string, members array<string>, value double, delta double")
    runs = spark.createDataFrame([("A", "r1"), ("B", "r2")], "node string, run string")
    theme = network.theme_rows(found, runs).first()
    assert (theme.weight, theme.posterior_mean, theme.runs, theme.cross) == (2.0, 0.625, ["r1", "r2"], True)
    up = network.promoted_nodes(found).collect()
    assert [(r.node, r.prior, r.posterior) for r in up] == [("A", 0.7, 0.9)] and "D (posterior=0.60)" in up[0].reason
    pair = network.hypothesis_rows(found, runs).first()
    assert (pair.members, pair.joint, pair.cross) == (["A", "D"], 0.54, False) and "0.54" in pair.rationale


def test_day_intake_tolerates_a_failing_subject(spark):
    def fetch(subject):
        if subject == "bad":
            raise OSError("no network")
        return [{"title": subject}]

    nodes, _, failed = monitor.day_intake(["a", "bad", "b"], fetch, lambda found: (spark.createDataFrame([(x["title"],) for x in found], "node string"), None))
    assert {r.node for r in nodes.collect()} == {"a", "b"} and failed == ["bad"]


def test_days_loop(spark):
    none = []
    nodes = spark.createDataFrame([("EV-KNOWN", True, ["2024-01-20"], "financial_crime", "", ["acme"], "0.8"), ("EV-OTHER", True, ["2024-01-20"], "financial_crime", "", ["stranger"], "0.8"), ("ACME", False, none, "", "", none, None)], "node string, is_event boolean, date array<string>, event_type string, description string, participants array<string>, strength string")
    edges = spark.createDataFrame([("EV-KNOWN", "Beta Ltd", "event_participation")], "src string, dst string, type string")
    aliases = spark.createDataFrame([("ACME", "ACME"), ("BETA LTD", "BETA")], "alias string, canonical string")
    stored = spark.createDataFrame([("E1", "2024-01-01", "sanctions", "", ["ACME"])], "event string, day string, event_type string, text string, participants array<string>").withColumn("day", F.col("day").cast("date"))
    store = spark.createDataFrame([("ACME", "BETA", 1.0), ("BETA", "GAMMA", 1.0)], "src string, dst string, weight double")
    probs = spark.createDataFrame([("ACME", 0.5)], "node string, prob double")
    rules = [{"name": "r", "windowDays": 30, "steps": [{"types": ["sanctions"]}, {"types": ["financial_crime"]}]}]
    fired = spark.createDataFrame([], "rule string, final string, day date")
    run = lambda f, today: monitor.run_once(nodes, edges, aliases=aliases, stored=stored, store_edges=store, store_nodes=probs, fired=f, watched=["ACME"], rules=rules, today=today)
    out = run(fired, "2024-01-21")
    assert [r.final for r in out["patterns"].collect()] == ["EV-KNOWN"] and out["seen"].count() == 0
    assert [(r.event, r.watched) for r in out["digest"].collect()] == [("EV-KNOWN", True)]
    assert {r.node for r in out["impact"].collect()} == {"GAMMA"}
    again = run(out["fired"], "2024-01-22")
    assert again["patterns"].count() == 0 and [r.final for r in again["seen"].collect()] == ["EV-KNOWN"]
    assert run(fired, "2024-06-01")["patterns"].count() == 0  # too long ago


def test_quoted_texts_of_any_length(spark):
    texts = {1: "the quick brown fox jumps over the lazy dog today", 2: "xquick brown foxes", 3: "nothing of it", 4: None, 5: "", 6: "brown"}
    items = {1: "quick brown fox", 2: "fox jumps over the lazy dog", 3: "brown", 4: "quick brown", 5: "the quick brown fox jumps over the lazy dog today and more", 6: "jumps over the lazy"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from casegraph.operators.resolve import quoted_texts

    got = {r.doc_id: r["items"] for r in quoted_texts(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == {k: v for k, x in texts.items() if (v := [i for i, y in items.items() if x and y in x])}


def test_requests_queries_and_turns(spark):
    from casegraph.functions.text import query_terms
    from casegraph.operators.predicates import request_fault
    from casegraph.operators.resolve import reranked

    q = spark.createDataFrame([("links between the Acme Group and its activities in a far away land of ours today",), ("of the",), ("",), (None,)], "q string")
    assert [r[0] for r in q.select(query_terms(F.col("q"))).collect()] == ["Acme Group its far away land", "of the", "", None]
    r = spark.createDataFrame([("s", "t", 0.5), ("", "t", 0.5), ("s", None, 0.5), ("s", "t", 1.5), ("s", "t", None)], "s string, t string, x double")
    assert [x[0] for x in r.select(request_fault(F.col("s"), F.col("t"), F.col("x"))).collect()] == [None, "no session", "no text", "threshold out of range", None]
    turns = spark.createDataFrame([(1, 1, "u1", "a", [1.0, 0.0]), (2, 1, "u1", "b", [0.0, 1.0]), (2, 2, "u2", "c", [0.9, 0.1]), (2, 3, None, "d", [1.0, 0.0]), (1, 2, "u3", "e", [0.0, 1.0])], "turn int, ord int, url string, title string, vector array<double>")
    assert [(x.url, x.title) for x in reranked(turns, [1.0, 0.0], 2).collect()] == [("u1", "a"), ("u2", "c")]


def test_companies_of_equal_tokens_meet_as_one(spark):
    """Names and titles that repeat, with tokens in any order, cost one meeting and get the least title."""
    names = spark.createDataFrame([(i, ("Acme Steel", "STEEL, ACME", "Acme")[i % 3]) for i in range(30)], "id long, name string")
    register = spark.createDataFrame([("Steel Acme",), ("ACME Steel",), ("Acme Steel Works",), ("Acme",)], "title string")
    found = match_companies(names, register)
    assert {(r.id, r.title) for r in found.collect()} == {(i, "Acme" if i % 3 == 2 else "ACME Steel") for i in range(30)}
    sets = [x for x in found.inputFiles() if spark.read.parquet(x).columns == ["want", "set"]]
    assert sum(spark.read.parquet(x).count() for x in sets) == 2


def test_vectors_are_looked_up_in_slices(spark, monkeypatch):
    """What a task holds does not grow with lists and probes: the same is found in slices of any size."""
    from casegraph.operators import resolve, vector_index

    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    asked, told = rows.filter("vec_id % 20 = 0"), []
    for most in (1 << 20, 50):
        monkeypatch.setattr(vector_index, "MOST_SIMS", most)
        monkeypatch.setattr(vector_index, "MOST_PROBES", most)
        monkeypatch.setattr(resolve, "PRODUCT_ROWS", most)
        found = vector_index.searched(vector_index.built(rows), asked, rows, 5, 24)
        told.append([{(r.query, r.found) for r in x.collect()} for x in (found, nearest(asked, rows, 5))])
    assert told[0] == told[1] and told[0][0] == told[0][1]
    assert [len(x) for x in vector_index._sliced(iter([pd.DataFrame({"a": range(7)}), pd.DataFrame({"a": []})]), 3)] == [3, 3, 1]
