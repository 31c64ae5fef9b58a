"""Merging, resolution, stores and ingest against small goldens."""

import random

import numpy as np
from pyspark.sql import functions as F

from casegraph.functions.names import name_tokens
from casegraph.operators import merge, projections, resolve, vector_index
from casegraph.operators.picks import first_wins, last_wins, page, top_rows
from casegraph.operators.resolve import nearest
from casegraph.sources import ingest, stores


def test_cascade(spark):
    new = spark.createDataFrame([("THE TREASURY BUREAU",), ("U.S. Department of the Treasury",), ("Seo Hee",), ("Iran",), ("New Co",), ("alias",)], "name string")
    saved = spark.createDataFrame([("Treasury Bureau", []), ("US TREASURY", []), ("SEOHEE", []), ("IRAN INTERNATIONAL", []), ("Known", ["Alias"])], "name string, labels array<string>")
    got = {r.name: (r.saved_name, r.rule) for r in merge.merge_cascade(new, saved).collect()}
    assert got["U.S. DEPARTMENT OF THE TREASURY"] == ("US TREASURY", "tokens")
    assert got["SEO HEE"] == ("SEOHEE", "key") and got["ALIAS"] == ("KNOWN", "label")
    assert got["IRAN"] == (None, None) == got["NEW CO"]


def test_subset_aliases_match_all_pairs(spark):
    rng = random.Random(1)
    names = [" ".join(rng.sample("alpha beta gamma delta epsilon zeta".split(), rng.randint(1, 4))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string").select("id", name_tokens(F.col("name")).alias("tokens"))
    sets = {i: set(n.upper().split()) for i, n in enumerate(names)}
    want = {(a, b) for a in sets for b in sets if len(sets[a]) >= 2 and sets[a] < sets[b]}
    assert {tuple(r) for r in resolve.subset_aliases(df, df).collect()} == want


def test_registry(spark):
    names = spark.createDataFrame([(1, "Seo-Hee"), (2, "SEOHEE"), (3, "u.s."), (4, "US"), (5, "Other")], "ord long, name string")
    got = {r.ord: r.canonical for r in resolve.registry_resolve(names).collect()}
    assert got == {1: "SEO-HEE", 2: "SEO-HEE", 3: "U.S.", 4: "U.S.", 5: "OTHER"}
    known = spark.createDataFrame([("OTHER", "BIG OTHER"), ("SEO HEE", "SH")], "alias string, canonical string")
    got = {r.ord: r.canonical for r in resolve.registry_resolve(names, known).collect()}
    assert got == {1: "SH", 2: "SH", 3: "U.S.", 4: "U.S.", 5: "BIG OTHER"}


def test_quoted_texts(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (2, "one two three four five six"), (3, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "a b"), (3, "two three four five six")], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in resolve.quoted_texts(docs, items).collect()} == {1: [1, 3], 2: [3], 3: [2]}


def test_self_dedup_and_groups(spark):
    df = spark.createDataFrame([(1, "The Red Widget"), (2, "RED WIDGET"), (3, "Red Widget Group"), (4, "Blue")], "id long, name string")
    assert {r.id: r.leader for r in merge.self_dedup(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    many = spark.createDataFrame([(f"Acme {i:03}",) for i in range(90)], "name string")
    sizes = [r["count"] for r in merge.name_groups(many).groupBy("group").count().collect()]
    assert sorted(sizes) == [10, 40, 40]


def test_connector(spark):
    edges = spark.createDataFrame([("A", "B", "t"), ("A", "X", "t"), ("X", "D", "t"), *[("ROOT", x, "evidence") for x in "ABCD"]], "src string, dst string, type string")
    nodes = spark.createDataFrame([(x,) for x in ["A", "B", "C", "D", "X", "ROOT"]], "node string")
    chosen = spark.createDataFrame([("A",), ("A",), ("D",), ("C",), ("ZZZ",)], "node string")
    paths, found, lost, inner, stats = merge.connector(nodes, edges, chosen)
    assert [(r.a, r.b, r.path) for r in paths.collect()] == [("A", "D", ["A", "X", "D"])]
    assert {r.node for r in found.filter("broker").collect()} == {"X"}
    assert {tuple(r) for r in lost.collect()} == {("ZZZ", "missing"), ("A-C", "unreachable"), ("C-D", "unreachable")}
    assert {(r.node, r.role) for r in found.collect()} == {("A", "selected"), ("C", "selected"), ("D", "selected"), ("X", "connector")}
    assert {tuple(r) for r in inner.collect()} == {("A", "X"), ("D", "X")}
    assert stats.first().asDict() == {"selected": 3, "connectors": 1, "brokers": 1, "edges": 2, "paths": 1, "unreachable": 2}
    induced = merge.connector(nodes, edges, spark.createDataFrame([("A",), ("B",), ("D",)], "node string"), mode="induced")
    assert [(r.a, r.b, r.path) for r in induced.paths.collect()] == [("A", "B", ["A", "B"])] and induced.missing.count() == 0
    more = edges.union(spark.createDataFrame([("A", "Y", "t"), ("Y", "Z", "t"), ("Z", "D", "t")], edges.schema))
    there = nodes.union(spark.createDataFrame([("Y",), ("Z",)], nodes.schema))
    ends = spark.createDataFrame([("A",), ("D",)], "node string")
    assert {r.node for r in merge.connector(there, more, ends, mode="shortest_path").nodes.collect()} == {"A", "D", "X"}
    hidden = merge.connector(there, more, ends, most=4, k=3)
    assert sorted(r.hops for r in hidden.paths.collect()) == [2, 3] and {r.node for r in hidden.nodes.filter("broker").collect()} >= {"X"}


def test_direct_edges_leave_the_rest_of_the_graph_alone(spark, monkeypatch):
    written, kept = [], merge.graph.settled
    monkeypatch.setattr(merge.graph, "settled", lambda df: written.append(kept(df)) or written[-1])
    pairs = [("A", "B"), ("B", "A"), ("A", "A"), ("B", "C"), *[(f"N{i}", f"N{i + 1}") for i in range(50)], ("A", "N0")]
    edges = spark.createDataFrame([(a, b, "t") for a, b in pairs], "src string, dst string, type string")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    found = merge.connector(nodes, edges, spark.createDataFrame([("A",), ("B",), ("D",)], "node string"), mode="induced")
    assert [(r.a, r.b) for r in found.paths.collect()] == [("A", "B")] and [tuple(r) for r in found.missing.collect()] == [("D", "missing")]
    assert [tuple(r) for r in found.edges.collect()] == [("A", "B")]
    assert max(df.count() for df in written) <= 3


def test_round_robin(spark):
    rows = [("t1", 2, "a", 9.0), ("t1", 2, "b", 8.0), ("t2", 1, "a", 7.0), ("t2", 1, "c", 6.0), ("t3", 0, "d", 1.0)]
    df = spark.createDataFrame(rows, "theme string, weight long, node string, score double")
    assert [r.node for r in merge.round_robin(df, 4).orderBy("place").collect()] == ["a", "c", "d", "b"]


def test_picks(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 1, None)], "key string, ord long, v string")
    assert {tuple(r) for r in first_wins(df, ["key"], "ord").collect()} == {("k", 1, "a"), ("l", 1, None)}
    assert {tuple(r) for r in last_wins(df, ["key"], "ord").collect()} == {("k", 2, "b"), ("l", 1, None)}
    assert top_rows(df, ["key"], 1, "ord").count() == 2
    assert [r.id for r in page(spark.range(10), 2, 3, "id").collect()] == [3, 4, 5]


def test_state_store(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "canonical string, n long"
    assert stores.load_state(spark, path, "s1", schema).count() == 0
    stores.save_state(spark.createDataFrame([("A", 1)], schema), path, "s1")
    stores.save_state(spark.createDataFrame([("B", 2)], schema), path, "s2")
    stores.save_state(spark.createDataFrame([("C", 3)], schema), path, "s1")
    assert [tuple(r) for r in stores.load_state(spark, path, "s1", schema).collect()] == [("C", 3)]
    assert [tuple(r) for r in stores.load_state(spark, path, "s2", schema).collect()] == [("B", 2)]


def test_payload_and_files(spark, tmp_path):
    rows = [(1, "r", "p", "t", "body", None), (2, "r", None, "only title", None, "403"), (3, "r", "p", " ", "", None)]
    a = spark.createDataFrame(rows, "ord long, run string, publisher string, title string, text string, error string")
    got = {r.ord: (r.key, r.body_available) for r in ingest.payload(a).collect()}
    assert got == {1: ("p__1", True), 2: ("unknown__2", False)}
    (tmp_path / "a.txt").write_text("\n Title é \nbody")
    (tmp_path / "b.txt").write_text(" \n ")
    got = {r.title: r.error for r in ingest.files(spark, str(tmp_path)).collect()}
    assert got == {"Title é": None, None: "no text"}


def test_projections(spark):
    rows = [("x" * 50, False, ["n/a", "b", "b", None], 1.0, 1), ("y", False, ["y"], 2.0, 2), ("y", True, ["z"], 3.0, 3)]
    df = spark.createDataFrame(rows, "node string, is_event boolean, labels array<string>, score double, ord long")
    got = {r.node[0]: r for r in projections.payload_nodes(df).collect()}
    assert len(got["x"].label) == 38 and got["x"].labels == ["b"] and got["y"].is_event and got["y"].labels == ["z"]


def test_vector_index_against_all_vectors(spark):
    """Recall at ten over clustered vectors, with one list that holds a third of them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 16))
    own = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    x = centres[own] + rng.normal(0, 0.25, (3000, 16))
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(None, [1.0] * 16), (3000, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = vector_index.built(e, lists=40)
    held = [i for r in index.blocks.collect() for i in r.ids]
    assert sorted(held) == list(range(3000))
    q = e.filter("vec_id % 20 = 0")
    exact = nearest(q, e, 10)
    found = vector_index.searched(index, q, e, 10, probes=6)
    assert vector_index.recall(found, exact) >= 0.95 and found.count() == 1500
    assert vector_index.recall(vector_index.searched(index, q, e, 10, probes=40, depth=300), exact) == 1.0
    looked = {r.list: len(r.ids) for r in index.blocks.collect()}
    assert sum(sorted(looked.values())[-6:]) < 3000  # six lists are less than all vectors
    assert vector_index.tuned(index, e, 10, queries=40) < 40
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert vector_index.searched(vector_index.built(none), none, none, 10).count() == 0
