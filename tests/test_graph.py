"""Graph operators, inference and event patterns against goldens and invariants."""

import itertools
import math
import random
import time

import numpy as np
import pytest

from casegraph.operators import cep, events, graph, inference


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_hops_and_components(spark):
    e = edges(spark, [("R", "A"), ("A", "B"), ("X", "Y"), ("B", "R"), ("A", "A")])
    got = {r.node: r.hops for r in graph.hops(e, spark.createDataFrame([("R",)], "node string")).collect()}
    assert got == {"R": 0, "A": 1, "B": 1}
    assert {tuple(r) for r in graph.components(e).collect()} == {("R", "A"), ("A", "A"), ("B", "A"), ("X", "X"), ("Y", "X")}


def test_triangulation(spark):
    e = edges(spark, [("ROOT", "A"), ("A", "B"), ("B", "GHOST")])
    probs = spark.createDataFrame([("A", 0.8, False), ("B", 0.5, False), ("C", 0.6, False)], "node string, prob double, is_event boolean")
    nodes, kept = graph.triangulate(e, probs, "ROOT")
    got = {r.node: (round(r.relevance, 4), r.score) for r in nodes.collect()}
    assert got == {"ROOT": (1.0, 0.0), "A": (0.7, 0.56), "B": (0.49, 0.245), "C": (0.49, 0.294)}
    assert {tuple(r) for r in kept.collect()} == {("ROOT", "A", "given"), ("A", "B", "given"), ("C", "ROOT", "evidence")}


def test_edge_filter_restores_bridges(spark):
    e = spark.createDataFrame([("ROOT", "A", 5), ("A", "B", 5), ("ROOT", "B", 1), ("B", "C", None)], "src string, dst string, source_count long")
    assert {tuple(r) for r in graph.corroborated_edges(e, "ROOT").collect()} == {("A", "ROOT"), ("A", "B"), ("B", "C"), ("B", "ROOT")}
    strong = e.filter("dst <> 'C'")
    assert {tuple(r) for r in graph.corroborated_edges(strong, "ROOT").collect()} == {("A", "ROOT"), ("A", "B")}


def every_path(pairs, ends, most, k):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def grown(path, end):
        if path[-1] == end:
            yield path
        elif len(path) <= most:
            for x in near.get(path[-1], ()):
                if x not in path:
                    yield from grown([*path, x], end)

    return {(a, b): sorted(grown([a], b), key=lambda p: (len(p), p))[:k] for a, b in ends}


@pytest.mark.parametrize(("most", "k", "n"), [(4, 3, 14), (5, 4, 9)])
def test_paths_against_all_of_them(spark, most, k, n):
    rng = random.Random(most * k)
    pairs = {tuple(rng.sample([f"n{i}" for i in range(n)], 2)) for _ in range(2 * n)}
    ends = [tuple(rng.sample([f"n{i}" for i in range(n)], 2)) for _ in range(12)]
    got = graph.simple_paths(edges(spark, pairs), spark.createDataFrame(ends, "a string, b string"), most, k)
    found = {}
    for r in got.orderBy("rank").collect():
        assert r.hops == len(r.path) - 1
        found.setdefault((r.a, r.b), []).append(r.path)
    assert found == {e: p for e, p in every_path(pairs, ends, most, k).items() if p}


def test_paths_through_a_hub(spark):
    """Twenty thousand leaves around a hub, and two hundred nodes that share another one."""
    pairs = [("hub", f"l{i}") for i in range(20_000)] + [("hub", f"x{i}") for i in range(200)] + [("other", f"x{i}") for i in range(200)]
    ends = spark.createDataFrame([("l1", "l2"), ("l3", "x5"), ("l4", "other")], "a string, b string")
    got = graph.simple_paths(edges(spark, pairs), ends, 4, 3).orderBy("a", "rank").collect()
    assert [(r.a, r.path) for r in got] == [
        ("l1", ["l1", "hub", "l2"]), ("l3", ["l3", "hub", "x5"]), *[("l3", ["l3", "hub", x, "other", "x5"]) for x in ("x0", "x1")], *[("l4", ["l4", "hub", x, "other"]) for x in ("x0", "x1", "x10")],
    ]


def plain_filtered(weights):
    """The filtered graph by trying every open node in every face."""
    names = sorted({x for e in weights for x in e})
    w = lambda a, b: weights.get((min(a, b), max(a, b)), 0.0)
    first = sorted(sorted(names, key=lambda x: (-math.fsum(w(x, y) for y in names if y != x), x))[:4])
    faces, cliques = [tuple(f) for f in itertools.combinations(first, 3)], [tuple(first)]
    left = [x for x in names if x not in first]
    while left:
        _, node, face = min((-sum(w(x, y) for y in f), x, f) for f in faces for x in left)
        faces.remove(face)
        faces += [tuple(sorted((*p, node))) for p in itertools.combinations(face, 2)]
        cliques.append(tuple(sorted((*face, node))))
        left.remove(node)
    return cliques


@pytest.mark.parametrize("values", [None, [0.25, 0.5, 1.0], [-0.5, -0.25, 0.0, 0.25, 0.5]])
def test_filtered_graphs_against_every_choice(values):
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randrange(4, 16)
        weights = {}
        for _ in range(rng.randrange(n, 4 * n)):
            a, b = sorted(rng.sample([f"n{i:02}" for i in range(n)], 2))
            weights[a, b] = rng.random() if values is None else rng.choice(values)
        if len({x for e in weights for x in e}) < 4:
            continue
        kept, cliques, parents = inference.filtered_graph(weights)
        assert cliques == plain_filtered(weights) and len(kept) == 3 * (len(cliques) + 3) - 6
        assert all(p < i and len(set(cliques[i]) & set(cliques[p])) == 3 for i, p in enumerate(parents) if i)


def test_a_large_sparse_graph_and_a_deep_clique_tree():
    rng = random.Random(2)
    weights = {}
    for _ in range(24_000):
        a, b = sorted(rng.sample(range(8000), 2))
        weights[f"n{a:05}", f"n{b:05}"] = rng.random()
    began = time.time()
    kept, cliques, parents = inference.filtered_graph(weights)
    found = inference.beliefs(kept, cliques, parents, {}, 0.5)
    assert len(kept) == 3 * len(found) - 6 and time.time() - began < 30
    deep = [tuple(f"v{i + j:05}" for j in range(4)) for i in range(20_000)]
    pulls = [(f"v{i:05}", f"v{i + d:05}", 0.3, True) for i in range(20_000) for d in (1, 2, 3)]
    found = inference.beliefs(pulls, deep, [-1, *range(19_999)], {"v00000": 0.9}, 0.5)
    assert found["v00000"] > found["v00001"] > 0.5 and found["v20000"] == pytest.approx(0.5, abs=1e-6)


def plain_betweenness(pairs):
    names = sorted({x for p in pairs for x in p})
    ends = list(itertools.combinations(names, 2))
    shortest = {e: [p for p in v if len(p) == len(v[0])] for e, v in every_path(pairs, ends, len(names), 10**6).items() if v}
    score = {x: sum(sum(x in p[1:-1] for p in v) / len(v) for v in shortest.values()) for x in names}
    n = len(names)
    return {x: 2 * s / ((n - 1) * (n - 2)) if n > 2 else 0.0 for x, s in score.items()}


def test_centrality_over_tasks(spark):
    rng = random.Random(5)
    graphs = {g: {tuple(sorted(rng.sample([f"n{i}" for i in range(8)], 2))) for _ in range(m)} for g, m in (("one", 10), ("two", 12), ("three", 1))}
    rows = [(g, a, b) for g, v in graphs.items() for a, b in v] + [("one", "n1", "n1")]
    df = spark.createDataFrame(rows, "graph string, src string, dst string")
    for work in (1 << 28, 10):
        got = {(r.graph, r.node): r.betweenness for r in inference.centrality(df, work).collect()}
        assert got == pytest.approx({(g, x): s for g, v in graphs.items() for x, s in plain_betweenness(v).items()})
    assert inference.betweenness(list(graphs["one"])) == pytest.approx(plain_betweenness(graphs["one"]))


def test_trees_cost_no_sources(spark, monkeypatch):
    """What hangs on a graph is counted by sizes; a node of the rest weighs what hung on it."""
    tree = [("r", f"a{i}") for i in range(4)] + [(f"a{i}", f"b{i}{j}") for i in range(3) for j in range(i)] + [("x", "y"), ("y", "z")]
    ring = [("p", "q"), ("q", "s"), ("s", "t"), ("t", "p"), ("p", "u"), ("u", "v"), ("u", "w"), ("s", "k"), ("lone", "pair")]
    rows = [("tree", *e) for e in tree] + [("ring", *e) for e in ring]
    df = spark.createDataFrame(rows, "graph string, src string, dst string")
    for work in (1 << 28, 2):
        got = {(r.graph, r.node): r.betweenness for r in inference.centrality(df, work).collect()}
        assert got == pytest.approx({(g, x): s for g, v in (("tree", tree), ("ring", ring)) for x, s in plain_betweenness(v).items()})
    left, rounds, held = inference._peeled(inference.settled(df.union(df.select("graph", "dst", "src"))))
    assert {r.src for r in left.collect()} == {"p", "q", "s", "t"} and held.filter("graph = 'tree'").count() == 2


def test_paths(spark):
    e = edges(spark, [("A", "X"), ("X", "D"), ("A", "Y"), ("Y", "Z"), ("Z", "D")])
    pairs = spark.createDataFrame([("A", "D")], "a string, b string")
    got = [(r.hops, r.path) for r in graph.simple_paths(e, pairs, 4, 2).orderBy("hops").collect()]
    assert got == [(2, ["A", "X", "D"]), (3, ["A", "Y", "Z", "D"])]
    assert graph.simple_paths(e, pairs, 2, 2).count() == 1 and graph.simple_paths(e, pairs, 1, 2).count() == 0


def test_leads(spark):
    runs = spark.createDataFrame([("A", "ra"), ("B", "rb"), ("C", "ra"), ("C", "rb")], "node string, run string")
    p = spark.createDataFrame([("C", 0.9)], "node string, p double")
    assert [tuple(r) for r in graph.leads(edges(spark, [("C", "A"), ("C", "B")]), runs, p).collect()] == [("A", "B", 1, 0.9)]


def complete(n, seed):
    rng = random.Random(seed)
    return {(f"n{i:02}", f"n{j:02}"): rng.random() for i, j in itertools.combinations(range(n), 2)}


def test_filtered_graph_counts():
    for n in (4, 9, 15):
        kept, cliques, parents = inference.filtered_graph(complete(n, n))
        assert (len(kept), len(cliques)) == (3 * n - 6, n - 3)
        assert all(len(set(cliques[c]) & set(cliques[parents[c]])) == 3 for c in range(1, len(cliques)))
        assert (kept, cliques, parents) == inference.filtered_graph(complete(n, n))
    assert inference.filtered_graph({("a", "b"): 1.0})[1:] == ([], [])


def test_beliefs_match_enumeration():
    kept, cliques, parents = inference.filtered_graph(complete(7, 1))
    names = sorted({x for c in cliques for x in c})
    priors = {x: 0.2 + 0.1 * i for i, x in enumerate(names[:6])}
    exact, total = dict.fromkeys(names, 0.0), 0.0
    for states in itertools.product((0, 1), repeat=len(names)):
        s = dict(zip(names, states, strict=True))
        # a pair's factor stands in every clique that holds it
        energy = sum(w * (2 * s[a] - 1) * (2 * s[b] - 1) * sum({a, b} <= set(c) for c in cliques) for a, b, w, _ in kept)
        mass = np.exp(0.6 * energy) * np.prod([priors.get(x, 0.5) if s[x] else 1 - priors.get(x, 0.5) for x in names])
        total += mass
        for x in names:
            exact[x] += mass * s[x]
    got = inference.beliefs(kept, cliques, parents, priors, 0.6)
    assert got == pytest.approx({x: v / total for x, v in exact.items()})
    assert inference.beliefs(kept, cliques, parents, priors, 0.0) == pytest.approx({x: priors.get(x, 0.5) for x in names}, abs=1e-9)


def test_communities_and_centrality():
    w = {(a, b): 1.0 for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)} | {("d", "w"): 1.0}
    found = inference.louvain(w)
    assert len({found[x] for x in "abcd"}) == 1 == len({found[x] for x in "wxyz"}) and found["a"] != found["w"]
    assert inference.modularity(w, found) > 0.4
    assert inference.betweenness([("a", "b"), ("b", "c")]) == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_temporal_edges(spark):
    rows = [(1, "2024-01-01", "h"), (2, "2024-01-11", "h"), (3, "2024-01-11", "h"), (4, "2024-06-01", "h"), (5, "2024-01-02", "g"), (6, None, "h")]
    df = spark.createDataFrame(rows, "event long, day string, participant string").selectExpr("event", "cast(day as date) day", "participant")
    got = {(r.src, r.dst): (r.kind, r.days) for r in events.temporal_edges(df).collect()}
    assert got == {(1, 2): ("event_followed_by", 10), (1, 3): ("event_followed_by", 10), (2, 3): ("event_coincident", 0)}


def test_date_conflicts(spark):
    cases = {"far": ["2024-05-10", "2024-09-20"], "near": ["2024-05-10", "2024-05-20"], "month": ["2024-05", "2024-05-10"], "year": ["2024", "2024-09-20"], "single": ["2024-01-01"], "years": ["2023-12-03", "2024-12-03"]}
    df = spark.createDataFrame([(k, x) for k, v in cases.items() for x in v], "k string, date string")
    assert {r.k: r.gap for r in events.date_conflicts(df, ["k"]).collect()} == {"far": 133, "years": 366}
    order = spark.createDataFrame([("a", "2024-09-01"), ("b", "2024-05-01")], "event string, date string")
    e = edges(spark, [("a", "b"), ("b", "a"), ("a", "none")])
    assert [tuple(r) for r in events.ordering_conflicts(order, e).collect()] == [("a", "b", 123)]


def test_incidents(spark):
    rows = [(1, "strike", "2024-05-10", ["A", "B", "C"], 0.4), (2, "strike", "2024-05-16", ["a", "b", "c"], 0.9), (3, "strike", "2024-06-01", ["A", "B", "C"], 0.1), (4, "other", "2024-05-10", ["A", "B", "C"], 0.1), (5, "strike", "2024-05-11", ["X"], 0.2)]
    df = spark.createDataFrame(rows, "event long, event_type string, date string, participants array<string>, confidence double")
    leaders = events.incident_leaders(df)
    assert {tuple(r) for r in leaders.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    top = {r.leader: r for r in events.merged_incidents(df, leaders).collect()}[1]
    assert (top.n, top.confidence, top.participants) == (2, 0.9, ["A", "B", "C"])
    named = spark.createDataFrame([(1, "Strike on the port", [1.0, 0.1], "2024-05-10"), (5, "Port strike", [1.0, 0.2], "2024-05-11"), (6, "Port strike", [1.0, 0.2], "2023-05-11"), (7, "A port deal", [0.0, 1.0], "2024-05-10")], "event long, name string, vector array<double>, date string")
    alike = events.alike_names(named)
    assert {tuple(r) for r in alike.collect()} == {(1, 5)}
    assert {tuple(r) for r in events.incident_leaders(df, events.same_incidents(df).union(alike)).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 1)}


RULE = {"name": "r1", "windowDays": 30, "steps": [{"types": ["sanctions"]}, {"types": ["financial_crime"], "keywords": ["transfer"]}]}


def happenings(spark, rows):
    df = spark.createDataFrame(rows, "event long, day string, event_type string, text string, participants array<string>")
    return df.withColumn("day", df.day.cast("date"))


def test_patterns(spark):
    rows = [(1, "2024-01-01", "sanctions", "", ["A"]), (2, "2024-01-20", "financial_crime", "", ["B", "C"]), (3, "2024-01-25", "other", "a transfer", ["A"]), (4, "2024-03-30", "financial_crime", "", ["A"]), (5, None, "sanctions", "", ["A"])]
    df = happenings(spark, rows)
    assert [r.chain for r in cep.match_rule(df, RULE).collect()] == [[1, 3]]
    got = {tuple(r.chain): r.bridges for r in cep.match_rule(df, RULE, edges(spark, [("A", "B")])).collect()}
    assert got.keys() == {(1, 2), (1, 3)} and "B" in got[1, 2]
    hub = edges(spark, [("A", "B"), *[("A", f"h{i}") for i in range(40)]])
    assert cep.match_rule(df, RULE, hub).count() == 0  # a hub links nothing, not even two events that share it
    assert [tuple(r.chain) for r in cep.match_rule(df, RULE, edges(spark, [("A", "B")]), ["C"]).collect()] == [(1, 2)]
    assert [r.bridges for r in cep.match_rule(df, RULE, edges(spark, [("A", "B")]), ["B"]).collect()] == [["B"]]
    late = cep.match_rules(df, [RULE], edges(spark, [("A", "B")]), since="2024-01-22")
    assert [r.chain for r in late.collect()] == [[1, 3]]
    twice = cep.match_rules(df, [RULE, {**RULE, "name": "r2"}], edges(spark, [("A", "B")]))
    assert {r.rule for r in twice.collect()} == {"r1"} and [r.chain for r in cep.latest(twice, 1).collect()] == [[1, 3]]


def test_impact(spark):
    pairs = [("X", "A"), ("X", "B"), ("X", "C"), ("A", "B"), ("B", "C"), ("C", "D"), ("D", "E")]
    e = spark.createDataFrame([(a, b, 4.0) for a, b in pairs], "src string, dst string, weight double")
    event = spark.createDataFrame([(1, ["X"], 1.0, 1.0), (2, ["nobody"], 1.0, 1.0)], "event long, touched array<string>, strength double, recency double")
    got = {r.node: r for r in inference.impact(event, e, watched=["D"]).collect()}
    assert got.keys() == {"A", "B", "C", "D"} and got["A"].hops == 1 and got["D"].hops == 2 and got["A"].score > got["D"].score
    assert got["D"].watched and got["C"].broker and not got["A"].broker
    assert all(r.score == pytest.approx(abs(r.delta) * 0.7**r.hops * (1.5 if r.watched else 1.0)) for r in got.values())
    loose = spark.createDataFrame([*[(a, b, 4.0) for a, b in pairs], ("X", "F", 0.0)], "src string, dst string, weight double")
    assert {r.node: r.score for r in inference.impact(event, loose).collect()}["F"] == pytest.approx(0.0, abs=1e-12)
    few = spark.createDataFrame([("X", "A", 1.0), ("A", "B", 1.0)], "src string, dst string, weight double")
    assert {r.node: r.score for r in inference.impact(event, few).collect()} == {"A": 0.7, "B": pytest.approx(0.49)}
    known = spark.createDataFrame([("A", 0.9)], "node string, prob double")
    assert {r.node: r.delta for r in inference.impact(event, e, known).collect()}["A"] != got["A"].delta


def test_what_is_touched_alike_is_inferred_once(spark, monkeypatch):
    pairs = [("X", "A"), ("X", "B"), ("A", "B"), ("X", "C"), ("B", "C"), ("A", "C")]
    e = spark.createDataFrame([(a, b, 4.0) for a, b in pairs], "src string, dst string, weight double")
    event = spark.createDataFrame([(i, ["X"] if i % 2 else ["X", "X"], 1.0 + i, 0.5) for i in range(6)], "event long, touched array<string>, strength double, recency double")
    asked = []
    ripple = inference.ripple
    monkeypatch.setattr(inference, "ripple", lambda events, *a, **k: asked.append(events.count()) or ripple(events, *a, **k))
    rows = inference.impact(event, e).collect()
    assert asked == [1] and len(rows) == 18
    assert all(r.score == pytest.approx((1.0 + r.event) * 0.5 * abs(r.delta) * 0.7) for r in rows)


def test_ripple_keeps_the_nearest(spark):
    pairs = [("X", f"n{i:03}") for i in range(300)] + [(f"n{i:03}", f"m{i:03}") for i in range(250)] + [("Y", "X")]
    event = spark.createDataFrame([(1, ["X", "Y"]), (2, ["n000"])], "event long, touched array<string>")
    rows = inference.ripple(event, edges(spark, pairs), most=60).collect()
    one = {r.node: r.hops for r in rows if r.event == 1}
    assert one == {"X": 0, "Y": 0, **{f"n{i:03}": 1 for i in range(60)}}
    two = {r.node: r.hops for r in rows if r.event == 2}
    assert len(two) == 61 and two["X"] == 1 == two["m000"] and two["n001"] == 2 and "Y" not in two


def test_events_that_touch_the_same_are_followed_once(spark, monkeypatch):
    written, kept = [], inference.settled
    monkeypatch.setattr(inference, "settled", lambda df: written.append(kept(df)) or written[-1])
    pairs = [("X", f"n{i:02}") for i in range(30)] + [(f"n{i:02}", f"m{i:02}") for i in range(20)]
    touched = [["X"], ["X", "X", None], ["n00", "X"], None, ["Z"]]
    event = spark.createDataFrame([(i, touched[i % 5]) for i in range(100)] + [(0, ["n01"])], "event long, touched array<string>")
    found = {i: {} for i in range(100)}
    for r in inference.ripple(event, edges(spark, pairs), most=40).collect():
        found[r.event][r.node] = r.hops
    near = {"X": 0, **{f"n{i:02}": 1 for i in range(30)}, **{f"m{i:02}": 2 for i in range(10)}}
    assert found[1] == found[5] == near and not found[3] and not found[4]
    assert found[2] == {**near, "n00": 0, "m00": 1, "m10": 2} and found[0]["n01"] == 0 == found[0]["X"]
    assert max(df.count() for df in written) <= 300  # an event each would be 2,000 rows and more


def test_long_chains_have_no_bound(spark):
    e = edges(spark, [(f"v{i:03}", f"v{i + 1:03}") for i in range(130)])
    assert graph.hops(e, spark.createDataFrame([("v000",)], "node string")).agg({"hops": "max"}).first()[0] == 130


def test_stories_fire_once(spark):
    rows = [(1, "2024-01-01", "sanctions", "", ["A"]), (2, "2024-01-05", "sanctions", "", ["A", "B"]), (3, "2024-01-20", "financial_crime", "", ["A", "B"])]
    stories = cep.collapsed(cep.match_rule(happenings(spark, rows), RULE))
    assert [(r.final, r.alternates, r.chain[0]) for r in stories.collect()] == [(3, 1, 2)]
    none = spark.createDataFrame([], "rule string, final long, day date")
    new, old = cep.new_and_fired(stories, none)
    assert (new.count(), old.count()) == (1, 0)
    new, old = cep.new_and_fired(stories, cep.marked(none, stories, "2024-02-01"))
    assert (new.count(), old.count()) == (0, 1)


def plain_incidents(rows, alike):
    """Each event against all incidents as they are by then, first match wins."""
    out, incidents = {}, []
    for event, kind, dates, names in rows:
        names, days = {x.strip().upper() for x in names if x and x.strip()}, [events._day(x) for x in dates if x]
        for one in incidents:
            dated = not days or not one["days"] or any(events._near(a, b, 7) for a in one["days"] for b in days)
            signed = kind == one["kind"] and kind not in ("", "other") and names and one["names"] and len(names & one["names"]) / len(names | one["names"]) >= 0.6
            signed = signed and any(x[1] for x in days) and any(x[1] for x in one["days"])
            if dated and (signed or (one["leader"], event) in alike or (event, one["leader"]) in alike):
                one["names"] |= names
                one["days"] += days
                out[event] = one["leader"]
                break
        else:
            incidents.append({"leader": event, "kind": kind, "names": names, "days": days})
            out[event] = event
    return out


@pytest.mark.parametrize("seed", [1])
def test_growing_incidents_against_all_of_them(spark, seed):
    """Random events, a participant in a third of them, months and years as dates, similar names."""
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        day = f"2024-{rng.randrange(1, 4):02d}-{rng.randrange(1, 29):02d}"
        dates = rng.choice([[day], [day], [day], [day[:7]], [day[:4]], [], [day, f"2024-{rng.randrange(1, 13):02d}-05"], [None, "2023-12-30"]])
        names = rng.sample([f"p{k}" for k in range(9)], rng.randrange(4)) + (["Hub"] if i % 3 == 0 else []) + ([" ", None] if i % 11 == 0 else [])
        rows.append((i, rng.choice(["strike", "strike", "deal", "other", ""]), dates, names))
    rng.shuffle(rows)
    alike = {tuple(sorted(rng.sample(range(260), 2))) for _ in range(40)}
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "event long, event_type string, dates array<string>, participants array<string>, ord long")
    pairs = spark.createDataFrame(sorted(alike), "a long, b long")
    for given in (set(), alike):
        got = events.growing_incidents(df, ["ord"], pairs if given else None)
        want = plain_incidents(rows, given)
        assert {r.event: r.leader for r in got.collect()} == want and len(set(want.values())) < 250
    records = events.grown_incidents(df.withColumns({"name": df.event.cast("string"), "confidence": df.event / 260}), got, ["ord"]).collect()
    assert sum(r.n for r in records) == 260 and all(len(r.labels) == r.n and r.labels[0] == str(r.leader) for r in records)


def test_an_incident_grows(spark):
    """The third event matches what the first two have become, and neither of them."""
    rows = [(1, "strike", ["2024-05-01"], ["A", "B", "C"]), (2, "strike", ["2024-05-06"], ["A", "B", "C", "D"]), (3, "strike", ["2024-05-12"], ["B", "C", "D", "E"]), (4, "strike", ["2024-05-12"], ["A"]), (5, "strike", ["2024-05-13"], ["a "])]
    df = spark.createDataFrame(rows, "event long, event_type string, dates array<string>, participants array<string>")
    assert {r.event: r.leader for r in events.growing_incidents(df, ["event"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


@pytest.mark.parametrize("meetings", [40, 1_000_000])
def test_active_windows_in_cells(spark, meetings):
    """Spans of pairs against all pairs, whatever the cells; days may differ within an event or be missing."""
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(12)}", rng.choice([None, *range(5)]), rng.randrange(40)) for _ in range(300)] + [("lone", 9, 1), (None, 3, 2), ("e1", 3, None)]
    days = spark.createDataFrame(rows, "event string, n int, who long").selectExpr("event", "date_add(date'2024-01-01', n) as day", "who")
    want: dict = {}
    for one, day, a in rows:
        for two, _, b in rows:
            if one is not None and one == two and a is not None and b is not None and a < b:
                want.setdefault((a, b), []).extend([] if day is None else [day])
    found = events.active_windows(days, meetings)
    got = {(r.a, r.b): (r.lo and r.lo.day - 1, r.hi and r.hi.day - 1) for r in found.collect()}
    assert got == {k: (min(v, default=None), max(v, default=None)) for k, v in want.items()} and found.count() == len(want)
    assert "hashpartitioning(a#" not in found._jdf.queryExecution().toString()  # no pair is shuffled
    assert not events.active_windows(days.limit(0)).collect()


@pytest.mark.parametrize("size", [50, 5000])
def test_growing_incidents_are_judged_in_buckets(spark, monkeypatch, size):
    """Small groups share a call, whatever the size of the buckets."""
    monkeypatch.setattr(events, "BUCKET_EVENTS", size)
    rows = [(i, "strike", [f"2024-05-{1 + i // 300:02d}"], [f"p{i % 300}"]) for i in range(900)]
    df = spark.createDataFrame(rows, "event long, event_type string, dates array<string>, participants array<string>")
    assert {r.event: r.leader for r in events.growing_incidents(df, ["event"]).collect()} == {i: i % 300 for i in range(900)}


def test_betweenness_costs_the_connected_parts():
    """A graph of many parts costs each part by itself, and its values are those of a part, scaled."""
    pairs = [(f"{i}{a}", f"{i}{b}") for i in range(8000) for a, b in (("x", "y"), ("y", "z"))]
    started = time.perf_counter()
    got = inference.betweenness(pairs)
    assert time.perf_counter() - started < 4
    assert got == pytest.approx({f"{i}{x}": (2 / (23999 * 23998) if x == "y" else 0.0) for i in range(8000) for x in "xyz"})


@pytest.mark.parametrize("buckets", [None, 1, 3])
def test_themes_of_a_bucket_are_those_of_each_graph(spark, monkeypatch, buckets):
    """Beliefs of all graphs of a bucket run at once, and find what each graph alone does."""
    rng = random.Random(4)
    graphs = {f"g{i}": {tuple(sorted(rng.sample([f"n{j:02}" for j in range(3 + 4 * i)], 2))): rng.choice([0.2, 0.4, rng.random()]) for _ in range(2 + 5 * i)} for i in range(6)}
    priors = {f"n{j:02}": 0.2 + j / 50 for j in range(40)}
    rows = [(g, a, b, w / 2, priors[a], priors[b]) for g, e in graphs.items() for (a, b), w in e.items() for _ in range(2)] + [("g5", "n01", "n01", 9.0, priors["n01"], priors["n01"])]
    got = inference.themes(spark.createDataFrame(rows, "graph string, src string, dst string, weight double, prior_src double, prior_dst double"), 0.5, buckets).collect()
    want = {}
    for g, e in graphs.items():
        kept, cliques, parents = inference.filtered_graph(e, ["n01"] if g == "g5" else None)
        weight = {x[:2]: x[2] for x in kept}
        want |= {(g, "edge" if x[3] else "fill_in", x[:2]): (x[2], 0.0) for x in kept}
        want |= {(g, "tetrahedron", c): (sum(weight[p] for p in itertools.combinations(c, 2)), 0.0) for c in cliques}
        found = inference.beliefs(kept, cliques, parents, priors, 0.5) if cliques else {x: priors[x] for p in e for x in p}
        want |= {(g, "belief", (x,)): (p, p - priors[x]) for x, p in found.items()}
    assert len(got) == len(want) and {(r.graph, r.kind, tuple(r.members)): (r.value, r.delta) for r in got} == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}


def test_a_star_is_filtered_without_asking_all_its_faces(monkeypatch):
    """Faces whose one open end is the same node wait as one."""
    asked = []
    push = inference.heapq.heappush
    monkeypatch.setattr(inference.heapq, "heappush", lambda heap, x: asked.append(len(x)) or push(heap, x))
    kept, cliques, _ = inference.filtered_graph({("a", f"n{i:03}"): 1.0 for i in range(400)})
    assert len(cliques) == 398 and asked.count(4) < 3000  # entries of waiting faces


def test_communities_go_over_each_part_by_itself(monkeypatch):
    """Many parts give what each gives alone, trees are not searched, and values are those of all shortest paths."""
    rng = random.Random(8)
    weights = {}
    for part in range(30):
        for _ in range(rng.randrange(1, 14)):
            a, b = sorted(rng.sample([f"p{part:02}n{i}" for i in range(8)], 2))
            weights[a, b] = float(rng.randrange(1, 4))
    asked = []
    search = inference._part_of_betweenness
    monkeypatch.setattr(inference, "_part_of_betweenness", lambda pairs, *a, **k: asked.append(len(pairs)) or search(pairs, *a, **k))
    assert inference.sparse_betweenness(list(weights)) == pytest.approx(plain_betweenness(list(weights)), abs=1e-12)
    assert asked and asked[0] < len(weights)
    tree = [(f"n{i:03}", f"n{rng.randrange(i):03}") for i in range(1, 60)] + [("x", "y")]
    asked.clear()
    assert inference.sparse_betweenness(tree) == pytest.approx(plain_betweenness(tree), abs=1e-12) and not asked
    found = inference.louvain(weights)
    assert set(found) == {x for e in weights for x in e} and all(a[:3] == b[:3] for a in found for b in found if found[a] == found[b])
