"""Queries of graphs, inference and event patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.operators import cep, communities, graph, inference
from casegraph.operators import evidence as E
from casegraph.operators.graph import settled, shared_path
from casegraph.plans.register import register
from casegraph.sources.tables import ROWS_A_TASK, affiliations, events, evidence, table

QUERIES, SQL, query = register()


#: A sparse graph of the tables: nations, regions and their suppliers and customers.
_EDGES = "ge AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst FROM nation UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier UNION SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION SELECT 'R' || r_regionkey, 'R' || (r_regionkey + 1) FROM region WHERE r_regionkey < 3), gb AS (SELECT src, dst FROM ge UNION SELECT dst, src FROM ge)"


def _edges(spark, d):
    n, s, c, r = (table(spark, d, t) for t in ("nation", "supplier", "customer", "region"))
    name = lambda p, k: F.concat(F.lit(p), k)
    e = n.select(name("R", F.col("n_regionkey")).alias("src"), name("N", F.col("n_nationkey")).alias("dst"))
    e = e.union(s.select(name("N", F.col("s_nationkey")), name("S", F.col("s_suppkey"))))
    e = e.union(c.select(name("N", F.col("c_nationkey")), name("C", F.col("c_custkey"))))
    return e.union(r.filter("r_regionkey < 3").select(name("R", F.col("r_regionkey")), name("R", F.col("r_regionkey") + 1))).distinct()


@query("gr_hops", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'R0' AS node, 0 AS h UNION SELECT gb.dst, w.h + 1 FROM w JOIN gb ON gb.src = w.node WHERE w.h < 7)
SELECT node, CAST(min(h) AS INTEGER) AS hops FROM w GROUP BY node""")
def gr_hops(spark, d):
    """Distance of each node from a root."""
    return graph.hops(_edges(spark, d), spark.createDataFrame([("R0",)], "node string")).select("node", "hops")


@query("gr_provenance", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'R0' AS node, 0 AS h UNION SELECT gb.dst, w.h + 1 FROM w JOIN gb ON gb.src = w.node WHERE w.h < 7), b AS (SELECT node, min(h) AS h FROM w GROUP BY node),
p AS (SELECT b.node, min(c.node) AS parent FROM b JOIN gb ON gb.src = b.node JOIN b c ON c.node = gb.dst AND c.h = b.h - 1 GROUP BY b.node),
u AS (SELECT node, node AS cur, node AS path FROM b UNION ALL SELECT u.node, p.parent, u.path || '->' || p.parent FROM u JOIN p ON p.node = u.cur) SELECT node, path FROM u WHERE cur = 'R0'""")
def gr_provenance(spark, d):
    """Shortest path of each node to the root, written out."""
    return graph.provenance(_edges(spark, d), "R0").select("node", F.array_join("path", "->").alias("path"))


@query("jn_annotated", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'R0' AS node, 0 AS h UNION SELECT gb.dst, w.h + 1 FROM w JOIN gb ON gb.src = w.node WHERE w.h < 7), b AS (SELECT node, min(h) AS h FROM w GROUP BY node), p AS (SELECT b.node, min(c.node) AS parent FROM b JOIN gb ON gb.src = b.node JOIN b c ON c.node = gb.dst AND c.h = b.h - 1 GROUP BY b.node),
u AS (SELECT node, node AS cur, node AS path FROM b UNION ALL SELECT u.node, p.parent, u.path || '->' || p.parent FROM u JOIN p ON p.node = u.cur), pa AS (SELECT node, path FROM u WHERE cur = 'R0' AND node <> 'R0'), ev AS (SELECT 'S' || l_suppkey AS entity, l_returnflag <> 'R' AS supports, l_partkey AS source, arg_min(l_shipmode, l_orderkey * 10 + l_linenumber) AS reasoning FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1, 2, 3)
SELECT entity, supports, source, CASE WHEN supports AND path IS NOT NULL THEN 'Evidence through affiliations ' || path || '.' || chr(10) || reasoning ELSE reasoning END AS reasoning, supports AND path IS NOT NULL AS routed FROM ev LEFT JOIN pa ON pa.node = entity""")
def jn_annotated(spark, d):
    """Evidence, first of each source and polarity, with the chain that ties it to the root."""
    x = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("entity"), (F.col("l_returnflag") != "R").alias("supports"), F.col("l_partkey").alias("source"), F.col("l_linestatus").alias("reasoning"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    keys = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name")).withColumn("canonical", F.col("name"))
    rows = E.consolidate(x, keys)
    return E.annotated(rows, graph.provenance(_edges(spark, d), "R0")).select("entity", "supports", "source", "reasoning", "routed")


@query("agg_gated", """WITH ev AS (SELECT l_suppkey AS entity, l_partkey AS source, l_discount * 10 AS strength, 1 - l_tax AS conf, l_returnflag <> 'R' AS sup FROM lineitem WHERE l_suppkey % 2 = 0), pa AS (SELECT entity, sum(CASE WHEN sup THEN 1.0 ELSE -1.0 END * strength * conf) / sum(conf) AS sig, count(DISTINCT CASE WHEN sup AND strength > 0 THEN source END) AS pos, count(DISTINCT CASE WHEN NOT sup AND strength > 0 THEN source END) AS neg FROM ev WHERE conf > 0 GROUP BY entity),
pb AS (SELECT entity, sig, CASE WHEN sig >= 0 THEN pos ELSE neg END AS n FROM pa), pr AS (SELECT entity, (greatest(-1.0, least(1.0, sig * CASE WHEN least(n, 8) > 1 THEN 1 + 0.35 * log2(least(n, 8)) ELSE 1.0 END)) + 1) / 2 AS p FROM pb) SELECT s_suppkey AS entity, round(coalesce(p, 0), 6) AS prob, coalesce(p > 0, false) AS leaf, p >= 0.5 AS hypothesis FROM supplier LEFT JOIN pr ON entity = s_suppkey""")
def agg_gated(spark, d):
    """Entities gated by evidence, which every other one has."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"))
    return E.gated(s, evidence(spark, d).filter("entity % 2 = 0")).withColumn("prob", F.round("prob", 6))


@query("gr_components", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT src AS node, src AS c FROM gb UNION SELECT gb.dst, w.c FROM w JOIN gb ON gb.src = w.node), m AS (SELECT node, min(c) AS component FROM w GROUP BY node)
SELECT component, count(*) AS n FROM m GROUP BY component""")
def gr_components(spark, d):
    """Connected components and their sizes."""
    return graph.components(_edges(spark, d)).groupBy("component").agg(F.count("*").alias("n"))


@query("gr_paths", f"""WITH {_EDGES}, pr AS (SELECT 'S' || s_suppkey AS a, 'C' || (s_suppkey * 3) AS b FROM supplier), p1 AS (SELECT src AS a, dst AS z, [src, dst] AS path FROM gb WHERE src IN (SELECT a FROM pr)),
p2 AS (SELECT a, dst AS z, list_append(path, dst) AS path FROM p1 JOIN gb ON src = z WHERE NOT list_contains(path, dst)), p3 AS (SELECT a, dst AS z, list_append(path, dst) AS path FROM p2 JOIN gb ON src = z WHERE NOT list_contains(path, dst)),
p4 AS (SELECT p3.a, dst AS z, list_append(path, dst) AS path FROM p3 JOIN gb ON src = z JOIN pr ON pr.a = p3.a AND pr.b = dst WHERE NOT list_contains(path, dst)),
al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)
SELECT al.a, pr.b, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM al JOIN pr ON pr.a = al.a AND pr.b = al.z QUALIFY row_number() OVER (PARTITION BY al.a, pr.b ORDER BY len(path), path) <= 2""")
def gr_paths(spark, d):
    """Two shortest simple paths of at most four edges between each supplier and a customer."""
    pairs = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("a"), F.concat(F.lit("C"), F.col("s_suppkey") * 3).alias("b"))
    return graph.simple_paths(_edges(spark, d), pairs, 4, 2).select("a", "b", "hops", F.array_join("path", ">").alias("path"))


def _probs(spark, d):
    p = E.assess(evidence(spark, d)).select(F.concat(F.lit("S"), "entity").alias("node"), F.round("prob", 6).alias("prob"))
    return p.withColumn("is_event", F.lit(False))


@query("gr_triangulate", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT 'R0' AS node, 0 AS h UNION SELECT gb.dst, w.h + 1 FROM w JOIN gb ON gb.src = w.node WHERE w.h < 7), b AS (SELECT node, min(h) AS h FROM w GROUP BY node),
ev AS (SELECT 'S' || l_suppkey AS node, l_partkey AS source, l_discount * 10 AS strength, 1 - l_tax AS conf, l_returnflag <> 'R' AS sup FROM lineitem), pa AS (SELECT node, sum(CASE WHEN sup THEN 1.0 ELSE -1.0 END * strength * conf) / sum(conf) AS sig, count(DISTINCT CASE WHEN sup AND strength > 0 THEN source END) AS pos, count(DISTINCT CASE WHEN NOT sup AND strength > 0 THEN source END) AS neg FROM ev WHERE conf > 0 GROUP BY node),
pb AS (SELECT node, sig, CASE WHEN sig >= 0 THEN pos ELSE neg END AS n FROM pa), pr AS (SELECT node, round((greatest(-1.0, least(1.0, sig * CASE WHEN least(n, 8) > 1 THEN 1 + 0.35 * log2(least(n, 8)) ELSE 1.0 END)) + 1) / 2, 6) AS prob FROM pb)
SELECT node, round(CASE WHEN node = 'R0' THEN 0.0 ELSE pow(0.7, coalesce(h, 2)) * prob END, 6) AS score, node <> 'R0' AS wired FROM (SELECT coalesce(b.node, pr.node) AS node, h, prob FROM b FULL JOIN pr ON b.node = pr.node) WHERE node = 'R0' OR prob > 0""")
def gr_triangulate(spark, d):
    """Survivors of triangulation with scores, and which are wired to the root."""
    nodes, edges = graph.triangulate(_edges(spark, d), _probs(spark, d), "R0")
    wires = edges.filter("kind = 'evidence'").select(F.col("src").alias("node"), F.lit(True).alias("w"))
    return nodes.join(wires, "node", "left").select("node", "score", F.coalesce("w", F.lit(False)).alias("wired"))


@query("gr_corroborated", """WITH RECURSIVE p AS (SELECT 'S' || l_suppkey AS s, 'P' || l_partkey AS p, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT s AS src, p AS dst, n FROM p UNION ALL SELECT p, s, n FROM p),
w AS (SELECT 'S0' AS node, 0 AS h UNION SELECT g.dst, w.h + 1 FROM w JOIN g ON g.src = w.node WHERE w.h < 8), b AS MATERIALIZED (SELECT node, min(h) AS h FROM w GROUP BY node),
v AS (SELECT 'S0' AS node UNION SELECT g.dst FROM v JOIN g ON g.src = v.node WHERE g.n >= 2), u AS MATERIALIZED (SELECT b.node, min(x.node) AS up FROM b JOIN g ON g.src = b.node JOIN b x ON x.node = g.dst AND x.h = b.h - 1 GROUP BY 1),
l AS (SELECT node FROM b WHERE node NOT IN (SELECT node FROM v) UNION SELECT u.up FROM l JOIN u ON u.node = l.node)
SELECT least(s, p) AS src, greatest(s, p) AS dst FROM p WHERE n >= 2 UNION SELECT least(u.node, u.up), greatest(u.node, u.up) FROM l JOIN u ON u.node = l.node""")
def gr_corroborated(spark, d):
    """Edges of two sources and more, and those that hold cut-off nodes to the root."""
    orders = F.when(F.min("l_orderkey") < F.max("l_orderkey"), 2).when(F.min("l_orderkey").isNotNull(), 1).otherwise(0)  # two say as much as more
    p = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(orders.alias("source_count"))
    p = p.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), "source_count")
    return graph.corroborated_edges(settled(p), "S0")


@query("gr_as_of", """WITH e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, min(CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_shipdate AS DATE) END) AS seen, bool_and(l_linenumber > 3) AS structural FROM lineitem GROUP BY 1, 2),
s AS (SELECT * FROM e WHERE seen IS NULL OR seen <= DATE '1997-06-01'), h AS (SELECT src AS node FROM s WHERE NOT structural UNION SELECT dst FROM s WHERE NOT structural) SELECT src, dst, structural FROM s WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)""")
def gr_as_of(spark, d):
    """The supplier and part graph as it was known on a day."""
    e = table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")).agg(F.min(F.when(F.col("l_partkey") % 5 != 0, F.to_date("l_shipdate"))).alias("first_seen"), F.bool_and(F.col("l_linenumber") > 3).alias("structural"))
    e = e.withColumn("window_from", F.lit(None).cast("date"))
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumns({"is_event": F.lit(False), "day": F.lit(None).cast("date")})
    return graph.as_of(n, e, "1997-06-01")[1].select("src", "dst", "structural")


@query("gr_window", """WITH e AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, min(CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_shipdate AS DATE) END) AS seen, max(CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_shipdate AS DATE) END) AS until, bool_and(l_linenumber > 3) AS structural FROM lineitem GROUP BY 1, 2),
s AS (SELECT * FROM e WHERE seen IS NULL OR (seen <= DATE '1997-06-01' AND until >= DATE '1997-01-01')), h AS (SELECT src AS node FROM s WHERE NOT structural UNION SELECT dst FROM s WHERE NOT structural) SELECT src, dst, structural FROM s WHERE src IN (SELECT node FROM h) AND dst IN (SELECT node FROM h)""")
def gr_window(spark, d):
    """The supplier and part graph of some months."""
    seen = F.when(F.col("l_partkey") % 5 != 0, F.to_date("l_shipdate"))
    e = table(spark, d, "lineitem").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")).agg(F.min(seen).alias("window_from"), F.max(seen).alias("window_to"), F.bool_and(F.col("l_linenumber") > 3).alias("structural"))
    e = e.withColumn("first_seen", F.lit(None).cast("date"))
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumns({"is_event": F.lit(False), "day": F.lit(None).cast("date")})
    return graph.as_of(n, e, since="1997-01-01", until="1997-06-01")[1].select("src", "dst", "structural")


@query("gr_bridges", """WITH r AS (SELECT DISTINCT 'S' || l_suppkey AS node, strftime(l_shipdate, '%Y-%m') AS run FROM lineitem) SELECT node, count(*) AS n_runs, array_to_string(list_sort(list(run)), ',') AS runs FROM r GROUP BY node HAVING count(*) >= 2""")
def gr_bridges(spark, d):
    """Suppliers that several runs attest."""
    r = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("node"), F.date_format("l_shipdate", "yyyy-MM").alias("run"))
    return graph.bridges(r).select("node", F.col("n_runs").cast("long").alias("n_runs"), F.array_join("runs", ",").alias("runs"))


@query("gr_leads", """WITH b AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) >= 2), o AS (SELECT 'O' || o_orderkey AS o, o_custkey AS c, o_orderstatus AS run FROM orders WHERE o_custkey IN (SELECT o_custkey FROM b))
SELECT x.o AS a, y.o AS b, count(*) AS n_bridges, round(sum((x.c % 10) / 10.0), 6) AS score FROM o x JOIN o y ON x.c = y.c AND x.o < y.o AND x.run <> y.run GROUP BY 1, 2""")
def gr_leads(spark, d):
    """Orders of different runs that share a customer of several runs."""
    o = table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("c"), F.concat(F.lit("O"), "o_orderkey").alias("o"), F.col("o_orderstatus").alias("run"), ((F.col("o_custkey") % 10) / F.lit(10.0)).alias("w"))
    runs = o.select(F.col("c").alias("node"), "run").union(o.select("o", "run"))
    post = o.select(F.col("c").alias("node"), F.col("w").alias("p")).distinct()
    found = graph.leads(o.select(F.col("c").alias("src"), F.col("o").alias("dst")), runs, post)
    return found.select("a", "b", "n_bridges", F.round("score", 6).alias("score"))


@query("gr_adjacency", f"WITH {_EDGES} SELECT src AS node, count(*) AS degree FROM gb GROUP BY src HAVING count(*) <= 25")
def gr_adjacency(spark, d):
    """Neighbours of the nodes that are no hubs."""
    return graph.adjacency(_edges(spark, d), 25).select("node", F.size("near").cast("long").alias("degree"))


def _graphs(spark, d):
    """One weighted graph for each day of orders: suppliers and customers."""
    a = affiliations(spark, d)
    return a.groupBy(F.col("day").cast("string").alias("graph"), F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").cast("double").alias("weight"))


#: Buckets of graphs: many enough to share the work evenly, and of some edges that a task holds together.
BUCKETS_A_CORE, ROWS_A_BUCKET = 4, 100_000


@query("gr_themes")
def gr_themes(spark, d):
    """Filtered graphs, tetrahedra and beliefs of each day's graph."""
    prior = lambda c: 0.3 + F.pmod(F.substring(c, 2, 20).cast("int"), F.lit(5)) / 10
    e = _graphs(spark, d).withColumns({"weight": F.col("weight") / 5, "prior_src": prior("src"), "prior_dst": prior("dst")})
    return inference.themes(e, 0.5, max(BUCKETS_A_CORE * spark.sparkContext.defaultParallelism, -(-table(spark, d, "lineitem").count() // ROWS_A_BUCKET)))


@query("gr_theme_sizes", """WITH g AS (SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS graph, 'S' || l_suppkey AS a, 'C' || o_custkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT DISTINCT graph, a, b FROM g),
n AS (SELECT graph, count(*) AS n FROM (SELECT graph, a FROM e UNION SELECT graph, b FROM e) GROUP BY graph), m AS (SELECT graph, count(*) AS m FROM e GROUP BY graph)
SELECT graph, n AS nodes, CASE WHEN n >= 4 THEN 3 * n - 6 ELSE m END AS edges, greatest(n - 3, 0) AS tetrahedra FROM n JOIN m USING (graph)""")
def gr_theme_sizes(spark, d):
    """Nodes, edges with fill-ins, and tetrahedra of each day's filtered graph."""
    found = gr_themes(spark, d)
    counts = [F.count_if(F.col("kind").isin(*kinds)).alias(name) for name, kinds in (("nodes", ["belief"]), ("edges", ["edge", "fill_in"]), ("tetrahedra", ["tetrahedron"]))]
    return found.groupBy("graph").agg(*counts)


@query("gr_centrality")
def gr_centrality(spark, d):
    """Betweenness in the graph of all nations, suppliers and customers, its sources dealt over tasks."""
    return inference.centrality(_edges(spark, d).withColumn("graph", F.lit("all")), task_work=1 << 24).select("node", "betweenness")


@query("gr_communities")
def gr_communities(spark, d):
    """Communities, modularity and betweenness of each day's graph."""
    return inference.communities(_graphs(spark, d))


@query("gr_large_communities", """WITH e AS (SELECT n_nationkey AS n, 'C' || c_custkey AS x FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey, 'S' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT n, least('N' || n, min(x)) AS community FROM e GROUP BY n) SELECT x AS node, community FROM e JOIN g USING (n) UNION ALL SELECT 'N' || n, community FROM g""")
def gr_large_communities(spark, d):
    """Communities by rounds of joins in the graph of nations with their customers and suppliers, where each nation is one."""
    e = _edges(spark, d).filter("src like 'N%'").withColumn("weight", F.lit(1.0))
    return communities.large_communities(e, task_links=1000)


def _purchases(spark, d):
    """Purchases by the customer that each touches."""
    e = events(spark, d).filter("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("event"), F.array(F.concat(F.lit("C"), "actor")).alias("touched"), (F.col("value") / 100).alias("strength"))


@query("gr_ripple", f"""WITH {_EDGES}, dg AS (SELECT src AS node, count(*) AS n FROM gb GROUP BY 1), u AS (SELECT DISTINCT 'C' || user_id AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT t, dst AS node, 1 AS hops FROM u JOIN gb ON src = t UNION ALL SELECT t, z.dst, 2 FROM u JOIN gb y ON y.src = t JOIN gb z ON z.src = y.dst WHERE z.dst <> t),
m AS (SELECT t, node, min(hops) AS hops FROM r GROUP BY 1, 2), k AS (SELECT t, m.node, hops, row_number() OVER (PARTITION BY t ORDER BY hops, n DESC, m.node) AS rn FROM m JOIN dg ON dg.node = m.node)
SELECT event_id AS event, node, CAST(hops AS INTEGER) AS hops FROM events JOIN k ON t = 'C' || user_id AND rn <= 60 WHERE event_type = 'purchase' UNION ALL SELECT event_id, 'C' || user_id, 0 FROM events WHERE event_type = 'purchase' AND 'C' || user_id IN (SELECT node FROM dg)""")
def gr_ripple(spark, d):
    """What lies within two steps of the customer that a purchase touches, sixty nodes at most."""
    return inference.ripple(_purchases(spark, d), _edges(spark, d))


@query("gr_impact")
def gr_impact(spark, d):
    """How strongly purchases ripple through the graph of suppliers and customers."""
    e = events(spark, d).filter("event_type = 'purchase'")
    p = _purchases(spark, d).withColumn("recency", F.lit(1.0))
    edges = affiliations(spark, d).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    known = e.groupBy(F.concat(F.lit("C"), "actor").alias("node")).agg((F.avg("value") / 200).alias("prob"))
    return inference.impact(p, edges, known, watched=["S1", "S2", "S3"])


@query("gr_claims")
def gr_claims(spark, d):
    """Claims about labels told apart by their vectors."""
    v = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("entity"), (F.col("vec_id") % 2 == 0).alias("supports"), (F.col("vec_id") % 7).cast("string").alias("source"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("confidence"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"))
    return E.corroborated_claims(v)


_CEP = """WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) d FROM events), m AS (SELECT a.event_id e1, b.event_id e2, date_diff('day', a.d, b.d) span FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND a.event_id <> b.event_id AND date_diff('day', a.d, b.d) BETWEEN 0 AND 3)"""


_STORY = {"name": "signup then purchase", "windowDays": 3, "steps": [{"types": ["signup"]}, {"types": ["purchase"]}]}


def _stories(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("event"), "day", "event_type", F.lit("").alias("text"), F.array("actor").alias("participants"))
    return cep.match_rule(e, _STORY)


@query("cep_matches", f"{_CEP} SELECT e1, e2, span AS days FROM m")
def cep_matches(spark, d):
    """Chains of a signup and a purchase of one user within three days."""
    return _stories(spark, d).select(F.col("chain")[0].alias("e1"), F.col("chain")[1].alias("e2"), F.col("days").cast("long").alias("days"))


@query("cep_stories", f"{_CEP}, k AS (SELECT *, row_number() OVER (PARTITION BY e2 ORDER BY span, e1) rn, count(*) OVER (PARTITION BY e2) n FROM m) SELECT e2 AS final, e1 AS first, span AS days, n - 1 AS alternates FROM k WHERE rn = 1")
def cep_stories(spark, d):
    """One story for each purchase that completes a chain."""
    return cep.collapsed(_stories(spark, d)).select("final", F.col("chain")[0].alias("first"), F.col("days").cast("long").alias("days"), "alternates")


@query("str_chains", f"{_CEP} SELECT e1, e2, span AS days FROM m")
def str_chains(spark, d):
    """The same chains from the state of a stream that brings the events in two batches."""
    from casegraph.streaming import chains

    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", chains.STORE)
    at = shared_path(spark, "chains")
    e = events(spark, d).select(F.col("event_id").alias("event"), "day", "event_type", F.lit("").alias("text"), F.array("actor").alias("participants"))
    half = max(2, -(-e.count() // (2 * ROWS_A_TASK)))  # files of a batch, each read by one task
    e.repartition(2 * half, "event").write.parquet(f"{at}/in")
    rows = session.readStream.schema(e.schema).option("maxFilesPerTrigger", half).parquet(f"{at}/in")
    found = chains.match_stream(rows, _STORY, late="3650 days")
    found.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(found.schema).parquet(f"{at}/out")
    return told.select(F.col("chain")[0].alias("e1"), F.col("chain")[1].alias("e2"), F.col("days").cast("long").alias("days"))


@query("cep_new", f"{_CEP} SELECT count(DISTINCT e2) FILTER (e2 % 4 <> 0) AS fresh, count(DISTINCT e2) FILTER (e2 % 4 = 0) AS fired FROM m")
def cep_new(spark, d):
    """Stories that have not been alerted yet, and those that have."""
    s = cep.collapsed(_stories(spark, d)).select("rule", "final")
    fired = s.filter("final % 4 = 0").withColumn("day", F.lit("2024-01-01").cast("date"))
    new, old = cep.new_and_fired(s, fired)
    return new.agg(F.count("*").alias("fresh")).crossJoin(old.agg(F.count("*").alias("fired")))  # one row each


@query("cep_incidents", """WITH e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS d, user_id AS u FROM events WHERE event_type IN ('error', 'signup')) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.event_type = b.event_type AND a.u = b.u AND a.event_id < b.event_id AND abs(date_diff('day', a.d, b.d)) <= 7 AND strftime(a.d, '%Y-%m') = strftime(b.d, '%Y-%m')""")
def cep_incidents(spark, d):
    """Pairs of events of one incident by the signature rule."""
    from casegraph.operators.events import same_incidents

    e = events(spark, d).filter("event_type in ('error', 'signup')").select(F.col("event_id").alias("event"), "event_type", F.col("day").cast("string").alias("date"), F.array(F.col("actor").cast("string")).alias("participants"))
    return same_incidents(e)


@query("cep_leaders", """WITH e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS d, user_id AS u FROM events), g AS (SELECT *, CASE WHEN year(d) = year(lag(d) OVER w) AND date_diff('day', lag(d) OVER w, d) <= 7 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY event_type, u ORDER BY d, event_id)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, u ORDER BY d, event_id) AS k FROM g)
SELECT event_id AS event, first_value(event_id) OVER (PARTITION BY event_type, u, k ORDER BY d, event_id) AS leader FROM k""")
def cep_leaders(spark, d):
    """Events and the incidents that they join, which grow by each of them."""
    from casegraph.operators.events import growing_incidents

    e = events(spark, d).select(F.col("event_id").alias("event"), "event_type", "day", F.array(F.col("day").cast("string")).alias("dates"), F.array(F.col("actor").cast("string")).alias("participants"))
    return growing_incidents(e, ["day", "event"])


@query("st_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_windows(spark, d):
    """Events by day and type: the batch twin of the streaming window."""
    from casegraph.streaming.monitor import windowed

    return windowed(table(spark, d, "events"), "1 day", None).select("day", "event_type", "n", F.round("total", 4).alias("total"))


@query("st_sessions", """WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, k""")
def st_sessions(spark, d):
    """Sessions of users with gaps of two hours."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("ts").cast("timestamp_ntz").alias("first"), F.count("*").alias("n")).select("user_id", "first", "n")


@query("st_watchlist", """WITH k AS (SELECT upper(c_name) AS name, c_custkey FROM customer), h AS (SELECT event_id, c_custkey FROM events JOIN k ON k.c_custkey = user_id) SELECT event_id AS event, bool_or(c_custkey % 10 = 0) AS watched FROM h GROUP BY event_id""")
def st_watchlist(spark, d):
    """Events that touch a known entity, and whether it is watched."""
    from casegraph.streaming.monitor import intersect

    c = table(spark, d, "customer")
    aliases = c.select(F.upper("c_name").alias("alias"), F.concat(F.lit("C"), "c_custkey").alias("canonical"))
    watched = c.filter("c_custkey % 10 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("canonical"))
    e = events(spark, d).select(F.col("event_id").alias("event"), F.array(F.concat(F.lit("Customer#"), F.lpad(F.col("actor").cast("string"), 9, "0"))).alias("participants"))
    return intersect(e, aliases, watched).select("event", "watched")
