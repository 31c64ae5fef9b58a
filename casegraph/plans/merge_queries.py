"""Queries of merging, grouping, retrieval and connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegraph.operators import merge as M
from casegraph.operators.graph import settled, shared_path
from casegraph.plans.graph_queries import _EDGES
from casegraph.plans.register import register
from casegraph.sources import deltas
from casegraph.sources.tables import table

QUERIES, SQL, query = register()


_NAME = "CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name || ' ' || p_brand WHEN 1 THEN p_name || ' ' || p_brand WHEN 2 THEN replace(p_name, ' ', '-') || '.' || p_brand ELSE p_name || ' ' || p_brand || ' Group' END"


def _named(spark, d, condition):
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT {_NAME} AS name, p_type AS label FROM part WHERE {condition}")


@query("jn_cascade", f"""WITH n AS (SELECT DISTINCT upper({_NAME}) AS name FROM part WHERE p_partkey % 2 = 0), s AS (SELECT DISTINCT upper({_NAME}) AS name FROM part WHERE p_partkey % 2 = 1),
nk AS (SELECT *, regexp_replace(name, '[^A-Z0-9]', '', 'g') AS k, list_filter(list_distinct(regexp_extract_all(replace(name, '.', ''), '[A-Z0-9]+')), lambda x: x NOT IN ('THE', 'A', 'AN', 'OF', 'FOR', 'AND', 'TO', 'IN', 'ON')) AS t FROM n),
sk AS (SELECT *, regexp_replace(name, '[^A-Z0-9]', '', 'g') AS k, list_filter(list_distinct(regexp_extract_all(replace(name, '.', ''), '[A-Z0-9]+')), lambda x: x NOT IN ('THE', 'A', 'AN', 'OF', 'FOR', 'AND', 'TO', 'IN', 'ON')) AS t FROM s),
m3 AS (SELECT nk.name, min(sk.name) AS m FROM nk JOIN sk ON nk.k = sk.k GROUP BY 1), m4 AS (SELECT nk.name, min(sk.name) AS m FROM nk JOIN sk ON nk.name <> sk.name AND ((len(nk.t) >= 2 AND len(nk.t) < len(sk.t) AND list_has_all(sk.t, nk.t)) OR (len(sk.t) >= 2 AND len(sk.t) < len(nk.t) AND list_has_all(nk.t, sk.t))) GROUP BY 1)
SELECT n.name, coalesce(s.name, m3.m, m4.m) AS saved_name, CASE WHEN s.name IS NOT NULL THEN 'name' WHEN m3.m IS NOT NULL THEN 'key' WHEN m4.m IS NOT NULL THEN 'tokens' END AS rule FROM n LEFT JOIN s ON s.name = n.name LEFT JOIN m3 ON m3.name = n.name LEFT JOIN m4 ON m4.name = n.name""")
def jn_cascade(spark, d):
    """New names met with saved records by the rules in turn."""
    saved = _named(spark, d, "p_partkey % 2 = 1").select("name", F.array().cast("array<string>").alias("labels"))
    return M.merge_cascade(_named(spark, d, "p_partkey % 2 = 0"), saved)


@query("jn_rewrite", "WITH e AS (SELECT 'C' || o_custkey AS src, 'C' || o_orderkey % 1500 AS dst, o_orderstatus AS run FROM orders), r AS (SELECT CASE WHEN CAST(substr(src, 2) AS INT) % 3 = 0 THEN 'G' || CAST(substr(src, 2) AS INT) % 100 ELSE src END AS src, CASE WHEN CAST(substr(dst, 2) AS INT) % 3 = 0 THEN 'G' || CAST(substr(dst, 2) AS INT) % 100 ELSE dst END AS dst, run FROM e) SELECT src, dst, array_to_string(list_sort(list(DISTINCT run)), ',') AS runs FROM r WHERE src <> dst GROUP BY src, dst")
def jn_rewrite(spark, d):
    """Edges after their ends were merged into groups."""
    e = table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("C"), F.col("o_orderkey") % 1500).alias("dst"), F.array("o_orderstatus").alias("runs"))
    a = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("name"), F.concat(F.lit("G"), F.col("c_custkey") % 100).alias("saved_name"))
    return M.rewritten(e, a).select("src", "dst", F.array_join("runs", ",").alias("runs"))


@query("agg_fields", "SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS text, max(o_totalprice) AS number, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS items FROM orders GROUP BY 1")
def agg_fields(spark, d):
    """Orders of a customer merged field by field."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("text"), F.col("o_totalprice").alias("number"), F.array("o_orderpriority").alias("items"))
    return M.merged_fields(o).select("key", "text", "number", F.array_join(F.array_sort("items"), ",").alias("items"))


@query("udf_groups")
def udf_groups(spark, d):
    """Similar names in groups of at most forty."""
    return M.name_groups(_named(spark, d, "true"))


@query("udf_self_dedup", f"""WITH RECURSIVE n AS (SELECT p_partkey AS id, {_NAME} AS name FROM part), t AS (SELECT id, list_sort(list_filter(list_distinct(regexp_extract_all(replace(upper(name), '.', ''), '[A-Z0-9]+')), lambda x: x NOT IN ('THE', 'A', 'AN', 'OF', 'FOR', 'AND', 'TO', 'IN', 'ON'))) AS t FROM n),
u AS (SELECT t, min(id) AS leader FROM t GROUP BY t), e AS (SELECT a.leader AS a, b.leader AS b FROM u a JOIN u b ON len(a.t) >= 2 AND len(a.t) < len(b.t) AND list_has_all(b.t, a.t)), bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT leader AS x, leader AS c FROM u UNION SELECT bi.b, r.c FROM r JOIN bi ON bi.a = r.x), m AS (SELECT x, min(c) AS c FROM r GROUP BY x) SELECT t.id, m.c AS leader FROM t JOIN u ON u.t = t.t JOIN m ON m.x = u.leader""")
def udf_self_dedup(spark, d):
    """Parts of one name by tokens."""
    table(spark, d, "part").createOrReplaceTempView("part")
    return M.self_dedup(spark.sql(f"SELECT p_partkey AS id, {_NAME} AS name FROM part"))


@query("udf_retrieve", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS found, list_cosine_similarity(q.embedding, e.embedding) AS sim, e.label % 2 AS side FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query, side ORDER BY sim DESC, found) AS r FROM p) SELECT query, found, round(sim, 4) AS sim FROM k WHERE r <= 10")
def udf_retrieve(spark, d):
    """Hybrid retrieval: ten entities and ten relations for every twentieth vector."""
    e = table(spark, d, "embeddings")
    return M.retrieve(e.filter("vec_id % 20 = 0"), e.filter("label % 2 = 0"), e.filter("label % 2 = 1"), "hybrid").select("query", "found", F.round("sim", 4).alias("sim"))


@query("udf_retrieve_mix", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, e.vec_id AS found, list_cosine_similarity(q.embedding, e.embedding) AS sim, e.label % 3 AS side FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query, side ORDER BY sim DESC, found) AS r FROM p) SELECT query, found, round(sim, 4) AS sim FROM k WHERE r <= 10")
def udf_retrieve_mix(spark, d):
    """Mixed retrieval: ten entities, ten relations and ten chunks for every twentieth vector."""
    e = table(spark, d, "embeddings")
    kinds = [e.filter(F.col("label") % 3 == i) for i in range(3)]
    return M.retrieve(e.filter("vec_id % 20 = 0"), kinds[0], kinds[1], "mix", chunks=kinds[2]).select("query", "found", F.round("sim", 4).alias("sim"))


@query("udf_index_recall", "SELECT count(*) AS queries, 10 * count(*) AS found, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def udf_index_recall(spark, d):
    """What the vector index finds for every twentieth vector, and whether that is nine tenths
    of the ten nearest of all vectors."""
    from casegraph.operators import vector_index
    from casegraph.operators.resolve import nearest

    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0")
    index = vector_index.built(e)
    found = settled(vector_index.searched(index, q, e, 10, vector_index.tuned(index, e, 10)))
    share = vector_index.recall(found, nearest(q, e, 10))
    return found.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("found"), F.lit(share >= 0.9).alias("enough"))


@query("gr_connector")
def gr_connector(spark, d):
    """Connectors and brokers between chosen suppliers and customers."""
    from casegraph.plans.graph_queries import _edges

    e = _edges(spark, d).withColumn("type", F.lit("affiliation"))
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    chosen = spark.createDataFrame([("S1",), ("S2",), ("C3",), ("C6",), ("ZZZ",)], "node string")
    return M.connector(n, e, chosen).nodes


_INDUCED = "p AS (SELECT l_suppkey AS s, l_partkey AS p FROM lineitem), c AS (SELECT p AS k FROM p GROUP BY 1 ORDER BY count(*) DESC, p LIMIT 20), h AS (SELECT s AS k FROM p GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 20)"


@query("gr_induced", f"WITH {_INDUCED} SELECT DISTINCT 'P' || p AS a, 'S' || s AS b FROM p WHERE p IN (SELECT k FROM c) AND s IN (SELECT k FROM h)")
def gr_induced(spark, d):
    """Direct edges between the busiest suppliers and parts."""
    lines = table(spark, d, "lineitem")
    e = lines.select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst"), F.lit("supply").alias("type"))
    n = e.select(F.col("src").alias("node")).union(e.select("dst"))
    top = lambda k: lines.groupBy(k).count().orderBy(F.desc("count"), k).limit(20)
    chosen = top("l_suppkey").select(F.concat(F.lit("S"), "l_suppkey").alias("node")).union(top("l_partkey").select(F.concat(F.lit("P"), "l_partkey")))
    return M.connector(n, e, chosen, mode="induced").paths.select("a", "b")


@query("gr_unreachable", f"WITH {_EDGES}, ch AS (SELECT 'C' || min(c_custkey) AS node FROM customer GROUP BY c_nationkey), pr AS (SELECT x.node AS a, y.node AS b FROM ch x JOIN ch y ON x.node < y.node), d1 AS (SELECT src AS a, dst AS z FROM gb), d2 AS (SELECT DISTINCT d1.a, gb.dst AS z FROM d1 JOIN gb ON gb.src = d1.z) SELECT a || '-' || b AS node, 'unreachable' AS why FROM pr WHERE NOT EXISTS (SELECT 1 FROM d2 x JOIN d2 y ON x.z = y.z WHERE x.a = pr.a AND y.a = pr.b) AND NOT EXISTS (SELECT 1 FROM d1 x JOIN d2 y ON x.z = y.z WHERE x.a = pr.a AND y.a = pr.b)")
def gr_unreachable(spark, d):
    """Of the first customers of each nation, the pairs without a path of four edges."""
    from casegraph.plans.graph_queries import _edges

    e = _edges(spark, d).withColumn("type", F.lit("affiliation"))
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    chosen = table(spark, d, "customer").groupBy("c_nationkey").agg(F.concat(F.lit("C"), F.min("c_custkey")).alias("node")).select("node")
    return M.connector(n, e, chosen, mode="shortest_path").missing.select("node", "why")


@query("gr_key_network", f"""WITH {_EDGES}, top AS (SELECT 'C' || c_custkey AS node FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 6), pr AS (SELECT x.node AS a, y.node AS b FROM top x JOIN top y ON x.node < y.node), p1 AS (SELECT src AS a, dst AS z, [src, dst] AS path FROM gb WHERE src IN (SELECT a FROM pr)),
p2 AS (SELECT a, dst AS z, list_append(path, dst) AS path FROM p1 JOIN gb ON src = z WHERE NOT list_contains(path, dst)), p3 AS (SELECT a, dst AS z, list_append(path, dst) AS path FROM p2 JOIN gb ON src = z WHERE NOT list_contains(path, dst)),
p4 AS (SELECT p3.a, dst AS z, list_append(path, dst) AS path FROM p3 JOIN gb ON src = z JOIN pr ON pr.a = p3.a AND pr.b = dst WHERE NOT list_contains(path, dst)), al AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)
SELECT al.a, pr.b, CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM al JOIN pr ON pr.a = al.a AND pr.b = al.z QUALIFY row_number() OVER (PARTITION BY al.a, pr.b ORDER BY len(path), path) <= 2""")
def gr_key_network(spark, d):
    """The connector of the highest-scored entities."""
    from casegraph.plans.graph_queries import _edges

    e = _edges(spark, d).withColumn("type", F.lit("affiliation"))
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    seed = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(6)
    return M.connector(n, e, seed.select(F.concat(F.lit("C"), "c_custkey").alias("node")), 4, 2)[0].select("a", "b", "hops", F.array_join("path", ">").alias("path"))


@query("win_picker")
def win_picker(spark, d):
    """Twenty customers in turns over nations."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("theme"), (F.col("c_nationkey") % 7).alias("weight"), F.col("c_mktsegment").alias("s"), F.concat(F.lit("C"), F.col("c_custkey") % 200).alias("node"), F.col("c_acctbal").alias("score"))
    return M.round_robin(c.drop("s"), 20)


@query("str_store", "WITH a AS (SELECT o_custkey AS entity, o_orderstatus AS run, o_totalprice / 1000000 AS prob, CASE WHEN o_orderkey % 10 = 0 THEN 'event' ELSE 'ORG' END AS kind, o_orderkey % 2 AS half FROM orders) SELECT entity, 'ORG' AS kind, round(max(prob), 6) AS prob, array_to_string(list_sort(list(DISTINCT run)), ',') AS runs, count(*) AS n FROM a WHERE kind <> 'event' GROUP BY entity")
def str_store(spark, d):
    """The cumulative store after two investigations."""
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.when(F.col("o_orderkey") % 10 == 0, "event").otherwise("ORG").alias("kind"), (F.col("o_totalprice") / 1000000).alias("prob"), F.array("o_orderstatus").alias("runs"), F.lit(1).cast("long").alias("n"), (F.col("o_orderkey") % 2).alias("half"))
    empty = a.drop("half").limit(0)
    first = M.store_update(empty, a.filter("half = 0").drop("half"))
    return M.store_update(first, a.filter("half = 1").drop("half")).select("entity", "kind", F.round("prob", 6).alias("prob"), F.array_join("runs", ",").alias("runs"), "n")


@query("str_deltas", "WITH a AS (SELECT o_custkey AS entity, o_orderstatus AS run, o_totalprice / 1000000 AS prob, CASE WHEN o_orderkey % 10 = 0 THEN 'event' ELSE 'ORG' END AS kind FROM orders) SELECT entity, 'ORG' AS kind, round(max(prob), 6) AS prob, array_to_string(list_sort(list(DISTINCT run)), ',') AS runs, count(*) AS n FROM a WHERE kind <> 'event' GROUP BY entity")
def str_deltas(spark, d):
    """The cumulative store after an investigation for each year of orders, kept by deltas."""
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.when(F.col("o_orderkey") % 10 == 0, "event").otherwise("ORG").alias("kind"), (F.col("o_totalprice") / 1000000).alias("prob"), F.array("o_orderstatus").alias("runs"), F.lit(1).cast("long").alias("n"), F.year("o_orderdate").alias("year"))
    at = shared_path(spark, "store")
    for (year,) in sorted(a.select("year").distinct().collect()):
        new = M.of_store(a.filter(F.col("year").eqNullSafe(F.lit(year)))).drop("year")
        deltas.merge(at, new, M.store_entities, "entity", f"year-{year}", buckets=8, most_changes=2)
    return deltas.stored(spark, at, M.store_entities).select("entity", "kind", F.round("prob", 6).alias("prob"), F.array_join("runs", ",").alias("runs"), "n")
