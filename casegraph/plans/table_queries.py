"""Queries of joins, aggregates, windows, top rows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casegraph.functions import dates, names, text
from casegraph.operators import evidence as E
from casegraph.operators import pairs as R
from casegraph.operators import reports
from casegraph.operators.picks import first_wins, last_wins, merged, page, top_rows
from casegraph.plans.register import register
from casegraph.sources.tables import affiliations, articles, events, evidence, table

QUERIES, SQL, query = register()


_EV = "ev AS (SELECT l_suppkey AS entity, l_partkey AS source, l_discount * 10 AS strength, 1 - l_tax AS conf, l_returnflag <> 'R' AS sup, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"
_PROB = f"""{_EV}, pa AS (SELECT entity, sum(CASE WHEN sup THEN 1.0 ELSE -1.0 END * strength * conf) / sum(conf) AS sig, count(DISTINCT CASE WHEN sup AND strength > 0 THEN source END) AS pos,
 count(DISTINCT CASE WHEN NOT sup AND strength > 0 THEN source END) AS neg FROM ev WHERE conf > 0 GROUP BY entity), pb AS (SELECT entity, sig, CASE WHEN sig >= 0 THEN pos ELSE neg END AS n FROM pa),
probs AS (SELECT entity, (greatest(-1.0, least(1.0, sig * CASE WHEN least(n, 8) > 1 THEN 1 + 0.35 * log2(least(n, 8)) ELSE 1.0 END)) + 1) / 2 AS prob, n FROM pb)"""


@query("agg_evidence", f"WITH {_PROB} SELECT entity, round(prob, 6) AS prob, n AS n_sources, CASE WHEN n >= 3 THEN 'strong' WHEN n = 2 THEN 'moderate' ELSE 'weak' END AS tier FROM probs")
def agg_evidence(spark, d):
    """Suppliers by corroborated probability."""
    return E.assess(evidence(spark, d)).withColumn("prob", F.round("prob", 6))


@query("agg_evidence_named", f"WITH {_PROB} SELECT s_name, n_name, round(prob, 6) AS prob, n AS n_sources FROM probs JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey WHERE prob > 0 ORDER BY prob DESC, s_name LIMIT 50")
def agg_evidence_named(spark, d):
    """The fifty likeliest suppliers with their nations."""
    probs = E.assess(evidence(spark, d)).filter("prob > 0")
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    joined = probs.join(s, probs["entity"] == s["s_suppkey"]).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.orderBy(F.desc("prob"), "s_name").limit(50).select("s_name", "n_name", F.round("prob", 6).alias("prob"), "n_sources")


_AFF = "af AS (SELECT 'S' || l_suppkey AS a, 'C' || o_custkey AS b, l_orderkey AS chunk, o_orderpriority AS rel_type, l_discount * 10 AS strength, 1 - l_tax AS conf, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS run, CAST(o_orderdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("agg_pairs", f"""WITH {_AFF}, p AS (SELECT a AS src, b AS dst, count(DISTINCT chunk) AS source_count, array_to_string(list_sort(list(DISTINCT rel_type)), ',') AS types, avg(strength) AS s, avg(conf) AS c, arg_min(chunk, ord) AS first_chunk FROM af GROUP BY a, b)
SELECT src, dst, source_count, types, round(s, 6) AS strength, round(c, 6) AS confidence, first_chunk, round(CASE WHEN s <> 0 AND c <> 0 THEN s * c ELSE source_count END, 8) AS weight FROM p""")
def agg_pairs(spark, d):
    """Supplier and customer pairs, summed over orders."""
    p = R.pair_edges(affiliations(spark, d), F.lit(False))
    return p.select("src", "dst", "source_count", F.array_join("types", ",").alias("types"), *[F.round(c, 6).alias(c) for c in ("strength", "confidence")], "first_chunk", F.round("weight", 8).alias("weight"))


@query("agg_degrees", f"""WITH {_AFF}, e AS (SELECT DISTINCT a, b FROM af), n AS (SELECT a AS node FROM e UNION ALL SELECT b FROM e), g AS (SELECT node, count(*) AS degree FROM n GROUP BY node)
SELECT node, degree, degree > 1 AS connected, degree = (SELECT max(degree) FROM g) AS top FROM g""")
def agg_degrees(spark, d):
    """Degrees of the pair graph, and which is the highest."""
    e = affiliations(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    g = R.degrees(e)
    top = g.agg(F.max("degree").alias("most"))
    return g.crossJoin(F.broadcast(top)).select("node", "degree", (F.col("degree") > 1).alias("connected"), (F.col("degree") == F.col("most")).alias("top"))  # one row


@query("agg_causal", """WITH c AS (SELECT a.event_type AS cause, b.event_type AS effect, round(a.value / 100, 6) AS s, round(b.value / 100, 6) AS c, a.event_id % 9 AS url FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 400 WHERE a.event_type <> b.event_type),
g AS (SELECT cause, effect, max(s) AS s, max(c) AS c, count(DISTINCT url) AS n FROM c GROUP BY 1, 2)
SELECT cause, effect, round(s, 6) AS s, round(c, 6) AS c, n AS n_urls, round(s * c * least(2.0, 1 + 0.3 * greatest(n - 1, 0)), 4) AS weight FROM g""")
def agg_causal(spark, d):
    """Weights of cause and effect among event types."""
    e = table(spark, d, "events")
    a = e.select("user_id", F.col("event_id").alias("i"), F.col("event_type").alias("cause"), F.round(F.col("value") / 100, 6).alias("strength"))
    b = e.select("user_id", F.col("event_id").alias("j"), F.col("event_type").alias("effect"), F.round(F.col("value") / 100, 6).alias("confidence"))
    claims = a.join(b, "user_id").filter("j > i and j <= i + 400").select("cause", "effect", "strength", "confidence", (F.col("i") % 9).alias("url"), F.lit("").alias("claim_text"), F.lit(0).alias("ord"))
    return E.causal_edges(claims).select("cause", "effect", F.round("s", 6).alias("s"), F.round("c", 6).alias("c"), "n_urls", "weight")


@query("agg_verdict", """WITH i AS (SELECT d.doc_id AS item, d.source, CASE WHEN toxic = 1 THEN 'REFUTES' WHEN quality = 1 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS stance, least(1.0, d.n_chars / 5000.0) AS conf FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
s AS (SELECT coalesce(sum(conf) FILTER (stance = 'SUPPORTS'), 0) AS pro, coalesce(sum(conf) FILTER (stance = 'REFUTES'), 0) AS con, count(DISTINCT source) FILTER (stance = 'SUPPORTS') AS pro_sources, count(DISTINCT source) FILTER (stance = 'REFUTES') AS con_sources, count(*) FILTER (stance = 'NEUTRAL') AS neutral FROM i),
n AS (SELECT *, CASE WHEN pro + con > 0 THEN (pro - con) / (pro + con) ELSE 0 END AS net FROM s), t AS (SELECT *, net * least(1.0, CASE WHEN net >= 0 THEN pro_sources ELSE con_sources END / 3.0) AS tempered FROM n)
SELECT round(pro, 4) AS pro, round(con, 4) AS con, pro_sources, con_sources, neutral, round(net, 6) AS net, round(tempered, 6) AS tempered,
 CASE WHEN tempered >= 0.8 THEN 'Almost Certainly' WHEN tempered >= 0.55 THEN 'Highly Likely' WHEN tempered >= 0.25 THEN 'Likely' WHEN tempered >= -0.25 THEN 'Roughly Even Chance' WHEN tempered >= -0.55 THEN 'Unlikely' WHEN tempered >= -0.8 THEN 'Highly Unlikely' ELSE 'Almost Certainly Not' END AS verdict FROM t""")
def agg_verdict(spark, d):
    """The verdict over labelled documents."""
    v = E.verdict(_stances(spark, d))
    return v.select(*[F.round(c, 4).alias(c) for c in ("pro", "con")], "pro_sources", "con_sources", "neutral", *[F.round(c, 6).alias(c) for c in ("net", "tempered")], "verdict")


def _stances(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    stance = F.when(F.col("toxic") == 1, "REFUTES").when(F.col("quality") == 1, "SUPPORTS").otherwise("NEUTRAL")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("item"), "source", stance.alias("stance"), F.least(F.lit(1.0), F.col("n_chars") / F.lit(5000.0)).alias("confidence"))


@query("win_top_items", """WITH i AS (SELECT d.doc_id AS item, CASE WHEN toxic = 1 THEN 'REFUTES' WHEN quality = 1 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS stance, least(1.0, d.n_chars / 5000.0) AS conf FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
SELECT item, stance FROM i QUALIFY row_number() OVER (PARTITION BY stance ORDER BY conf DESC, item) <= 10""")
def win_top_items(spark, d):
    """The ten surest documents of each stance."""
    return E.top_items(_stances(spark, d)).select("item", "stance")


@query("agg_sources", """WITH h AS (SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host, url FROM pages),
g AS (SELECT host, count(*) AS n, len(list(DISTINCT url)) AS n_urls, min(url) AS first_url FROM h GROUP BY host), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, host) AS rnk, sum(n) OVER () AS total FROM g)
SELECT host, n, least(n_urls, 25) AS n_urls, first_url, rnk <= 3 AS top3, round(sum(CASE WHEN rnk <= 3 THEN n ELSE 0 END) OVER () / total, 6) AS top3_share FROM r""")
def agg_sources(spark, d):
    """Pages by publisher, with the share of the three largest."""
    p = table(spark, d, "pages").select(text.host(F.col("url")).alias("host"), "url")
    out = reports.source_concentration(p)
    return out.select("host", "n", "n_urls", "first_url", F.col("top").alias("top3"), F.round("share", 6).alias("top3_share"))


@query("agg_histogram", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def agg_histogram(spark, d):
    """Orders by month."""
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("agg_coverage", """SELECT lang AS run, count(*) AS fetched, count(*) FILTER (doc_id % 7 <> 3) AS body_ok, count(*) FILTER (doc_id % 7 = 3) AS headline_only, count(DISTINCT source) AS publishers, count(*) <= 5 AS sparse, count(*) >= 20 AS rich FROM documents GROUP BY ROLLUP (lang)""")
def agg_coverage(spark, d):
    """Articles fetched, with and without bodies, by run and in all."""
    a = articles(spark, d)
    return a.rollup("run").agg(F.count("*").alias("fetched"), F.count("text").alias("body_ok"), F.count_if(F.col("text").isNull()).alias("headline_only"), F.countDistinct("publisher").alias("publishers")).withColumns({"sparse": F.col("fetched") <= 5, "rich": F.col("fetched") >= 20})


@query("agg_retrieval", """WITH a AS (SELECT vec_id AS id FROM embeddings WHERE label < 6), b AS (SELECT vec_id AS id FROM embeddings WHERE label >= 3), c AS (SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count(a.id) AS found, count(b.id) AS truth, count(*) AS every FROM a FULL JOIN b ON a.id = b.id)
SELECT round(tp / found, 6) AS precision_, round(tp / truth, 6) AS recall, round(2.0 * tp / (found + truth), 6) AS f1, round(tp / every, 6) AS iou FROM c""")
def agg_retrieval(spark, d):
    """Precision, recall, F1 and IoU of two id sets."""
    e = table(spark, d, "embeddings")
    m = reports.set_metrics(e.filter("label < 6"), e.filter("label >= 3"), ["vec_id"])
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("agg_modes", """WITH r AS (SELECT event_type AS mode, user_id AS q, count(*) AS n, max(value) AS v FROM events GROUP BY 1, 2), h AS (SELECT DISTINCT q FROM r WHERE mode = 'view'), u AS (SELECT q, count(DISTINCT mode) AS modes FROM r GROUP BY q)
SELECT mode, round(avg(n), 6) AS mean_n, count(*) FILTER (h.q IS NOT NULL) AS in_view, count(*) FILTER (u.modes = 1) AS only_here, round(avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END), 6) AS grounded FROM r LEFT JOIN h ON r.q = h.q JOIN u ON u.q = r.q GROUP BY mode""")
def agg_modes(spark, d):
    """Figures of retrieval modes, with event types as modes and users as queries."""
    r = table(spark, d, "events").groupBy(F.col("event_type").alias("mode"), F.col("user_id").alias("q")).agg(F.count("*").alias("n"), F.max("value").alias("v"))
    h = r.filter("mode = 'view'").select("q", F.lit(1).alias("h"))
    u = r.groupBy("q").agg(F.countDistinct("mode").alias("modes"))
    j = r.join(h, "q", "left").join(u, "q")
    return j.groupBy("mode").agg(F.round(F.avg("n"), 6).alias("mean_n"), F.count("h").alias("in_view"), F.count_if(F.col("modes") == 1).alias("only_here"), F.round(F.avg(F.when(F.col("v") > 50, 1.0).otherwise(0.0)), 6).alias("grounded"))


@query("agg_mode_overlap", """WITH f AS (SELECT DISTINCT event_type AS mode, user_id AS q, CAST(ts AS DATE) AS i FROM events), n AS (SELECT mode, count(*) AS n FROM f GROUP BY 1), c AS (SELECT x.mode AS a, y.mode AS b, count(*) AS c FROM f x JOIN f y ON x.q = y.q AND x.i = y.i AND x.mode < y.mode GROUP BY 1, 2)
SELECT x.mode AS a, y.mode AS b, round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)), 6) AS jaccard FROM n x JOIN n y ON x.mode < y.mode LEFT JOIN c ON c.a = x.mode AND c.b = y.mode""")
def agg_mode_overlap(spark, d):
    """How alike what two modes find is."""
    f = events(spark, d).select(F.col("event_type").alias("mode"), F.col("actor").alias("query"), F.col("day").alias("item"))
    return reports.mode_overlap(f).withColumn("jaccard", F.round("jaccard", 6))


@query("jn_causal", """WITH c AS (SELECT 'cust ' || o_custkey AS cause, CASE WHEN o_orderkey % 5 = 0 THEN 'nobody' ELSE 'Cust ' || o_orderkey % 900 END AS effect, o_totalprice / 600000 AS s, 0.5 AS c, o_orderkey % 7 AS url, o_orderpriority AS h, o_orderstatus AS dir FROM orders), k AS (SELECT 'CUST ' || c_custkey AS name, 'G' || c_custkey % 400 AS canonical FROM customer WHERE c_custkey % 9 <> 0),
r AS (SELECT x.canonical AS cause, y.canonical AS effect, s, c, url, h, dir FROM c JOIN k x ON x.name = upper(c.cause) JOIN k y ON y.name = upper(c.effect) WHERE x.canonical <> y.canonical), g AS (SELECT cause, effect, max(s) AS s, max(c) AS c, count(DISTINCT url) AS n, array_to_string(list_sort(list(DISTINCT h)), ',') AS hedging, array_to_string(list_sort(list(DISTINCT dir)), ',') AS direction FROM r GROUP BY 1, 2)
SELECT cause, effect, n AS n_urls, hedging, direction, round(s * c * least(2.0, 1 + 0.3 * (n - 1)), 4) AS weight FROM g""")
def jn_causal(spark, d):
    """Causal claims between known entities, with their hedging and directions."""
    o = table(spark, d, "orders")
    effect = F.when(F.col("o_orderkey") % 5 == 0, "nobody").otherwise(F.concat(F.lit("Cust "), F.col("o_orderkey") % 900))
    claims = o.select(F.concat(F.lit("cust "), "o_custkey").alias("cause"), effect.alias("effect"), (F.col("o_totalprice") / 600000).alias("strength"), F.lit(0.5).alias("confidence"), (F.col("o_orderkey") % 7).alias("url"), F.lit("").alias("claim_text"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("hedging"), F.col("o_orderstatus").alias("direction"))
    keys = table(spark, d, "customer").filter("c_custkey % 9 <> 0").select(F.concat(F.lit("CUST "), "c_custkey").alias("name"), F.concat(F.lit("G"), F.col("c_custkey") % 400).alias("canonical"))
    g = E.causal_edges(E.resolved_claims(claims, keys))
    return g.select("cause", "effect", "n_urls", F.array_join("hedging", ",").alias("hedging"), F.array_join("direction", ",").alias("direction"), "weight")


@query("agg_counters", f"""WITH {_AFF}, e AS (SELECT a, b, count(DISTINCT run) AS runs FROM af GROUP BY a, b), n AS (SELECT a AS node, run FROM af UNION SELECT b, run FROM af), b AS (SELECT node, count(DISTINCT run) AS runs FROM n GROUP BY node)
SELECT (SELECT count(*) FROM b) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM b WHERE runs >= 2) AS bridges, (SELECT count(*) FROM b WHERE runs = 3) AS bridges_all, (SELECT count(*) FROM e WHERE runs >= 2) AS cross_edges""")
def agg_counters(spark, d):
    """Counters of the case graph: nodes, edges, bridges."""
    a = affiliations(spark, d)
    e = a.groupBy("a", "b").agg(F.countDistinct("run").alias("runs")).agg(F.count("*").alias("edges"), F.count_if(F.col("runs") >= 2).alias("cross_edges"))
    n = a.select(F.col("a").alias("node"), "run").union(a.select("b", "run")).groupBy("node").agg(F.countDistinct("run").alias("runs"))
    n = n.agg(F.count("*").alias("nodes"), F.count_if(F.col("runs") >= 2).alias("bridges"), F.count_if(F.col("runs") == 3).alias("bridges_all"))
    return n.crossJoin(e).select("nodes", "edges", "bridges", "bridges_all", "cross_edges")  # one row each


_SPREAD = "sp AS (SELECT user_id AS actor, event_type, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events), iv AS (SELECT *, CASE WHEN length(day) = 7 THEN CAST(day || '-01' AS DATE) ELSE CAST(day AS DATE) END AS lo, CASE WHEN length(day) = 7 THEN last_day(CAST(day || '-01' AS DATE)) ELSE CAST(day AS DATE) END AS hi FROM sp)"


@query("agg_date_spread", f"WITH {_SPREAD} SELECT actor, event_type, CAST(min(lo) AS VARCHAR) AS lo, CAST(max(hi) AS VARCHAR) AS hi, date_diff('day', min(hi), max(lo)) AS gap FROM iv GROUP BY 1, 2 HAVING count(*) >= 2 AND date_diff('day', min(hi), max(lo)) > 20")
def agg_date_spread(spark, d):
    """Events whose dates lie too far apart."""
    from casegraph.operators.events import date_conflicts

    return date_conflicts(_precise(spark, d), ["actor", "event_type"], 20).select("actor", "event_type", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"), F.col("gap").cast("long").alias("gap"))


def _precise(spark, d):
    day = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select(F.col("user_id").alias("actor"), "event_type", day.alias("date"))


@query("agg_ordering", f"""WITH {_SPREAD}, e AS (SELECT actor, event_type, min(lo) AS lo, max(hi) AS hi FROM iv GROUP BY 1, 2) SELECT s.actor, s.event_type AS src, t.event_type AS dst, date_diff('day', t.hi, s.lo) AS gap FROM e s JOIN e t ON s.actor = t.actor AND s.event_type < t.event_type WHERE date_diff('day', t.hi, s.lo) > -29""")
def agg_ordering(spark, d):
    """Pairs of events whose order contradicts their dates (tolerance below 0 here)."""
    from casegraph.operators.events import ordering_conflicts

    p = _precise(spark, d).withColumn("event", F.concat_ws("|", "actor", "event_type"))
    kinds = p.select("actor", "event_type").distinct()
    edges = kinds.join(kinds.withColumnRenamed("event_type", "other"), "actor").filter("event_type < other").select(F.concat_ws("|", "actor", "event_type").alias("src"), F.concat_ws("|", "actor", "other").alias("dst"))
    bad = ordering_conflicts(p.select("event", "date"), edges, -29)
    return bad.select(F.split("src", r"\|")[0].cast("long").alias("actor"), F.split("src", r"\|")[1].alias("src"), F.split("dst", r"\|")[1].alias("dst"), F.col("gap").cast("long").alias("gap"))


@query("agg_store_edges", f"""WITH {_AFF} SELECT a, b, array_to_string(list_sort(list(DISTINCT rel_type)), ',') AS types, array_to_string(list_sort(list(DISTINCT 'https://x.example/' || chunk % 50)), ',') AS urls, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen,
 count(DISTINCT day) AS observed, bool_or(run = 'R') AS hypothesis, round(max(strength * conf), 6) AS weight FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, * EXCLUDE (a, b) FROM af) GROUP BY a, b""")
def agg_store_edges(spark, d):
    """The cumulative store's edges."""
    a = affiliations(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel_type", F.concat(F.lit("https://x.example/"), F.col("chunk") % 50).alias("url"), "day", F.col("day").alias("window_from"), F.col("day").alias("window_to"), (F.col("run") == "R").alias("hypothesis"), (F.col("strength") * F.col("confidence")).alias("weight"))
    m = R.merged_edges(a)
    return m.select("a", "b", F.array_join("types", ",").alias("types"), F.array_join("urls", ",").alias("urls"), F.col("window_from").cast("string").alias("first_seen"), F.col("window_to").cast("string").alias("last_seen"), F.size("observed").cast("long").alias("observed"), "hypothesis", F.round("weight", 6).alias("weight"))


@query("agg_store_entities", """SELECT o_custkey AS entity, round(max(o_totalprice), 2) AS score, round(arg_max(o_totalprice - 250000, abs(o_totalprice - 250000)), 2) AS delta, arg_min(o_orderstatus, o_orderkey) AS kind, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS labels, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS runs FROM orders GROUP BY o_custkey""")
def agg_store_entities(spark, d):
    """The cumulative store's entities, with orders as records."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_totalprice").alias("score"), F.lit(0.5).alias("prob"), (F.col("o_totalprice") - 250000).alias("delta"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("run"))
    m = R.merged_entities(o)
    return m.select(F.col("entity").cast("long").alias("entity"), F.round("score", 2).alias("score"), F.round("delta", 2).alias("delta"), "kind", F.array_join("labels", ",").alias("labels"), F.array_join("runs", ",").alias("runs"))


@query("agg_duplicates", """WITH r AS (SELECT p_name AS rep, upper(p_brand) AS label, p_retailprice AS rel, p_type AS kind, p_partkey AS ord FROM part), c AS (SELECT rep, label, count(*) AS n FROM r GROUP BY 1, 2),
m AS (SELECT rep, label AS common FROM c QUALIFY row_number() OVER (PARTITION BY rep ORDER BY n DESC, length(label), label DESC) = 1)
SELECT r.rep, round(max(rel), 2) AS relevance, arg_min(kind, ord) AS kind, count(*) AS n, any_value(common) AS common, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM r JOIN m ON m.rep = r.rep GROUP BY r.rep""")
def agg_duplicates(spark, d):
    """Parts of one name merged into a record."""
    r = table(spark, d, "part").select(F.col("p_name").alias("rep"), F.col("p_brand").alias("label"), F.col("p_retailprice").alias("relevance"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("ord"))
    return R.merged_duplicates(r).select("rep", F.round("relevance", 2).alias("relevance"), "kind", "n", "common", F.array_join("labels", ",").alias("labels"))


@query("agg_edges_by_chunk", f"WITH {_AFF} SELECT chunk, array_to_string(list_sort(list(a || '>' || b)), ',') AS edges FROM af GROUP BY chunk")
def agg_edges_by_chunk(spark, d):
    """Edges of each order."""
    return affiliations(spark, d).groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_list(F.concat("a", F.lit(">"), "b"))), ",").alias("edges"))


@query("jn_resolve", """WITH k AS (SELECT upper(c_name) AS name, 'C' || c_custkey AS canonical, 0 AS kind FROM customer UNION ALL SELECT 'CUST ' || c_custkey, 'C' || c_custkey, 0 FROM customer UNION ALL SELECT upper(c_name), 'N' || c_nationkey, 1 FROM customer UNION ALL SELECT 'NAT ' || c_nationkey, 'N' || c_nationkey, 1 FROM customer),
w AS (SELECT name, arg_min(canonical, kind) AS canonical FROM k GROUP BY name), o AS (SELECT o_orderkey, 'Cust ' || o_custkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'nobody' ELSE 'Nat ' || o_custkey % 25 END AS b FROM orders)
SELECT o_orderkey, x.canonical AS a, y.canonical AS b FROM o JOIN w x ON x.name = upper(o.a) JOIN w y ON y.name = upper(o.b) WHERE x.canonical <> y.canonical""")
def jn_resolve(spark, d):
    """Edges with their ends resolved by name, records before representatives."""
    c = table(spark, d, "customer")
    own = c.select(F.concat(F.lit("C"), "c_custkey").alias("canonical"), F.array("c_name", F.concat(F.lit("Cust "), "c_custkey")).alias("names"), F.col("c_custkey").alias("ord"))
    groups = c.select(F.concat(F.lit("N"), "c_nationkey").alias("canonical"), F.array("c_name", F.concat(F.lit("Nat "), "c_nationkey")).alias("names"))
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Cust "), "o_custkey").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "nobody").otherwise(F.concat(F.lit("Nat "), F.col("o_custkey") % 25)).alias("b"))
    return R.resolved(o, R.alias_keys(own, groups))


@query("jn_relations", f"""WITH {_AFF}, e AS (SELECT DISTINCT a, b FROM af), r AS (SELECT a AS node, 'out ' || b AS rel FROM e UNION ALL SELECT b, 'in ' || a FROM e), n AS (SELECT 'C' || c_custkey AS node FROM customer UNION ALL SELECT 'S' || s_suppkey FROM supplier)
SELECT n.node, count(rel) AS n_relations, count(rel) > 0 AS triangulated FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node""")
def jn_relations(spark, d):
    """Nodes with their relations attached."""
    e = affiliations(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    n = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("node")).union(table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey")))
    return R.relations_of(e, n).select("node", F.coalesce(F.greatest(F.size("relations"), F.lit(0)), F.lit(0)).cast("long").alias("n_relations"), "triangulated")


@query("jn_consolidate", f"WITH {_EV} SELECT s_name AS entity, sup AS supports, count(DISTINCT source) AS n, min(ord) AS first FROM ev JOIN supplier ON s_suppkey = entity GROUP BY 1, 2")
def jn_consolidate(spark, d):
    """Evidence on canonical names, first of each source and polarity."""
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_name").alias("canonical"))
    c = E.consolidate(evidence(spark, d), keys)
    return c.groupBy("entity", "supports").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


@query("jn_contamination", """SELECT d.doc_id, array_to_string(list_sort(list(DISTINCT CAST(b.item_id AS VARCHAR))), ',') AS items FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY d.doc_id""")
def jn_contamination(spark, d):
    """Documents that quote a text of another table in full."""
    from casegraph.operators.resolve import quoted_texts

    return quoted_texts(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").alias("items"))


@query("jn_nearest", """WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT q.vec_id AS query, arg_max(e.vec_id, list_cosine_similarity(q.embedding, e.embedding)) AS nearest, round(max(list_cosine_similarity(q.embedding, e.embedding)), 4) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.vec_id GROUP BY q.vec_id""")
def jn_nearest(spark, d):
    """The nearest other vector of every twentieth one."""
    from casegraph.operators.resolve import nearest

    e = table(spark, d, "embeddings")
    return nearest(e.filter(F.col("vec_id") % 20 == 0), e, 1).select("query", F.col("found").alias("nearest"), F.round("sim", 4).alias("sim"))


@query("jn_rerank", """WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 7) SELECT e.vec_id, round(list_cosine_similarity(q.embedding, e.embedding), 4) AS sim FROM q, embeddings e QUALIFY row_number() OVER (ORDER BY list_cosine_similarity(q.embedding, e.embedding) DESC, e.vec_id) <= 20""")
def jn_rerank(spark, d):
    """The twenty vectors nearest to one, best first."""
    from casegraph.operators.resolve import nearest

    e = table(spark, d, "embeddings")
    return nearest(e.filter("vec_id = 7"), e, 20, same=True).select(F.col("found").alias("vec_id"), F.round("sim", 4).alias("sim"))


_ALIAS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'The ' || p_name || ' ' || p_brand WHEN 1 THEN upper(p_name || ' ' || p_brand) WHEN 2 THEN replace(p_name, ' ', '') || p_brand WHEN 3 THEN p_name || ' ' || p_brand || ' Division' ELSE p_type || ' ' || p_name END AS name FROM part"


@query("jn_registry", f"""WITH n AS ({_ALIAS}), k AS (SELECT *, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS nk FROM n)
SELECT id, (SELECT any_value(f) FROM (SELECT arg_min(upper(name), id) AS f, nk FROM k GROUP BY nk) z WHERE z.nk = k.nk) AS canonical FROM k""")
def jn_registry(spark, d):
    """Names resolved by a registry: by upper case, then by norm key, else minted."""
    from casegraph.operators.resolve import registry_resolve

    table(spark, d, "part").createOrReplaceTempView("part")
    return registry_resolve(spark.sql(_ALIAS).withColumnRenamed("id", "ord")).select(F.col("ord").alias("id"), "canonical")


@query("jn_alias_subset", f"""WITH n AS ({_ALIAS}), t AS (SELECT id, list_filter(list_sort(list_distinct(regexp_extract_all(replace(upper(name), '.', ''), '[A-Z0-9]+'))), lambda x: NOT list_contains(['THE','A','AN','OF','FOR','AND','TO','IN','ON'], x)) AS t FROM n),
u AS (SELECT t, min(id) AS id FROM t WHERE len(t) >= 2 GROUP BY t) SELECT a.id AS a, min(b.id) AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.t) < len(b.t) AND list_has_all(b.t, a.t) GROUP BY a.id""")
def jn_alias_subset(spark, d):
    """Names whose tokens all stand in another name, two tokens at least."""
    from casegraph.operators.resolve import subset_aliases

    table(spark, d, "part").createOrReplaceTempView("part")
    t = spark.sql(_ALIAS).select("id", F.array_sort(names.name_tokens(F.col("name"))).alias("tokens")).groupBy("tokens").agg(F.min("id").alias("id"))
    return subset_aliases(t, t).groupBy("a").agg(F.min("b").alias("b"))


@query("jn_company_match", f"""WITH n AS ({_ALIAS}), w AS (SELECT id, list_filter(list_distinct(regexp_extract_all(upper(name), '[A-Z0-9]+')), lambda x: length(x) > 1 AND x <> 'THE') AS t FROM n), h AS (SELECT DISTINCT p_type || ' ' || p_name || ' ' || p_brand AS title FROM part),
ht AS (SELECT title, list_filter(list_distinct(regexp_extract_all(upper(title), '[A-Z0-9]+')), lambda x: length(x) > 1) AS t FROM h)
SELECT id, arg_min(title, abs(len(ht.t) - len(w.t)) || title) AS title FROM w JOIN ht ON CASE WHEN least(len(w.t), len(ht.t)) < 2 THEN list_has_all(w.t, ht.t) AND list_has_all(ht.t, w.t) ELSE list_has_all(w.t, ht.t) OR list_has_all(ht.t, w.t) END GROUP BY id""")
def jn_company_match(spark, d):
    """Company names matched to a register by significant tokens."""
    from casegraph.operators.resolve import match_companies

    p = table(spark, d, "part")
    p.createOrReplaceTempView("part")
    register = p.select(F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("title")).distinct()
    return match_companies(spark.sql(_ALIAS), register).select("id", "title")


@query("jn_first_seen", f"WITH {_AFF} SELECT a, b, CAST(min(CASE WHEN chunk % 4 <> 0 THEN day END) AS VARCHAR) AS first_seen FROM af GROUP BY a, b")
def jn_first_seen(spark, d):
    """First publication day of each edge by its URLs."""
    from casegraph.operators.events import first_seen

    a = affiliations(spark, d)
    known = table(spark, d, "orders").filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("url"), F.to_date("o_orderdate").alias("day"))
    return first_seen(a.select(F.col("a"), F.col("b"), F.col("chunk").alias("url")), known, ["a", "b"]).select("a", "b", F.col("first_seen").cast("string").alias("first_seen"))


@query("jn_active_window", """WITH p AS (SELECT DISTINCT event_type || '-' || date_trunc('hour', ts) AS ev, CAST(ts AS DATE) AS day, user_id AS who FROM events) SELECT x.who AS a, y.who AS b, CAST(min(x.day) AS VARCHAR) AS lo, CAST(max(x.day) AS VARCHAR) AS hi FROM p x JOIN p y ON x.ev = y.ev AND x.who < y.who GROUP BY 1, 2""")
def jn_active_window(spark, d):
    """Span of the events that both ends of a pair took part in."""
    from casegraph.operators.events import active_windows

    p = events(spark, d).select(F.concat_ws("-", "event_type", F.date_trunc("hour", "ts").cast("string")).alias("event"), "day", F.col("actor").alias("who")).distinct()
    return active_windows(p).select("a", "b", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


@query("jn_temporal_edges", """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase') SELECT CASE WHEN date_diff('day', a.day, b.day) > 3 OR abs(date_diff('day', a.day, b.day)) <= 3 THEN a.event_id ELSE b.event_id END AS src, CASE WHEN date_diff('day', a.day, b.day) > 3 OR abs(date_diff('day', a.day, b.day)) <= 3 THEN b.event_id ELSE a.event_id END AS dst,
 CASE WHEN abs(date_diff('day', a.day, b.day)) <= 3 THEN 'event_coincident' ELSE 'event_followed_by' END AS kind, abs(date_diff('day', a.day, b.day)) AS days FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND abs(date_diff('day', a.day, b.day)) <= 60""")
def jn_temporal_edges(spark, d):
    """Edges between purchases of one user, by the days between them."""
    from casegraph.operators.events import temporal_edges

    e = events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("event"), "day", F.col("actor").alias("participant"))
    return temporal_edges(e).select("src", "dst", "kind", F.col("days").cast("long").alias("days"))


@query("jn_participation", """SELECT DISTINCT event_id AS event, 'C' || user_id AS entity FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'view'""")
def jn_participation(spark, d):
    """Edges from events to the customers that take part."""
    from casegraph.operators.events import participation_edges

    keys = table(spark, d, "customer").select(F.upper("c_name").alias("name"), F.concat(F.lit("C"), "c_custkey").alias("canonical"))
    e = events(spark, d).filter("event_type <> 'view'").select(F.col("event_id").alias("event"), F.array(F.concat(F.lit("customer#"), F.lpad(F.col("actor").cast("string"), 9, "0"))).alias("participants"))
    return participation_edges(e, keys)


@query("jn_anti_jobs", "SELECT o_orderkey AS id, 'job' AS kind FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10) UNION ALL SELECT DISTINCT l_orderkey, 'artifact' FROM lineitem WHERE l_quantity > 10")
def jn_anti_jobs(spark, d):
    """Jobs without an artifact, and the artifacts."""
    done = table(spark, d, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("id"))
    return reports.open_jobs(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), done)


@query("jn_metrics", """WITH a AS (SELECT DISTINCT 'S' || l_suppkey AS s, 'P' || l_partkey AS p FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT 'S' || l_suppkey AS s, 'P' || l_partkey AS p FROM lineitem WHERE l_returnflag = 'N'), an AS (SELECT s AS n FROM a UNION SELECT p FROM a), bn AS (SELECT s AS n FROM b UNION SELECT p FROM b)
SELECT (SELECT count(*) FROM a JOIN b ON a.s = b.s AND a.p = b.p) AS same, (SELECT count(*) FROM a WHERE s IN (SELECT n FROM bn) OR p IN (SELECT n FROM bn)) AS touching, (SELECT count(*) FROM an WHERE n IN (SELECT n FROM bn)) AS common_nodes""")
def jn_metrics(spark, d):
    """Edges of one graph that are in another and that touch it, whichever way about, and common nodes."""
    name = lambda p, c: F.concat(F.lit(p), c)
    x = table(spark, d, "lineitem")
    a = x.filter("l_returnflag = 'A'").select(name("S", "l_suppkey").alias("src"), name("P", "l_partkey").alias("dst"))
    b = x.filter("l_returnflag = 'N'").select(name("P", "l_partkey").alias("src"), name("S", "l_suppkey").alias("dst"))
    return reports.graph_overlap(a, b)


@query("agg_token_metrics", """WITH w AS (SELECT item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark), f AS (SELECT id, unnest(w[1:len(w) // 2 + 1]) AS w FROM w), t AS (SELECT id, unnest(w) AS w FROM w), x AS (SELECT id, w, count(*) AS x FROM f GROUP BY 1, 2), y AS (SELECT id, w, count(*) AS y FROM t GROUP BY 1, 2),
s AS (SELECT coalesce(x.id, y.id) AS id, sum(least(coalesce(x, 0), coalesce(y, 0))) AS tp, sum(coalesce(x, 0)) AS nx, sum(coalesce(y, 0)) AS ny FROM x FULL JOIN y ON x.id = y.id AND x.w = y.w GROUP BY 1) SELECT id, round(tp / nx, 6) AS precision_, round(tp / ny, 6) AS recall, round(2 * tp / (nx + ny), 6) AS f1 FROM s""")
def agg_token_metrics(spark, d):
    """Word by word precision and recall of the first half of each benchmark text against the whole."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    half = F.array_join(F.slice(words, 1, F.floor(F.size(words) / 2).cast("int") + 1), " ")
    m = reports.token_metrics(table(spark, d, "benchmark").select(F.col("item_id").alias("id"), half.alias("found"), F.col("text").alias("truth")))
    return m.select("id", *[F.round(c, 6).alias(c) for c in ("precision_", "recall", "f1")])


@query("win_bibliography", "WITH f AS (SELECT source, min(doc_id) AS f, 'u' || min(doc_id) AS url, count(*) AS cited FROM documents GROUP BY source) SELECT row_number() OVER (ORDER BY f, source) AS note, source, url, cited FROM f")
def win_bibliography(spark, d):
    """The bibliography: sources by first citation."""
    return reports.bibliography(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "source", F.concat(F.lit("u"), "doc_id").alias("url")))


@query("top_seed_filled", "WITH k AS (SELECT c_custkey AS id, c_acctbal AS s FROM customer), own AS (SELECT id, s, 0 AS f FROM k WHERE s > (SELECT max(s) - 20 FROM k) ORDER BY s DESC, id LIMIT 40), n AS (SELECT count(*) AS n FROM own), r AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM k WHERE id NOT IN (SELECT id FROM own)) SELECT id FROM own UNION ALL SELECT id FROM r, n WHERE r + n <= 6")
def top_seed_filled(spark, d):
    """Seeds of the key network, filled up to six."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("score"))
    best = c.agg(F.max("score").alias("most"))
    chosen = c.crossJoin(F.broadcast(best)).filter("score > most - 20")  # one row
    return reports.network_seed(chosen, c, 40).select(F.col("node").alias("id"))


@query("win_first_last", "SELECT l_suppkey AS k, arg_min(l_partkey, l_orderkey * 10 + l_linenumber) AS first, arg_max(l_partkey, l_orderkey * 10 + l_linenumber) AS last FROM lineitem GROUP BY 1")
def win_first_last(spark, d):
    """First and last part of each supplier."""
    x = evidence(spark, d).select(F.col("entity").alias("k"), "source", "ord")
    return first_wins(x, ["k"], "ord").select("k", F.col("source").alias("first")).join(last_wins(x, ["k"], "ord").select("k", F.col("source").alias("last")), "k")


@query("win_topk", "SELECT l_suppkey AS entity, l_orderkey * 10 + l_linenumber AS ord FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount * (1 - l_tax) DESC, l_orderkey * 10 + l_linenumber) <= 5")
def win_topk(spark, d):
    """The five strongest pieces of evidence of each supplier."""
    return top_rows(evidence(spark, d), ["entity"], 5, F.desc(F.col("strength") / 10 * F.col("confidence")), "ord").select("entity", "ord")


@query("win_timeline", "SELECT user_id AS entity, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END, CAST(ts AS DATE), event_id) AS place, CAST(min(CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) END) OVER (PARTITION BY user_id) AS VARCHAR) AS first, CAST(max(CASE WHEN event_id % 11 <> 0 THEN CAST(ts AS DATE) END) OVER (PARTITION BY user_id) AS VARCHAR) AS last FROM events")
def win_timeline(spark, d):
    """Timelines with undated entries last."""
    e = events(spark, d).withColumn("day", F.when(F.col("event_id") % 11 != 0, F.col("day")))
    w = Window.partitionBy("actor")
    return e.select(F.col("actor").alias("entity"), "event_id", F.row_number().over(w.orderBy(F.asc_nulls_last("day"), "event_id")).cast("long").alias("place"), F.min("day").over(w).cast("string").alias("first"), F.max("day").over(w).cast("string").alias("last"))


@query("win_round_robin", """WITH s AS (SELECT c_custkey AS id, c_nationkey AS comm, c_acctbal AS score FROM customer), g AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 12), c AS (SELECT comm, max(score) AS best FROM s GROUP BY comm), r AS (SELECT comm, row_number() OVER (ORDER BY best DESC, comm) AS cr FROM c),
l AS (SELECT id, row_number() OVER (PARTITION BY s.comm ORDER BY score DESC, id) AS lap, cr FROM s JOIN r ON r.comm = s.comm WHERE id NOT IN (SELECT id FROM g)) SELECT id, 'top' AS how FROM g UNION ALL SELECT id, 'lap' FROM (SELECT id FROM l ORDER BY lap, cr LIMIT 13)""")
def win_round_robin(spark, d):
    """Half of a sample by score, half in turns over the communities."""
    from casegraph.operators.graph import balanced_sample

    s = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"), F.col("c_acctbal").alias("score"))
    return balanced_sample(s, 25)


@query("win_footnotes", "WITH f AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY source) SELECT source, row_number() OVER (ORDER BY f) AS note FROM f")
def win_footnotes(spark, d):
    """Footnote numbers of sources by first citation."""
    first = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("f"))
    return first.select("source", F.dense_rank().over(Window.orderBy("f")).cast("long").alias("note"))


@query("win_decay", "SELECT event_id, round(coalesce(pow(0.5, CAST(abs(date_diff('day', CAST(ts AS DATE), DATE '2024-02-15')) AS DOUBLE) / 30), 0.5), 6) AS w FROM events")
def win_decay(spark, d):
    """Recency weights of events on a day."""
    return events(spark, d).select("event_id", F.round(dates.recency_decay(F.col("day"), F.lit("2024-02-15").cast("date")), 6).alias("w"))


@query("top_page", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def top_page(spark, d):
    """The third page of orders by price, with the total."""
    o = table(spark, d, "orders")
    return page(o, 3, 50, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").crossJoin(o.agg(F.count("*").alias("total")))  # one row


@query("top_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || p_brand || p_type), 'ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 500")
def top_search(spark, d):
    """A search over all columns of a record, by price."""
    return reports.searched(table(spark, d, "part"), "Ring", ["p_name", "p_brand", "p_type"], F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_name")


@query("set_runs", """WITH a AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_returnflag)) AS r FROM lineitem WHERE l_quantity > 49 GROUP BY 1), b AS (SELECT l_suppkey AS k, list_sort(list(DISTINCT l_linestatus)) AS r FROM lineitem WHERE l_quantity < 2 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, nullif(array_to_string(list_distinct(list_concat(coalesce(a.r, []), coalesce(b.r, []))).list_sort(), ','), '') AS runs, len(list_intersect(coalesce(a.r, []), coalesce(b.r, []))) AS common FROM a FULL JOIN b ON a.k = b.k""")
def set_runs(spark, d):
    """Unions and intersections of run labels."""
    x = table(spark, d, "lineitem")
    a = x.filter("l_quantity > 49").groupBy(F.col("l_suppkey").alias("k")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("a"))
    b = x.filter("l_quantity < 2").groupBy(F.col("l_suppkey").alias("k")).agg(F.array_sort(F.collect_set("l_linestatus")).alias("b"))
    j = a.join(b, "k", "full")
    empty = F.array().cast("array<string>")
    return j.select("k", F.array_join(F.array_sort(merged(F.col("a"), F.col("b"))), ",").alias("runs"), F.size(F.array_intersect(F.coalesce("a", empty), F.coalesce("b", empty))).cast("long").alias("common"))


@query("set_ids", "SELECT 'both' AS side, count(*) AS n FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'left', count(*) FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'all', count(*) FROM (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def set_ids(spark, d):
    """Intersection, difference and union of two edge sets."""
    x = table(spark, d, "lineitem")
    a, b = (x.filter(F.col("l_returnflag") == f).select("l_suppkey", "l_partkey") for f in "AR")
    counted = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return counted(a.intersect(b), "both").union(counted(a.distinct().subtract(b), "left")).union(counted(a.union(b).distinct(), "all"))
