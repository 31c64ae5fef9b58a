"""Queries of nested records, cascades, roots, stores of events and the network section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions import labels, records
from casegraph.functions import text as texts
from casegraph.functions.names import name_tokens
from casegraph.operators import cascade, cep, network, roots
from casegraph.operators.graph import settled
from casegraph.operators.resolve import similar_aliases
from casegraph.plans.register import register
from casegraph.sources import ingest, stores
from casegraph.sources.tables import articles, events, table

QUERIES, SQL, query = register()

_RECORD = "'{\"id\": ' || o_orderkey || ', \"o\": {\"status\": \"' || o_orderstatus || '\", \"none\": null, \"list\": []}, \"tags\": [\"' || o_orderpriority || '\", \"\"], \"empty\": \"\"}'"


def _orders(spark, d) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, {_RECORD} AS record FROM orders")


@query("fn_flatten", """SELECT o_orderkey, 'id=' || o_orderkey || ';o.status=' || o_orderstatus || ';tags=["' || o_orderpriority || '", ""]' AS leaves, o_orderstatus AS status, '{"id": ' || o_orderkey || ', "o": {"status": "' || o_orderstatus || '"}, "tags": ["' || o_orderpriority || '"]}' AS full_record FROM orders""")
def fn_flatten(spark, d):
    """Nested records flattened, searched and without empty fields."""
    r = F.col("record")
    leaves = F.array_join(F.array_sort(F.transform(F.map_entries(records.flattened(r)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return _orders(spark, d).select("o_orderkey", leaves.alias("leaves"), records.found_value(r, "status").alias("status"), records.without_empty(r).alias("full_record"))


@query("fn_cut", """WITH r AS (SELECT o_orderkey, CAST(o_orderkey % 40 AS INT) AS n, CAST(o_custkey % 150 AS INT) AS m FROM orders)
SELECT o_orderkey, '{' || array_to_string(list_filter(['"id": ' || o_orderkey, CASE WHEN 2 * n <= 40 THEN '"text": "' || repeat('<b>x</b>%41', n) || '"' END, CASE WHEN m <= 40 THEN '"query": "' || repeat('q', m) || '"' END], lambda x: x IS NOT NULL), ', ') || '}' AS kept FROM r""")
def fn_cut(spark, d):
    """Records without texts that are long once they are decoded and free of tags."""
    n, m = (F.col("o_orderkey") % 40).cast("int"), (F.col("o_custkey") % 150).cast("int")
    text = F.repeat(F.lit("<b>x</b>%41"), n)
    record = F.concat(F.lit('{"id": '), "o_orderkey", F.lit(', "text": "'), text, F.lit('", "query": "'), F.repeat(F.lit("q"), m), F.lit('", "response_text": "raw", "o": {"response_text": "raw"}}'))
    return table(spark, d, "orders").select("o_orderkey", records.without_long_texts(record, 40).alias("kept"))



@query("fn_preprocess", """SELECT o_orderkey, '{"id": ' || o_orderkey || ', "o": {"status": "' || o_orderstatus || '", "none": null, "list": []}, "tags": ["' || o_orderpriority || '", ""], "empty": ""}' AS record, true AS ok, false AS not_ok FROM orders""")
def fn_preprocess(spark, d):
    """Records on one line, and what is JSON."""
    r = F.col("record")
    return _orders(spark, d).select("o_orderkey", records.preprocessed(F.replace(r, F.lit(", "), F.lit(",\n\t"))).alias("record"), records.is_json(r).alias("ok"), records.is_json(F.concat(r, F.lit("}"))).alias("not_ok"))


@query("src_json_chunks")
def src_json_chunks(spark, d):
    """Conversations as records in pieces of 500 characters that keep their structure."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    record = F.to_json(F.struct("conv_id", "turns"))
    return turns.select("conv_id", F.posexplode(records.json_chunks(record, 500)).alias("piece", "chunk"))


@query("fn_claims", """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Evidence through affiliations A->B.' || chr(10) || o_orderpriority WHEN 1 THEN '  ' || o_orderpriority || ' ' END AS reasoning, o_orderstatus AS q, o_orderkey % 2 = 0 AS quoted FROM orders)
SELECT o_orderkey, trim(coalesce(trim(regexp_replace(reasoning, '^Evidence through affiliations[^\\n]*\\n', '')), '') || CASE WHEN quoted THEN ' ' || q ELSE '' END) AS claim, trim(regexp_replace(coalesce(reasoning, ''), '\\s+', ' ', 'g'))[1:12] || CASE WHEN length(trim(regexp_replace(coalesce(reasoning, ''), '\\s+', ' ', 'g'))) > 13 THEN '…' ELSE trim(regexp_replace(coalesce(reasoning, ''), '\\s+', ' ', 'g'))[13:13] END AS short FROM r""")
def fn_claims(spark, d):
    """What evidence says, without the line that routed it, and cut to a width."""
    k = F.col("o_orderkey") % 3
    reasoning = F.when(k == 0, F.concat(F.lit("Evidence through affiliations A->B.\n"), "o_orderpriority")).when(k == 1, F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")))
    quotes = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", records.claim_text(reasoning, quotes).alias("claim"), records.trimmed(reasoning, 13).alias("short"))


@query("fn_source_keys", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'doc-' || o_custkey WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN 'https://x/' || o_orderkey END AS key, least('C' || o_custkey, 'C' || o_orderkey % 1500) || chr(9) || greatest('C' || o_custkey, 'C' || o_orderkey % 1500) AS pair FROM orders")
def fn_source_keys(spark, d):
    """What a piece of evidence counts as a source, and the key of an unordered pair."""
    from casegraph.operators.evidence import source_key
    from casegraph.operators.pairs import pair_key

    k = F.col("o_orderkey") % 4
    doc, source, link = F.when(k == 0, F.concat(F.lit(" Doc-"), "o_custkey")).otherwise(" "), F.when(k < 2, F.col("o_orderpriority")).otherwise(""), F.when(k < 3, F.concat(F.lit("https://x/"), "o_orderkey"))
    a, b = F.concat(F.lit("C"), "o_custkey"), F.concat(F.lit("C"), F.col("o_orderkey") % 1500)
    return table(spark, d, "orders").select("o_orderkey", source_key(doc, source, link).alias("key"), pair_key(b, a).alias("pair"))


@query("fn_coerced", """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN 'many' END AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(n AS DOUBLE) ELSE 0.0 END AS number, CASE WHEN s IS NULL THEN 0 ELSE 1 END AS items, coalesce(s, 'UNKNOWN') AS kind, 'A ' || o_orderkey AS norm FROM r""")
def fn_coerced(spark, d):
    """Values coerced to numbers, lists, first items and normal texts."""
    from casegraph.functions.names import first_of

    n = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice").cast("string")).when(F.col("o_orderkey") % 3 == 1, "many")
    s = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    norm = records.norm_text(F.concat(F.lit(" a \t "), "o_orderkey", F.lit(" ")))
    return table(spark, d, "orders").select("o_orderkey", records.as_number(n).alias("number"), F.size(records.as_list(s)).alias("items"), first_of(records.as_list(s)).alias("kind"), norm.alias("norm"))


@query("fn_event_fields", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN event_type ELSE '' END AS kind, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') || ',' || strftime(ts, '%Y-%m') ELSE '' END AS dates, 'A, U' || user_id AS who FROM events""")
def fn_event_fields(spark, d):
    """Type, dates and participants of event records in their several shapes."""
    day, month = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM")
    k = F.col("event_id") % 3
    one = F.concat(F.lit('{"event_type": "'), F.upper("event_type"), F.lit('", "date": "'), day, F.lit('"}'))
    many = F.concat(F.lit('{"event_type": ["'), "event_type", F.lit('", "x"], "date": ["'), day, F.lit('", "'), month, F.lit('", ""]}'))
    data = F.when(k == 0, one).when(k == 1, many).otherwise("{}")
    who = F.array(*[F.struct(n.alias("name"), F.lit("r").alias("role")) for n in (F.concat(F.lit("u"), "user_id"), F.lit(" a "), F.lit(None).cast("string"), F.lit("A"))])
    return table(spark, d, "events").select("event_id", records.event_type(data).alias("kind"), F.array_join(records.event_dates(data), ",").alias("dates"), F.array_join(records.participant_names(who), ", ").alias("who"))


@query("fn_labels", """WITH r AS (SELECT o_orderkey, o_totalprice / 600000 AS p, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS day, 'run_' || lower(o_orderstatus) || '-' || o_orderkey % 9 AS run FROM orders)
SELECT o_orderkey, o_orderkey % 2 = 0 AS valid, 'Run ' || upper(substr(run, 5, 1)) || ' ' || o_orderkey % 9 AS run, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN p >= 0.8 THEN '#b91c1c' WHEN p >= 0.5 THEN '#f59e0b' ELSE '#64748b' END AS colour, 'a\\|' || run || ' b' AS cell FROM r""")
def fn_labels(spark, d):
    """Valid dates, run names, confidence levels and colours."""
    p = F.col("o_totalprice") / 600000
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM"))
    run = F.concat(F.lit("run_"), F.lower("o_orderstatus"), F.lit("-"), F.col("o_orderkey") % 9)
    return table(spark, d, "orders").select("o_orderkey", labels.valid_date(day).alias("valid"), labels.run_name(run).alias("run"), labels.level(p).alias("level"), labels.level_colour(p).alias("colour"), texts.markdown_escaped(F.concat(F.lit("a|"), run, F.lit("\nb"))).alias("cell"))



@query("flt_cascade", """WITH p AS (SELECT DISTINCT p_brand AS publisher FROM part WHERE p_partkey % 5 = 0), n AS (SELECT DISTINCT p_brand || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || p_size END AS node FROM part),
nt AS (SELECT node, list_distinct(regexp_extract_all(upper(node), '[A-Z0-9]+')) AS t FROM n), pt AS (SELECT publisher, list_distinct(regexp_extract_all(upper(publisher), '[A-Z0-9]+')) AS t FROM p), gone AS (SELECT DISTINCT node FROM nt JOIN pt ON upper(node) = upper(publisher) OR (list_has_all(nt.t, pt.t) AND len(pt.t) >= 2) OR (list_has_all(pt.t, nt.t) AND len(nt.t) >= 2)), e AS (SELECT DISTINCT p_brand AS src, p_brand || ' ' || p_size AS dst FROM part), t AS (SELECT p_type AS id, list(DISTINCT p_brand) AS members FROM part GROUP BY 1)
SELECT 'nodes' AS "table", count(*) AS before, count(*) FILTER (node NOT IN (SELECT node FROM gone)) AS after FROM n
UNION ALL SELECT 'edges', count(*), count(*) FILTER (src NOT IN (SELECT node FROM gone) AND dst NOT IN (SELECT node FROM gone)) FROM e
UNION ALL SELECT 'themes', count(*), count(*) FILTER (NOT list_has_any(members, (SELECT list(node) FROM gone))) FROM t""")
def flt_cascade(spark, d):
    """Nodes that name publishers, and the edges and themes that go with them."""
    p = table(spark, d, "part")
    both = F.concat_ws(" ", "p_brand", F.col("p_size").cast("string"))
    tables = {
        "nodes": p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(both).alias("node")).distinct(),
        "edges": p.select(F.col("p_brand").alias("src"), both.alias("dst")).distinct(),
        "themes": p.groupBy(F.col("p_type").alias("id")).agg(F.collect_set("p_brand").alias("members")),
    }
    return cascade.publisher_cascade(tables, p.filter("p_partkey % 5 = 0").select(F.col("p_brand").alias("publisher")).distinct())[1]


@query("flt_repaired", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN p_name WHEN p_partkey % 4 = 3 THEN p_brand || ' KILLED ' || p_name ELSE p_brand || CASE WHEN p_partkey % 4 = 2 THEN ' STRUCK' ELSE '' END END AS node, p_partkey % 4 = 1 AS repaired FROM part""")
def flt_repaired(spark, d):
    """Records whose id is a headline, under their best label."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_brand")).when(k == 2, F.concat("p_brand", F.lit(" STRUCK"))).otherwise(F.concat("p_brand", F.lit(" KILLED "), "p_name"))
    labels_of = F.when(k == 1, F.array(F.concat("p_name", F.lit(" ARRESTED")), F.col("p_name"))).otherwise(F.array(F.lit("SEIZED IT")))
    rows = table(spark, d, "part").select("p_partkey", name.alias("node"), (k == 3).alias("is_event"), labels_of.alias("labels"))
    return cascade.repaired_ids(rows).select("p_partkey", "node", "repaired")


@query("flt_eligible", """WITH n AS (SELECT 'C' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN ' KILLED' ELSE '' END AS node, c_custkey % 5 = 0 AS is_event, c_mktsegment AS run, c_custkey FROM customer) SELECT node FROM n WHERE NOT is_event AND c_custkey % 7 <> 0 AND run = 'BUILDING' AND c_custkey <> 1 AND c_custkey % 11 <> 0""")
def flt_eligible(spark, d):
    """Nodes that a second stage may ask about."""
    c = table(spark, d, "customer")
    name = F.concat(F.lit("C"), "c_custkey", F.when(F.col("c_custkey") % 7 == 0, " KILLED").otherwise(""))
    nodes = c.select(name.alias("node"), (F.col("c_custkey") % 5 == 0).alias("is_event"), F.array("c_mktsegment").alias("runs"))
    publishers = c.filter("c_custkey % 11 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("publisher"))
    return cascade.eligible(nodes, publishers, ["C1"], "BUILDING").select("node")


@query("gr_store_edges", """SELECT CASE WHEN o_custkey % 3 = 0 THEN 'G' || o_custkey % 100 ELSE 'C' || o_custkey END AS src, 'O' || o_orderkey AS dst, CASE WHEN o_orderkey % 2 = 0 THEN CAST(2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight, CASE o_orderkey % 3 WHEN 0 THEN 'client — ctx' WHEN 1 THEN 'client — ' || o_orderstatus ELSE o_orderstatus END AS description,
 o_orderstatus || CASE WHEN o_orderkey % 3 < 2 THEN ', client' ELSE '' END AS keywords FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 7 <> 0""")
def gr_store_edges(spark, d):
    """Relations that the cumulative store takes over."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_orderkey") % 3
    e = o.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("O"), "o_orderkey").alias("dst"), F.when(F.col("o_orderpriority") == "5-LOW", "evidence").otherwise("affiliation").alias("kind"), F.col("o_orderstatus").alias("rel_type"), F.when(k == 0, "ctx").otherwise("unknown").alias("context"), F.when(k < 2, "client").alias("role"), F.when(F.col("o_orderkey") % 2 == 0, 2.0).alias("weight"))
    n = o.select(F.concat(F.lit("O"), "o_orderkey").alias("node"), (F.col("o_orderkey") % 7 == 0).alias("is_event"))
    mapping = c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("name"), F.concat(F.lit("G"), F.col("c_custkey") % 100).alias("canonical"))
    return cascade.store_edges(e, n, mapping)


@query("jn_roots", """WITH s AS (SELECT p_partkey AS subject_id, 'who owns ' || p_name || ' ' || p_partkey % 50 AS subject FROM part), e AS (SELECT min(p_partkey) AS ord, upper(p_brand || ' ' || p_name) AS canonical, upper(p_name) AS name FROM part GROUP BY p_brand, p_name), g AS (SELECT DISTINCT upper(p_brand || ' ' || p_name) AS node FROM part WHERE p_partkey % 3 = 0),
m AS (SELECT subject, ord, canonical, g.node IS NULL AS outside FROM (SELECT DISTINCT subject FROM s) s JOIN e ON contains(' ' || upper(subject) || ' ', ' ' || name || ' ') LEFT JOIN g ON g.node = canonical), r AS (SELECT subject, arg_min(canonical, (outside, ord, canonical)) AS root FROM m GROUP BY subject)
SELECT subject, root FROM r""")
def jn_roots(spark, d):
    """The entity that each subject names."""
    p = table(spark, d, "part")
    subjects = p.select(F.concat(F.lit("who owns "), "p_name", F.lit(" "), F.col("p_partkey") % 50).alias("subject")).distinct()
    entities = p.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("ord")).select("ord", F.concat_ws(" ", "p_brand", "p_name").alias("canonical"), F.array("p_name").alias("names"), F.lit(False).alias("is_event"))
    graph_nodes = p.filter("p_partkey % 3 = 0").select(F.upper(F.concat_ws(" ", "p_brand", "p_name")).alias("node")).distinct()
    none = entities.select("ord", "canonical", "names").limit(0)
    return roots.match_roots(subjects, entities, none, graph_nodes)


@query("gr_root_fallback", """WITH g AS (SELECT 'C' || o_custkey AS node, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT node FROM g WHERE n > 1 ORDER BY n DESC, node LIMIT 1) SELECT 'C' || c_custkey AS subject, CASE WHEN c_custkey % 4 = 0 THEN 'C' || c_custkey ELSE (SELECT node FROM b) END AS root FROM customer""")
def gr_root_fallback(spark, d):
    """The most connected node where no entity is named."""
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("subject"), "c_custkey")
    known = c.filter("c_custkey % 4 = 0").select("subject", F.col("subject").alias("root"))
    degrees = table(spark, d, "orders").groupBy(F.concat(F.lit("C"), "o_custkey").alias("node")).agg(F.count("*").alias("degree"))
    return roots.roots_or_most_connected(c, known, degrees)


@query("agg_events", """WITH r AS (SELECT o_custkey AS event, o_orderkey AS ord, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS day, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'https://x/' || o_orderkey ELSE 'note' END AS url, o_orderstatus AS run FROM orders)
SELECT event, array_to_string(list_sort(list(DISTINCT day) FILTER (day <> '')), ',') AS dates, coalesce(arg_min(kind, ord) FILTER (kind <> ''), '') AS kind, array_to_string(list_sort(list(DISTINCT url) FILTER (starts_with(url, 'http'))), ',') AS sources, array_to_string(list_sort(list(DISTINCT run)), ',') AS runs FROM r GROUP BY event""")
def agg_events(spark, d):
    """The store's events, merged over investigations."""
    day = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("")
    kind = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("")
    url = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("https://x/"), "o_orderkey")).otherwise("note")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("ord"), day.alias("date"), kind.alias("kind"), F.lit("").alias("description"), F.lit(None).cast("string").alias("location"), url.alias("url"), F.array("o_orderstatus").alias("participants"), F.array("o_orderstatus").alias("runs"), F.lit("i").alias("investigation"))
    joined = lambda c: F.coalesce(F.nullif(F.array_join(c, ","), F.lit("")), F.lit(None)).alias(c)
    return roots.merged_events(rows).select("event", joined("dates"), "kind", joined("sources"), joined("runs"))


@query("agg_orderings", "SELECT DISTINCT o_orderstatus AS type, 'C' || o_custkey AS src, 'C' || o_orderkey % 50 AS dst FROM orders")
def agg_orderings(spark, d):
    """Ordering edges of events, once each."""
    return roots.distinct_orderings(table(spark, d, "orders").select(F.col("o_orderstatus").alias("type"), F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("C"), F.col("o_orderkey") % 50).alias("dst")))


@query("prj_events", """SELECT 'E' || event_id AS event, CASE WHEN event_id % 4 > 0 THEN strftime(ts, '%Y-%m-%d') END AS day, event_type, array_to_string(list_sort(list_distinct(list_filter(['U' || user_id, CASE WHEN event_id % 3 = 0 THEN 'P' || user_id % 7 END], lambda x: x IS NOT NULL))), ',') AS who FROM events WHERE event_id % 5 <> 0""")
def prj_events(spark, d):
    """A day's graph as events for patterns."""
    e = table(spark, d, "events")
    name = F.concat(F.lit("E"), "event_id")
    days = F.when(F.col("event_id") % 4 > 0, F.array(F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy"))).otherwise(F.array(F.date_format("ts", "yyyy-MM")))
    none = F.array().cast("array<string>")
    nodes = e.select(name.alias("node"), (F.col("event_id") % 5 != 0).alias("is_event"), days.alias("date"), "event_type", F.lit("").alias("description"), F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("P"), F.col("user_id") % 7))).otherwise(none).alias("participants"))
    edges = e.select(name.alias("src"), F.concat(F.lit("U"), "user_id").alias("dst"), F.lit("event_participation").alias("type"))
    return roots.events_of_graph(nodes, edges).select("event", F.col("day").cast("string").alias("day"), "event_type", F.array_join("participants", ",").alias("who"))


#: Users are neighbours of the next one, and user 0 of so many that it is a hub.
_LINKED = """WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS d FROM events), ed AS (SELECT DISTINCT user_id AS s, user_id + 1 AS t FROM e UNION SELECT DISTINCT CAST(0 AS BIGINT), user_id FROM e WHERE user_id BETWEEN 2 AND 60), b AS (SELECT s, t FROM ed UNION SELECT t, s FROM ed), hub AS (SELECT s FROM b GROUP BY s HAVING count(*) > 25),
m AS (SELECT a.event_id AS e1, z.event_id AS e2, a.user_id AS u, z.user_id AS v, date_diff('day', a.d, z.d) AS days, z.d AS last FROM e a JOIN e z ON a.event_type = 'signup' AND contains(lower(z.event_type || ' ' || z.event_id), 'purch') AND a.event_id <> z.event_id AND date_diff('day', a.d, z.d) BETWEEN 0 AND 2 AND (a.user_id = z.user_id OR EXISTS (SELECT 1 FROM b WHERE b.s = a.user_id AND b.t = z.user_id)) WHERE a.user_id NOT IN (SELECT s FROM hub) AND z.user_id NOT IN (SELECT s FROM hub))"""
_RULE = {"name": "signup, then a neighbour buys", "windowDays": 2, "severity": "high", "steps": [{"types": ["Signup"]}, {"keywords": ["PURCH"]}]}


def _linked(spark, d) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    rows = e.select(F.col("event_id").alias("event"), "day", F.lit("").alias("event_type"), F.col("event_type").alias("text"), F.array(F.col("actor").cast("string")).alias("participants"))
    rows = rows.withColumn("event_type", F.when(F.col("text") == "signup", "signup").otherwise(""))
    u = F.col("actor")
    edges = e.select(u.cast("string").alias("src"), (u + 1).cast("string").alias("dst")).union(e.filter("actor between 2 and 60").select(F.lit("0"), u.cast("string"))).distinct()
    return rows, edges


@query("cep_linked", f"{_LINKED} SELECT e1, e2, days, array_to_string(list_sort(list_distinct([CAST(u AS VARCHAR), CAST(v AS VARCHAR)])), ',') AS bridges FROM m")
def cep_linked(spark, d):
    """Chains by keyword, through neighbours, without hubs."""
    rows, edges = _linked(spark, d)
    found = cep.match_rule(rows, _RULE, edges)
    return found.select(F.col("chain")[0].alias("e1"), F.col("chain")[1].alias("e2"), F.col("days").cast("long").alias("days"), F.array_join("bridges", ",").alias("bridges"))


@query("top_matches", f"{_LINKED} SELECT e1, e2, strftime(last, '%Y-%m-%d') AS last FROM m ORDER BY m.last DESC, e1, e2 LIMIT 200")
def top_matches(spark, d):
    """The two hundred most recent matches."""
    rows, edges = _linked(spark, d)
    shown = cep.latest(cep.match_rules(rows, [_RULE], edges))
    return shown.select(F.col("chain")[0].alias("e1"), F.col("chain")[1].alias("e2"), F.col("last").cast("string").alias("last"))


@query("str_scan", f"{_LINKED}, w AS (SELECT * FROM m WHERE (u IN (3, 5, 8, 13, 21, 34) OR v IN (3, 5, 8, 13, 21, 34)) AND last >= (SELECT max(d) FROM e) - INTERVAL 10 DAY) SELECT e2 AS final, count(*) - 1 AS alternates FROM w GROUP BY e2")
def str_scan(spark, d):
    """Recent stories that a watched user has part in."""
    rows, edges = _linked(spark, d)
    today = rows.agg(F.max("day")).first()[0]
    since = str(spark.range(1).select(F.date_sub(F.lit(today), 10)).first()[0])
    found = cep.match_rules(rows, [_RULE], edges, watched=["3", "5", "8", "13", "21", "34"], since=since)
    return cep.collapsed(found).select("final", "alternates")


_NAMED = """SELECT p_partkey AS id, p_name || ' ' || p_size || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_brand WHEN 1 THEN '' ELSE ' ' || p_type END AS name FROM part"""


@query("jn_similar_alias", f"""WITH n AS ({_NAMED}), k AS (SELECT id, list_sort(list_filter(list_distinct(regexp_extract_all(replace(upper(name), '.', ''), '[A-Z0-9]+')), lambda x: x NOT IN ('THE', 'A', 'AN', 'OF', 'FOR', 'AND', 'TO', 'IN', 'ON'))) AS t, [CAST(id % 7 + 1 AS DOUBLE), CAST(id % 5 AS DOUBLE), 1.0] AS v FROM n),
x AS (SELECT * FROM k WHERE id % 2 = 0), y AS (SELECT * FROM k WHERE id % 2 = 1), f AS (SELECT x.id AS a, min(y.id) AS b FROM x JOIN y ON least(len(x.t), len(y.t)) >= 2 AND (list_has_all(y.t, x.t) OR list_has_all(x.t, y.t)) GROUP BY 1),
s AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 9) AS sim FROM x JOIN y ON len(list_intersect(x.t, y.t)) >= 0.5 * len(list_distinct(list_concat(x.t, y.t))) AND list_cosine_similarity(x.v, y.v) >= 0.9 WHERE x.id NOT IN (SELECT a FROM f)), g AS (SELECT a, max(sim) AS best FROM s GROUP BY a)
SELECT a, b FROM f UNION ALL SELECT s.a, min(s.b) FROM s JOIN g ON g.a = s.a AND s.sim = g.best GROUP BY s.a""")
def jn_similar_alias(spark, d):
    """Names that are aliases by tokens, or by vector and tokens."""
    table(spark, d, "part").createOrReplaceTempView("part")
    vector = F.array((F.col("id") % 7 + 1).cast("double"), (F.col("id") % 5).cast("double"), F.lit(1.0))
    k = spark.sql(_NAMED).select("id", name_tokens(F.col("name")).alias("tokens"), vector.alias("vector"))
    return similar_aliases(k.filter("id % 2 = 0"), k.filter("id % 2 = 1"))


def _themes(spark, d):
    from casegraph.plans.graph_queries import gr_themes

    found = settled(gr_themes(spark, d))  # read several times, inferred once
    nodes = found.filter("kind = 'belief'").select(F.col("members")[0].alias("node")).distinct()
    runs = nodes.select("node", F.explode(F.when(F.crc32("node") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.crc32("node") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))).alias("run"))
    return found, runs


@query("gr_theme_rows")
def gr_theme_rows(spark, d):
    """Themes with their mean belief and the runs they span."""
    return network.theme_rows(*_themes(spark, d))


@query("gr_promoted")
def gr_promoted(spark, d):
    """Nodes that their place in the network raises, with the reason."""
    return network.promoted_nodes(_themes(spark, d)[0])


@query("gr_hypotheses")
def gr_hypotheses(spark, d):
    """Pairs that no source names together, of most joint confidence."""
    return network.hypothesis_rows(*_themes(spark, d))


@query("src_titles", "SELECT doc_id AS ord, lang AS run, trim(string_split(text, chr(10))[1]) AS title FROM documents WHERE trim(coalesce(string_split(text, chr(10))[1], '')) <> ''")
def src_titles(spark, d):
    """Titles alone, without reading bodies further."""
    return ingest.titles(articles(spark, d)).select("ord", "run", "title")


@query("src_properties", "SELECT c_custkey, 'address: ' || c_nationkey || chr(10) || 'name: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'topics: ' || c_mktsegment || ', x' ELSE '' END AS text FROM customer")
def src_properties(spark, d):
    """Properties of sanctioned entities as text."""
    c = table(spark, d, "customer")
    name, address = F.array("c_name"), F.array(F.col("c_nationkey").cast("string"))
    topics = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit(""), F.lit("x")))
    return c.select("c_custkey", ingest.property_text(F.create_map(F.lit("name"), name, F.lit("address"), address, F.lit("topics"), topics)).alias("text"))


@query("src_migrated", "SELECT o_custkey AS session_id, max(o_orderkey) AS ord FROM orders GROUP BY 1")
def src_migrated(spark, d):
    """Sessions of a legacy store taken over by an empty one, the last record of each."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("ord"))
    return stores.migrated(o, o.limit(0))


@query("src_sessions", "SELECT CAST(o_custkey AS VARCHAR) AS session_id, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderkey) ELSE min(o_orderkey) END AS ord, o_custkey % 2 = 0 AS changed FROM orders GROUP BY o_custkey")
def src_sessions(spark, d):
    """Sessions added once and then changed, the last change counting."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderkey").alias("ord"), "o_custkey")
    first = o.groupBy("session_id").agg(F.min("ord").alias("ord")).withColumn("changed", F.lit(False))
    store = stores.added(first.limit(0), first)
    changes = o.filter("o_custkey % 2 = 0").select("session_id", "ord", F.lit(True).alias("changed"))
    strangers = o.select(F.concat(F.lit("x"), "session_id").alias("session_id"), "ord", F.lit(True).alias("changed"))
    return stores.updated(stores.added(store, first.withColumn("ord", F.lit(-1).cast("long"))), changes.union(strangers))


@query("src_jobs", "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'failed' END AS state, CASE WHEN o_orderstatus <> 'F' THEN 'interrupted' END AS error, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_of_key FROM orders")
def src_jobs(spark, d):
    """Jobs after a restart, and the job that each key has."""
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    jobs = stores.recovered(o.select(F.col("o_orderkey").alias("id"), state.alias("state"), F.lit(None).cast("string").alias("error"), F.col("o_custkey").alias("key")))
    half = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"))
    firsts = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("id"))
    known = half.join(firsts, (half["key"] == firsts["o_custkey"]) & (half["id"] == firsts["id"]), "left_semi")
    taken = stores.accepted(o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord")), known)
    return jobs.join(taken.select("key", F.col("id").alias("first_of_key")), "key").select("id", "state", "error", "first_of_key")


@query("src_backlog", "SELECT event_type AS stage, event_id AS done, CAST(10000 AS BIGINT) AS total FROM events WHERE event_id % 3 = 0 AND event_id > 100")
def src_backlog(spark, d):
    """Progress that a reader has missed."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "event_type", F.lit("] "), "event_id", F.lit("/10000"))).otherwise("noise")
    return stores.backlog(table(spark, d, "events").select(F.col("event_id").alias("no"), line.alias("line")), 100)


@query("src_review", f"""WITH n AS ({_NAMED}), k AS (SELECT DISTINCT upper(name) AS name, id % 2 AS half, list_sort(list_filter(list_distinct(regexp_extract_all(replace(upper(name), '.', ''), '[A-Z0-9]+')), lambda x: x NOT IN ('THE', 'A', 'AN', 'OF', 'FOR', 'AND', 'TO', 'IN', 'ON'))) AS t FROM n),
x AS (SELECT DISTINCT name, t FROM k WHERE half = 0 AND name NOT IN (SELECT name FROM k WHERE half = 1)), y AS (SELECT DISTINCT name, t FROM k WHERE half = 1) SELECT DISTINCT x.name, y.name AS canonical FROM x JOIN y ON len(x.t) <> len(y.t) AND least(len(x.t), len(y.t)) >= 2 AND (list_has_all(x.t, y.t) OR list_has_all(y.t, x.t))""")
def src_review(spark, d):
    """Names for a person to look at before they are merged."""
    table(spark, d, "part").createOrReplaceTempView("part")
    n = spark.sql(_NAMED)
    known = n.filter("id % 2 = 1").select(F.upper("name").alias("alias"), F.upper("name").alias("canonical")).distinct()
    return stores.review_rows(n.filter("id % 2 = 0"), known)


@query("src_connectors", """SELECT 'q' || c_nationkey AS query, 'encyclopedia' AS provenance, c_name AS title, 'https://wiki.example/' || c_custkey AS url, 'wiki.example' AS publisher, c_mktsegment AS text, '' AS published FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'q' || s_nationkey, 'news_index', s_name, 'https://www.news.example/' || s_suppkey, 'news.example', '', '2024-05-15' FROM supplier
UNION ALL SELECT 'q' || p_size, 'web_search', p_name, 'https://www.shop.example/' || p_partkey, 'shop.example', p_type, '' FROM part
UNION ALL SELECT 'q' || c_nationkey, 'sanctions', c_name, 'sanctions:' || c_custkey, 'sanctions list', 'country: ' || c_nationkey || chr(10) || 'topics: ' || c_mktsegment, '' FROM customer""")
def src_connectors(spark, d):
    """Answers of four services as articles."""
    from casegraph.sources import connectors

    c, s, p = (table(spark, d, t) for t in ("customer", "supplier", "part"))
    page = F.struct(F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("extract"), F.concat(F.lit("https://wiki.example/"), "c_custkey").alias("fullurl"))
    said = lambda df, key, inner: df.groupBy(F.concat(F.lit("q"), key).alias("query")).agg(inner.alias("response"))
    wiki = said(c, "c_nationkey", F.to_json(F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("k"), page.alias("v")))).alias("pages")).alias("query"))))
    news = said(s, "s_nationkey", F.to_json(F.struct(F.collect_list(F.struct(F.concat(F.lit("https://www.news.example/"), "s_suppkey").alias("url"), F.col("s_name").alias("title"), F.lit("20240515T120000Z").alias("seendate"), F.lit("news.example").alias("domain"))).alias("articles"))))
    web = said(p, "p_size", F.to_json(F.struct(F.collect_list(F.struct(F.col("p_name").alias("title"), F.concat(F.lit("https://www.shop.example/"), "p_partkey").alias("link"), F.col("p_type").alias("snippet"))).alias("items"))))
    facts = F.create_map(F.lit("topics"), F.array("c_mktsegment"), F.lit("country"), F.array(F.col("c_nationkey").cast("string")))
    listed = said(c, "c_nationkey", F.to_json(F.struct(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("caption"), facts.alias("properties"))).alias("results"))))
    parts = [connectors.encyclopedia(wiki), connectors.news_index(news), connectors.web_search(web), connectors.sanctions(listed)]
    names = ["query", "provenance", "title", "url", "publisher", "text", "published"]
    out = parts[0].select(*names)
    for x in parts[1:]:
        out = out.union(x.select(*names))
    return out


@query("src_rule_entities", "SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')).list_sort(), ',') AS names FROM documents WHERE text IS NOT NULL")
def src_rule_entities(spark, d):
    """Names in documents, by rule."""
    from casegraph.sources import rules

    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.array_join(F.array_sort(rules.entities(F.col("text"))), ",").alias("names"))


@query("udf_vector_groups")
def udf_vector_groups(spark, d):
    """Vectors in groups of forty at most that are alike."""
    from casegraph.operators.merge import vector_groups

    return vector_groups(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").alias("vector")))


@query("udf_group_sizes", "SELECT count(*) AS names, count(*) AS placed, CAST(0 AS BIGINT) AS too_large FROM embeddings")
def udf_group_sizes(spark, d):
    """All names are in a group, and no group has more than forty."""
    found = udf_vector_groups(spark, d).groupBy("group").agg(F.count("*").alias("n"), F.countDistinct("name").alias("k"))
    return found.agg(F.sum("n").alias("names"), F.sum("k").alias("placed"), F.count_if(F.col("n") > 40).alias("too_large"))


@query("flt_requests", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'no session' WHEN o_orderkey % 7 = 0 THEN 'no text' WHEN o_orderkey % 3 = 0 AND o_totalprice > 200000 THEN 'threshold out of range' END AS fault FROM orders")
def flt_requests(spark, d):
    """What is wrong with requests."""
    from casegraph.operators.predicates import request_fault

    k = F.col("o_orderkey")
    threshold = F.when(k % 3 == 0, F.col("o_totalprice") / 200000)
    return table(spark, d, "orders").select("o_orderkey", request_fault(F.when(k % 5 != 0, "s"), F.when(k % 7 == 0, "  ").otherwise("t"), threshold).alias("fault"))


@query("top_reranked", """WITH t AS (SELECT label % 3 AS turn, vec_id AS ord, 'u' || vec_id % 200 AS url, 't' || vec_id AS title, embedding FROM embeddings), p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY turn, ord) = 1), s AS (SELECT embedding FROM embeddings WHERE vec_id = 7)
SELECT p.url, p.title, p.turn, round(list_cosine_similarity(p.embedding, s.embedding), 4) AS score FROM p, s ORDER BY list_cosine_similarity(p.embedding, s.embedding) DESC, p.url LIMIT 50""")
def top_reranked(spark, d):
    """Candidates of three turns, the fifty nearest to the seed query."""
    from casegraph.operators.resolve import reranked

    e = table(spark, d, "embeddings")
    seed = e.filter("vec_id = 7").first()["embedding"]
    turns = e.select((F.col("label") % 3).alias("turn"), F.col("vec_id").alias("ord"), F.concat(F.lit("u"), F.col("vec_id") % 200).alias("url"), F.concat(F.lit("t"), "vec_id").alias("title"), F.col("embedding").alias("vector"))
    return reranked(turns, seed, 50).withColumn("score", F.round("score", 4))


@query("src_enriched", "SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN 'supplier' END AS provider, s_name AS found FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 300 AND p_partkey % 2 = 0")
def src_enriched(spark, d):
    """Entities enriched by the first provider that applies to them."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 300).alias("key"), (F.col("p_partkey") % 2 == 0).alias("applies"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("found"))
    return stores.enriched(p, [("supplier", F.col("applies"), s)]).select("p_partkey", "provider", "found")
