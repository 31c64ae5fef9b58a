"""Queries of stores, projections, rankings and reports."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from casegraph.functions import text
from casegraph.operators import projections as J
from casegraph.operators import reports
from casegraph.operators.picks import first_wins
from casegraph.plans.register import register
from casegraph.sources import ingest, pdf, stores
from casegraph.sources.tables import affiliations, articles, dealt, events, table

QUERIES, SQL, query = register()


@query("src_query_trim", f"""WITH w AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x) NOT IN ({", ".join(f"'{w}'" for w in text.QUERY_STOPS)})) AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 0 THEN array_to_string(w[1:6], ' ') ELSE text END AS q FROM w""")
def src_query_trim(spark, d):
    """A query of the first six distinctive words of each document."""
    return table(spark, d, "documents").select("doc_id", text.query_terms(F.col("text")).alias("q"))


@query("src_fan_in", "SELECT doc_id AS ord, 'news' AS provenance FROM documents WHERE doc_id % 7 <> 3 AND length(trim(text)) > 0 UNION ALL SELECT page_id, 'pages' FROM pages WHERE length(trim(regexp_replace(regexp_replace(html, '<(?:script[^>]*>[\\s\\S]*?</script|style[^>]*>[\\s\\S]*?</style)>', '', 'g'), '<.*?>', '', 'g'))) > 0")
def src_fan_in(spark, d):
    """Articles of two sources, without those that have no text."""
    sources = {"news": articles(spark, d), "pages": ingest.pages(table(spark, d, "pages")), "wiki": None}
    return ingest.fetched(sources, ["news", "pages", "news", "wiki"]).select("ord", "provenance")


@query("src_combined", "SELECT lang AS run, count(*) AS n, min(source || '__X__' || doc_id) AS first_key FROM documents WHERE doc_id % 7 <> 3 AND text <> '' GROUP BY lang")
def src_combined(spark, d):
    """Second-stage payloads by run."""
    p = ingest.combined_payload(articles(spark, d), "X")
    return p.groupBy("run").agg(F.sum(F.size("articles")).cast("long").alias("n"), F.min(F.array_min(F.map_keys("articles"))).alias("first_key"))


@query("src_split", r"""WITH x AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda l: {'p': CAST([] AS VARCHAR[]), 'c': l}) AS ls FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, text, list_reduce(ls, lambda a, l: CASE
  WHEN length(l.c) > 3000 THEN {'p': list_concat(list_append(a.p, a.c), list_transform(range(0, length(l.c), 3000), lambda i: substr(l.c, CAST(i AS INTEGER) + 1, 3000))), 'c': ''}
  WHEN a.c <> '' AND length(a.c) + length(l.c) + 1 > 3000 THEN {'p': list_append(a.p, a.c), 'c': l.c}
  WHEN a.c <> '' THEN {'p': a.p, 'c': a.c || chr(10) || l.c} ELSE {'p': a.p, 'c': l.c} END, {'p': CAST([] AS VARCHAR[]), 'c': ''}) AS r FROM x),
f AS (SELECT doc_id, CASE WHEN length(text) <= 3000 THEN [text] ELSE list_filter(list_append(r.p, r.c), lambda p: regexp_matches(p, '\S')) END AS ps FROM r)
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS part, sha256(unnest(ps)) AS sha FROM f""")
def src_split(spark, d):
    """Documents split into pieces of whole lines."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ingest.expanded(docs).select("doc_id", F.col("part").cast("long").alias("part"), F.sha2("text", 256).alias("sha"))


def _as_pdf(text: Column) -> Column:
    """A text set as a PDF file of one page, a line for each line, in UTF-16 codes."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<"), F.hex(F.encode(x, "UTF-16BE")), F.lit("> Tj T*\n")))
    table = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    font = "/Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R"
    head = f"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Resources << /Font << /F << {font} >> >> >> >> endobj\n"
    head += f"3 0 obj << /Type /Page /Contents 4 0 R >> endobj\n5 0 obj << >> stream\n{table}\nendstream endobj\n4 0 obj << >> stream\nBT /F 10 Tf 12 TL 72 720 Td\n"
    tail = "ET\nendstream endobj\ntrailer << /Root 1 0 R >>\n%%EOF"
    return F.concat(F.lit(head), F.array_join(lines, ""), F.lit(tail)).cast("binary")


@query("src_pdf", r"SELECT doc_id, nullif(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), '') AS text, CASE WHEN trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) = '' THEN 'no text' END AS error FROM documents")
def src_pdf(spark, d):
    """Documents set as PDF files and read back, their gaps made one space."""
    read = table(spark, d, "documents").select("doc_id", pdf.texts(_as_pdf(F.col("text"))).alias("pdf"))
    plain = F.trim(F.regexp_replace("pdf.text", r"[ \t\r\n]+", " "))
    return read.select("doc_id", F.nullif(plain, F.lit("")).alias("text"), F.col("pdf.error").alias("error"))


@query("src_extract", "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 50 = 0 THEN 'failed: bad chunk' ELSE 'ok' END AS status FROM documents")
def src_extract(spark, d):
    """A rule-based extractor over chunks, some of which fail."""

    def longest(text: str) -> list[dict]:
        if text.startswith("BAD"):
            raise ValueError("bad chunk")
        return [{"name": max(text.split() or [""], key=len)}]

    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 50 == 0, F.lit("BAD")).otherwise(F.col("text")).alias("text"))
    return ingest.extracted(chunks, longest, "name string").select("chunk_id", "status")


@query("src_state", "SELECT o_custkey AS canonical, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS ord FROM orders GROUP BY 1")
def src_state(spark, d):
    """The index of a state: the last record of each id."""
    return stores.indexed(table(spark, d, "orders").select(F.col("o_custkey").alias("canonical"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord")))


@query("src_codec", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS c_name, CAST(1 AS BIGINT) AS n_extra FROM customer")
def src_codec(spark, d):
    """Records through JSON and back: absent fields stay absent, unknown ones are kept aside."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("c_name"), F.col("c_mktsegment").alias("segment"))
    back = stores.decoded(stores.encoded(c), "c_custkey bigint, c_name string")
    return back.select("c_custkey", "c_name", F.size("extra").cast("long").alias("n_extra"))


@query("src_artifacts", "WITH n AS (SELECT 'run' || p_partkey % 300 AS base, p_partkey % 3 = 0 AS e FROM part) SELECT base, base || CASE WHEN bool_or(e) THEN '.enriched.json' ELSE '.json' END AS name, substr(sha256(base || '.json'), 1, 10) AS id FROM n GROUP BY base")
def src_artifacts(spark, d):
    """Artifacts by base name, enriched ones first."""
    name = F.concat(F.lit("run"), F.col("p_partkey") % 300, F.when(F.col("p_partkey") % 3 == 0, ".enriched.json").otherwise(".json"))
    return stores.artifact_index(table(spark, d, "part").select(name.alias("name")))


@query("src_audit", "SELECT 'C' || o.o_custkey AS node, o.o_orderkey AS chunk_id, substr(regexp_replace(d.text, '[\\r\\n]+', ' ', 'g'), 1, 1000) AS text FROM orders o JOIN documents d ON d.doc_id = o.o_orderkey")
def src_audit(spark, d):
    """Nodes with the head of their chunk."""
    nodes = table(spark, d, "orders").select(F.concat(F.lit("C"), "o_custkey").alias("node"), F.col("o_orderkey").alias("chunk_id"))
    return stores.audit_rows(nodes, table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))


@query("src_progress", "SELECT event_type AS stage, event_id AS done, CAST(10000 AS BIGINT) AS total FROM events WHERE event_id % 3 = 0")
def src_progress(spark, d):
    """Progress read from log lines."""
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "event_type", F.lit("] "), "event_id", F.lit("/10000"))).otherwise("noise")
    return stores.progress(table(spark, d, "events").select(line.alias("line")))


@query("src_budget", "SELECT CAST(sum(o_custkey % 4) AS BIGINT) AS threads FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-05'")
def src_budget(spark, d):
    """Threads launched in a month."""
    threads = F.when(F.col("o_custkey") % 4 > 0, F.array_repeat(F.lit("t"), (F.col("o_custkey") % 4).cast("int"))).otherwise(F.array().cast("array<string>"))
    return stores.threads_today(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("started"), threads.alias("threads")), "1997-05")


@query("src_presets", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'Fraud' ELSE 'General' END AS label FROM customer")
def src_presets(spark, d):
    """The domain preset of each customer, general by default."""
    p = stores.presets(spark)
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "MACHINERY", "fraud").otherwise("nosuch").alias("id"))
    return c.join(F.broadcast(p), "id", "left").select("c_custkey", F.coalesce("label", F.lit("General")).alias("label"))


@query("flt_score", "SELECT c_custkey FROM customer WHERE coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END, 0) >= 100")
def flt_score(spark, d):
    """Nodes whose score reaches a threshold; a missing score is 0."""
    c = table(spark, d, "customer").withColumn("score", F.when(F.col("c_custkey") % 5 > 0, F.col("c_acctbal")))
    return reports.score_at_least(c, 100).select("c_custkey")


@query("flt_payload_edges", "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey % 90 AS dst, CASE l_returnflag WHEN 'A' THEN 'affiliation' ELSE 'evidence' END AS type, l_returnflag = 'N' AS structural, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2, 3, 4")
def flt_payload_edges(spark, d):
    """Edges of known types, the first of each."""
    kind = F.when(F.col("l_returnflag") == "A", "affiliation").when(F.col("l_returnflag") == "N", "evidence").otherwise("other")
    e = table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), F.col("l_partkey") % 90).alias("dst"), kind.alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return J.payload_edges(e, ["affiliation", "evidence"]).select("src", "dst", "type", "structural", "ord")


@query("flt_view", "WITH n AS (SELECT 'S' || l_suppkey AS node, list(DISTINCT l_returnflag) AS runs, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1), k AS (SELECT node FROM n WHERE list_contains(runs, 'A') AND n >= 100), e AS (SELECT DISTINCT 'S' || a.l_suppkey AS src, 'S' || b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey) SELECT count(*) AS edges FROM e WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)")
def flt_view(spark, d):
    """Edges that a reader's filters leave."""
    x = table(spark, d, "lineitem")
    n = x.filter("l_quantity > 40").groupBy(F.concat(F.lit("S"), "l_suppkey").alias("node")).agg(F.collect_set("l_returnflag").alias("runs"), F.count("*").alias("n_evidence")).withColumn("type", F.lit("ORG"))
    rows = x.count()
    s = dealt(x.select("l_orderkey", "l_suppkey"), rows, "l_orderkey").distinct()
    pairs = s.join(s.withColumnRenamed("l_suppkey", "o"), "l_orderkey").filter("l_suppkey < o").select("l_suppkey", "o")
    e = dealt(pairs, rows, "l_suppkey", "o").distinct().select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("S"), "o").alias("dst"))
    return J.filtered_view(n, e, ["A"], ["ORG"], 100)[1].agg(F.count("*").alias("edges"))


@query("prj_nodes", "WITH r AS (SELECT p_name AS node, p_partkey % 4 = 0 AS ev, p_partkey AS ord, p_retailprice / 1000 AS score FROM part), f AS (SELECT node, arg_min(ord, CASE WHEN ev THEN 0 ELSE 1 END * 1000000 + ord) AS ord FROM r GROUP BY node) SELECT r.node, r.ev AS is_event, r.node AS label, round(r.score, 3) AS score FROM r JOIN f ON f.ord = r.ord")
def prj_nodes(spark, d):
    """Nodes for display, events before entities of one name."""
    r = table(spark, d, "part").select(F.col("p_name").alias("node"), (F.col("p_partkey") % 4 == 0).alias("is_event"), F.array("p_brand").alias("labels"), (F.col("p_retailprice") / 1000).alias("score"), F.col("p_partkey").alias("ord"))
    return J.payload_nodes(r).select("node", "is_event", "label", "score")


@query("prj_global", "WITH e AS (SELECT l_suppkey AS s, l_partkey % 100 AS p, count(DISTINCT l_orderkey) AS so, count(DISTINCT l_returnflag) AS inv, max(CASE WHEN l_partkey % 2 = 0 THEN l_discount ELSE 0 END) AS w FROM lineitem GROUP BY 1, 2) SELECT s, p, round(CASE WHEN w <> 0 THEN w ELSE greatest(so, inv, 1) END, 6) AS weight FROM e")
def prj_global(spark, d):
    """Weights of the store's edges."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 100).alias("p")).agg(F.countDistinct("l_orderkey").alias("so"), F.countDistinct("l_returnflag").alias("inv"), F.max(F.when(F.col("l_partkey") % 2 == 0, F.col("l_discount")).otherwise(0.0)).alias("w"))
    return e.select("s", "p", F.round(J.store_weight(F.col("w"), F.col("so"), F.col("inv")), 6).alias("weight"))


@query("prj_descriptions", "SELECT c_custkey, 'name: ' || c_name || '.' || CASE WHEN c_custkey % 3 > 0 THEN ' segment: ' || c_mktsegment || '.' ELSE '' END AS text FROM customer")
def prj_descriptions(spark, d):
    """Retrieval texts of customers."""
    segment = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("not specified")
    return table(spark, d, "customer").select("c_custkey", J.description(name=F.col("c_name"), segment=segment).alias("text"))


@query("prj_network", "WITH e AS (SELECT DISTINCT 'N' || s_nationkey AS src, 'S' || s_suppkey AS dst FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e) SELECT src AS node, string_agg(src || ' -has-> ' || dst, chr(10) ORDER BY dst) AS text FROM r WHERE k <= 6 GROUP BY src")
def prj_network(spark, d):
    """Relations of nations, as text."""
    s = table(spark, d, "supplier")
    return J.network_text(s.select(F.concat(F.lit("N"), "s_nationkey").alias("src"), F.lit("has").alias("type"), F.concat(F.lit("S"), "s_suppkey").alias("dst")))


@query("agg_rollup", "WITH m AS (SELECT c_nationkey AS community, c_name AS node, c_acctbal AS score, c_custkey % 3 AS runs, c_custkey % 50 = 0 AS anchor FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY score DESC, node) AS k FROM m) SELECT community, count(*) AS size, string_agg(CASE WHEN k <= 2 THEN node END, ' / ' ORDER BY k) AS label, round(avg(score), 3) AS mean_score, count(*) FILTER (runs >= 2) AS bridges, bool_or(runs >= 2 OR anchor) AS anchored FROM r GROUP BY community")
def agg_rollup(spark, d):
    """Communities rolled up."""
    return J.rollup(table(spark, d, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_name").alias("node"), F.col("c_acctbal").alias("score"), (F.col("c_custkey") % 3).alias("n_runs"), (F.col("c_custkey") % 50 == 0).alias("anchor")))


@query("agg_signal", "WITH e AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT l_suppkey AS k, count(DISTINCT o_custkey) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT e.k, n + m AS signal FROM e JOIN r ON e.k = r.k ORDER BY signal DESC, e.k LIMIT 12")
def agg_signal(spark, d):
    """The twelve entities with most relations and evidence."""
    a = affiliations(spark, d)
    g = a.groupBy(F.col("a").alias("node")).agg((F.count("*") + F.countDistinct("b")).alias("signal"))
    return g.select(F.substring("node", 2, 20).cast("long").alias("k"), "signal").orderBy(F.desc("signal"), "k").limit(12)


@query("agg_store_stats", "SELECT (SELECT count(*) FROM customer) AS canonicals, (SELECT count(DISTINCT regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g')) FROM customer) AS norm_keys, (SELECT count(*) FROM orders) AS edges, (SELECT count(*) FROM events) AS events")
def agg_store_stats(spark, d):
    """Counters of the store and the registry."""
    c = table(spark, d, "customer").agg(F.count("*").alias("canonicals"), F.countDistinct(F.regexp_replace(F.upper("c_name"), "[^A-Z0-9]", "")).alias("norm_keys"))
    return c.crossJoin(table(spark, d, "orders").agg(F.count("*").alias("edges"))).crossJoin(table(spark, d, "events").agg(F.count("*").alias("events")))  # one row each


@query("jn_run_articles", "WITH e AS (SELECT l_suppkey AS entity, unnest(string_split_regex('doc' || l_partkey % 300 || CASE WHEN l_partkey % 2 = 0 THEN '; doc' ELSE ', doc' END || l_orderkey % 300, '[;,]\\s*')) AS doc FROM lineitem), a AS (SELECT 'doc' || doc_id AS doc, lang AS run FROM documents) SELECT entity, run, count(DISTINCT e.doc) AS n FROM e JOIN a ON a.doc = e.doc GROUP BY 1, 2")
def jn_run_articles(spark, d):
    """Evidence met with the articles of each run, several ids in a field."""
    ids = F.concat(F.lit("doc"), F.col("l_partkey") % 300, F.when(F.col("l_partkey") % 2 == 0, "; doc").otherwise(", doc"), F.col("l_orderkey") % 300)
    a = table(spark, d, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("doc"), F.col("lang").alias("run"))
    lines = table(spark, d, "lineitem")
    return reports.run_articles(dealt(lines.select(F.col("l_suppkey").alias("entity"), ids.alias("doc_ids")), lines.count(), "entity", "doc_ids"), a)


@query("jn_kb", "WITH s AS (SELECT o_custkey AS node, min(o_orderdate) AS first FROM orders GROUP BY 1) SELECT c_custkey, CAST(CAST(s.first AS DATE) AS VARCHAR) AS first_seen FROM customer LEFT JOIN s ON s.node = c_custkey WHERE s.first IS NULL OR s.first <= TIMESTAMP '1995-06-01'")
def jn_kb(spark, d):
    """Results of the knowledge base with their first day, without those that begin later."""
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.min(F.to_date("o_orderdate")).alias("first_seen"))
    found = reports.known_at(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), s, "1995-06-01")
    return found.select(F.col("node").alias("c_custkey"), F.col("first_seen").cast("string").alias("first_seen"))


@query("jn_attested", "WITH m AS (SELECT l_orderkey AS theme, list_sort(list(DISTINCT 'S' || l_suppkey)) AS members FROM lineitem GROUP BY 1), p AS (SELECT theme, members[i] AS a, members[j] AS b FROM m, range(1, 60) x(i), range(1, 60) y(j) WHERE i < j AND j <= len(members)), e AS (SELECT DISTINCT least('S' || a.l_suppkey, 'S' || b.l_suppkey) AS a, greatest('S' || a.l_suppkey, 'S' || b.l_suppkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey WHERE a.l_quantity > 48) SELECT theme, count(*) AS attested FROM p JOIN e ON p.a = e.a AND p.b = e.b GROUP BY theme")
def jn_attested(spark, d):
    """How many pairs of a theme's members an edge attests, which a large line item makes."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("S"), "l_suppkey").alias("s"), "l_quantity")
    m = x.select(F.col("l_orderkey").alias("theme"), F.col("s").alias("node")).distinct()
    e = x.filter("l_quantity > 48").select("l_orderkey", F.col("s").alias("x")).distinct().join(x.select("l_orderkey", F.col("s").alias("y")).distinct(), "l_orderkey").filter("x <> y")
    return reports.attested_pairs(m, e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


@query("jn_chunk_edges", "WITH g AS (SELECT l_orderkey AS chunk, count(*) AS edges FROM lineitem GROUP BY 1) SELECT o_orderkey AS chunk, coalesce(edges, 0) AS edges FROM orders LEFT JOIN g ON g.chunk = o_orderkey")
def jn_chunk_edges(spark, d):
    """Chunks with the number of their edges."""
    return reports.chunk_edges(table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk")))


@query("win_url_first", "SELECT o_custkey AS url, CAST(CAST(arg_min(o_orderdate, o_orderkey) AS DATE) AS VARCHAR) AS day FROM orders GROUP BY 1")
def win_url_first(spark, d):
    """The first day recorded for each URL."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("url"), F.to_date("o_orderdate").cast("string").alias("day"), F.col("o_orderkey").alias("ord"))
    return first_wins(o, ["url"], "ord").select("url", "day")


@query("top_themes", "WITH t AS (SELECT l_orderkey AS theme, array_to_string(list_sort(list(DISTINCT l_suppkey % 10)), ',') AS sig, count(DISTINCT l_returnflag) AS runs, round(sum(l_extendedprice), 2) AS w FROM lineitem GROUP BY 1), u AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY runs DESC, w DESC, theme) AS k FROM t) SELECT theme, sig, runs, w FROM u WHERE k = 1 AND runs >= 2 ORDER BY runs DESC, w DESC, theme LIMIT 20")
def top_themes(spark, d):
    """Twenty cross-run themes, one of each member set."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("theme")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey") % 10)), ",").alias("sig"), F.countDistinct("l_returnflag").alias("runs"), F.round(F.sum("l_extendedprice"), 2).alias("w"))
    return reports.cross_run_themes(t)


@query("top_seed", "WITH t AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 498000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9900), r AS (SELECT id, c_acctbal AS score FROM t JOIN customer ON c_custkey = id) SELECT id FROM r ORDER BY score DESC, id LIMIT 40")
def top_seed(spark, d):
    """Seeds of the key network: members of themes and bridges, the best forty."""
    members = table(spark, d, "orders").filter("o_totalprice > 498000").select(F.col("o_custkey").alias("node"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("score"))
    return reports.network_seed(members.union(c.filter("score > 9900").select("node")), c, 40).select(F.col("node").alias("id"))


@query("top_digest", "WITH i AS (SELECT user_id AS event, event_id AS node, value / 100 AS score FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY score DESC, node) AS r FROM i) SELECT event, round(max(score), 6) AS top_score, count(*) AS n, max(score) >= 0.2 AS alert FROM k WHERE r <= 12 GROUP BY event")
def top_digest(spark, d):
    """The digest: events by what they touch most."""
    from casegraph.streaming.monitor import digest

    e = events(spark, d)
    i = e.select(F.col("actor").alias("event"), F.col("event_id").alias("node"), (F.col("value") / 100).alias("score"))
    return digest(i, i.select("event").distinct()).select("event", F.round("top_score", 6).alias("top_score"), "n", "alert")


@query("top_sorted", "SELECT p_partkey, row_number() OVER (ORDER BY p_type DESC, p_size, p_name DESC, p_partkey) AS place FROM part QUALIFY place <= 100")
def top_sorted(spark, d):
    """A sort by several keys in both directions."""
    order = [F.desc("p_type"), F.asc("p_size"), F.desc("p_name"), F.asc("p_partkey")]
    head = table(spark, d, "part").orderBy(*order).limit(100)
    return head.select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("top_incidents", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE event_type = 'error' AND event_id % 2 = 0 ORDER BY CAST(ts AS DATE), event_id LIMIT 40")
def top_incidents(spark, d):
    """The first forty dated incidents."""
    e = events(spark, d).filter("event_type = 'error' and event_id % 2 = 0 and day is not null")
    return e.orderBy("day", "event_id").limit(40).select("event_id", F.col("day").cast("string").alias("day"))


@query("top_hypotheses", "WITH e AS (SELECT l_suppkey AS u, l_partkey AS v, round(max(l_discount * (1 - l_tax)), 3) AS joint FROM lineitem GROUP BY 1, 2) SELECT u, v, joint FROM e ORDER BY joint DESC, u, v LIMIT 30")
def top_hypotheses(spark, d):
    """The thirty hypothesis edges of most joint confidence."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v")).agg(F.round(F.max(F.col("l_discount") * (1 - F.col("l_tax"))), 3).alias("joint"))
    return e.orderBy(F.desc("joint"), "u", "v").limit(30)


@query("gr_lookup", "SELECT o_orderkey, 'C' || least(o_custkey, o_orderkey % 1500) || chr(9) || 'C' || greatest(o_custkey, o_orderkey % 1500) AS pair FROM orders WHERE o_custkey = 77")
def gr_lookup(spark, d):
    """A point lookup, with undirected pair keys."""
    a, b = F.col("o_custkey"), F.col("o_orderkey") % 1500
    key = F.concat(F.lit("C"), F.least(a, b), F.lit("\tC"), F.greatest(a, b))
    return table(spark, d, "orders").filter("o_custkey = 77").select("o_orderkey", key.alias("pair"))
