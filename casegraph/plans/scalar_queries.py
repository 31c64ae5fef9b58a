"""Queries of scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.functions import dates, names, scores, text
from casegraph.operators import predicates as P
from casegraph.plans.register import register
from casegraph.sources.tables import articles, table

QUERIES, SQL, query = register()


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: Names for the name functions: parts with brands, articles and companies around them.
_NAMES = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name || ' Co.' WHEN 1 THEN 'U.S. ' || p_name || ' of ' || p_brand WHEN 2 THEN p_name || ' ' || p_type || ' Holdings Ltd' ELSE p_brand || '-' || p_name END AS name FROM part"


def _names(spark, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(_NAMES)


@query("fn_names", f"""
WITH n AS ({_NAMES}), t AS (SELECT *, list_sort(list_distinct(regexp_extract_all(replace(upper(name), '.', ''), '[A-Z0-9]+'))) AS t FROM n)
SELECT id, array_to_string(list_filter(t, lambda x: NOT list_contains({quoted(names.NAME_STOPS)}, x)), ' ') AS tokens,
  regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS norm_key, upper(name) AS canonical,
  array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(upper(name), '[A-Z0-9]+'))), lambda x: NOT list_contains({quoted(names.COMPANY_SUFFIXES)}, x) AND length(x) > 1), ' ') AS company,
  upper(substr(sha256(name), 1, 6)) AS ref, substr(sha256(name), 1, 10) AS file,
  substr(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS slug,
  CASE WHEN length(name) > 18 THEN substr(name, 1, 17) || '…' ELSE name END AS short FROM t""")
def fn_names(spark, d):
    """Tokens, keys, ids, slugs and truncated labels of names."""
    n = F.col("name")
    return _names(spark, d).select(
        "id",
        F.array_join(F.array_sort(names.name_tokens(n)), " ").alias("tokens"),
        names.norm_key(n).alias("norm_key"),
        names.canonical_id(F.lit(""), n).alias("canonical"),
        F.array_join(F.array_sort(names.company_tokens(n)), " ").alias("company"),
        names.ref_id(n).alias("ref"),
        names.file_id(n).alias("file"),
        names.slug(n).alias("slug"),
        names.truncated(n, 18).alias("short"),
    )


@query("fn_token_run", f"""
WITH n AS ({_NAMES}), t AS (SELECT id, ' ' || array_to_string(regexp_extract_all(upper(name), '[A-Z0-9]+'), ' ') || ' ' AS s FROM n)
SELECT id, contains(s, ' RING ') AS has_ring, contains(s, ' U S ') AS has_us, contains(s, ' RED WIDGET ') AS has_widget FROM t""")
def fn_token_run(spark, d):
    """Contiguous runs of tokens in names."""
    tokens = names.found(F.upper("name"), "[A-Z0-9]+")
    run = lambda *w: names.token_run(tokens, names.literals(list(w)))
    return _names(spark, d).select("id", run("RING").alias("has_ring"), run("U", "S").alias("has_us"), run("RED", "WIDGET").alias("has_widget"))


@query("fn_anchor_tokens", f"""
WITH a AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(upper(regexp_replace(text, '[^ -~]', '', 'g')), '[A-Za-z][A-Za-z0-9&-]{{3,}}'), lambda w: regexp_replace(w, 'S+$', '')),
   lambda w: length(w) >= 5 AND NOT list_contains({quoted(names.ANCHOR_STOPS)}, w))) AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(t), ' ') AS tokens FROM a""")
def fn_anchor_tokens(spark, d):
    """Distinctive tokens of each document."""
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(names.anchor_tokens(F.regexp_replace("text", "[^ -~]", ""))), " ").alias("tokens"))


_DATES = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y')
 WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') || 'T120000Z' WHEN 4 THEN 'Wed, ' || strftime(o_orderdate, '%-d %b %Y') || ' 12:00:00 GMT' ELSE 'not a date' END AS s, strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') AS other FROM orders"""


def _dates(spark, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    kinds = [F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM"), F.date_format(day, "yyyy"), F.concat(F.date_format(day, "yyyyMMdd"), F.lit("T120000Z")), F.concat(F.lit("Wed, "), F.date_format(day, "d MMM yyyy"), F.lit(" 12:00:00 GMT")), F.lit("not a date")]
    s = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s.alias("s"), F.date_format(F.date_add(day.cast("date"), 5), "yyyy-MM-dd").alias("other"))


@query("fn_dates", f"""
WITH q AS ({_DATES}), p AS (SELECT *, coalesce(TRY_CAST(regexp_extract(s, '^(\\d{{4}})', 1) AS INTEGER), 0) AS y, coalesce(TRY_CAST(regexp_extract(s, '^\\d{{4}}-(\\d{{2}})', 1) AS INTEGER), 0) AS m,
  coalesce(TRY_CAST(regexp_extract(s, '^\\d{{4}}-\\d{{2}}-(\\d{{2}})', 1) AS INTEGER), 0) AS dd, year(CAST(other AS DATE)) AS oy, month(CAST(other AS DATE)) AS om FROM q),
l AS (SELECT *, coalesce(nullif(regexp_extract(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), ''), CASE WHEN regexp_matches(s, '^\\d{{8}}') THEN substr(s,1,4) || '-' || substr(s,5,2) || '-' || substr(s,7,2) END,
  CAST(CAST(try_strptime(nullif(regexp_extract(s, '(\\d{{1,2}} [A-Z][a-z]{{2}} \\d{{4}})', 1), ''), '%d %b %Y') AS DATE) AS VARCHAR), '') AS iso,
  coalesce(TRY_CAST(nullif(regexp_extract(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS DATE), TRY_CAST(nullif(regexp_extract(s, '^(\\d{{4}}-\\d{{2}})$', 1), '') || '-01' AS DATE)) AS lo FROM p)
SELECT id, s, y, m, dd AS d, iso, CAST(lo AS VARCHAR) AS lo, CAST(CASE WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}$') THEN last_day(lo) ELSE lo END AS VARCHAR) AS hi,
  y > 0 AND y = oy AND CASE WHEN dd > 0 THEN abs(date_diff('day', lo, CAST(other AS DATE))) <= 7 ELSE m = 0 OR m = om END AS compatible FROM l""")
def fn_dates(spark, d):
    """Parts, normal form, interval and compatibility of dates in five notations."""
    s = F.col("s")
    parts = dates.date_parts(s)
    return _dates(spark, d).select(
        "id", "s", parts["y"].alias("y"), parts["m"].alias("m"), parts["d"].alias("d"), dates.iso_date(s).alias("iso"),
        dates.interval_low(s).cast("string").alias("lo"), dates.interval_high(s).cast("string").alias("hi"),
        F.coalesce(dates.dates_compatible(s, F.col("other")), F.lit(False)).alias("compatible"),
    )


@query("fn_date_sets", f"""
WITH q AS ({_DATES}), g AS (SELECT id // 50 AS g, list_sort(list_distinct(list_filter(list(regexp_extract(s, '\\d{{4}}-\\d{{2}}-\\d{{2}}')), lambda x: x <> ''))) AS days FROM q GROUP BY id // 50)
SELECT g, array_to_string(days, ',') AS days, days[1] AS earliest, CASE g % 3 WHEN 0 THEN '30 days' WHEN 1 THEN '1 year' ELSE 'all' END AS period FROM g""")
def fn_date_sets(spark, d):
    """Sorted days and the earliest of groups of dates; period labels."""
    g = _dates(spark, d).groupBy(F.floor(F.col("id") / 50).cast("long").alias("g")).agg(F.collect_list("s").alias("dates"))
    period = F.element_at(F.array(F.lit("30d"), F.lit("1y"), F.lit("all")), (F.col("g") % 3 + 1).cast("int"))
    return g.select("g", F.array_join(dates.sorted_days(F.col("dates")), ",").alias("days"), dates.earliest_day(F.col("dates")).alias("earliest"), dates.period_label(period).alias("period"))


@query("fn_pages", """
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_replace(html, '<.*?>', '', 'g') AS body, regexp_replace(url, '^https?://(www\\.)?', '') AS bare FROM pages)
SELECT page_id, host, CAST(length(body) AS BIGINT) AS body_chars, sha256(body) AS body_sha, CASE WHEN length(bare) > 30 THEN substr(bare, 1, 27) || '...' ELSE bare END AS short,
  sha256(replace(regexp_replace(body, '[\\x00-\\x1F]', '', 'g'), chr(160), ' ')) AS plain_sha FROM p""")
def fn_pages(spark, d):
    """Hosts, short URLs and tag-free bodies of pages."""
    body = text.without_tags(F.col("html"))
    return table(spark, d, "pages").select(
        "page_id", text.host(F.col("url")).alias("host"), F.length(body).cast("long").alias("body_chars"), F.sha2(body, 256).alias("body_sha"),
        text.short_url(F.col("url"), 30).alias("short"), F.sha2(text.without_controls(body), 256).alias("plain_sha"),
    )


@query("fn_clean", f"""
WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN ' ' || o_orderpriority || ' ' WHEN 1 THEN 'N/A' WHEN 2 THEN 'Not specified in data' WHEN 3 THEN NULL WHEN 4 THEN 'unknown' WHEN 5 THEN '' ELSE o_orderstatus END AS v FROM orders)
SELECT id, CASE WHEN list_contains({quoted(names.EMPTY_EXACT)}, lower(trim(v))) OR list_bool_or(list_transform({quoted(names.EMPTY_PREFIXES)}, lambda p: starts_with(lower(trim(v)), p))) THEN NULL ELSE trim(v) END AS cleaned FROM v""")
def fn_clean(spark, d):
    """Values with all spellings of "none" made null."""
    k = (F.col("o_orderkey") % 7 + 1).cast("int")
    values = F.array(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")), F.lit("N/A"), F.lit("Not specified in data"), F.lit(None).cast("string"), F.lit("unknown"), F.lit(""), F.col("o_orderstatus"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), names.clean(F.element_at(values, k)).alias("cleaned"))


_LADDER_SQL = lambda x, steps, last: "CASE " + " ".join(f"WHEN {x} >= {a} THEN '{n}'" for a, n in steps) + f" ELSE '{last}' END"


@query("fn_scores", f"""
WITH v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 50 AS p, l_discount * 10 AS q, l_tax AS t, l_quantity AS w, l_returnflag AS f, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
k AS (SELECT *, CASE f WHEN 'A' THEN 'affiliation' WHEN 'N' THEN 'event_coincident' ELSE 'evidence' END AS kind, coalesce(nullif(q, 0), 0.5) AS gq FROM v)
SELECT id, {_LADDER_SQL("p", scores.CONFIDENCE_LADDER, scores.CONFIDENCE_LAST)} AS label, {_LADDER_SQL("(2 * p - 1)", scores.VERDICT_LADDER, scores.VERDICT_LAST)} AS verdict,
  round(greatest(0.0, least(1.0, w / 5.0)), 6) AS norm_w, round(greatest(0.1, least(1.0, q)), 6) AS strength, round(pow(0.7, coalesce(CASE WHEN n < 5 THEN n END, 2)) * p, 6) AS score, round(p * q, 3) AS joint,
  round(CASE kind WHEN 'evidence' THEN 0.3 ELSE greatest(0.05, CASE kind WHEN 'affiliation' THEN 1.0 ELSE 0.15 END * sqrt(p * gq) * (1 + 0.25 * greatest(n - 1, 0))) END, 6) AS weight,
  CASE WHEN n >= 3 THEN 'strong' WHEN n = 2 THEN 'moderate' ELSE 'weak' END AS tier FROM k""")
def fn_scores(spark, d):
    """Ladders, clamps, relevance, weights and tiers."""
    v = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50).alias("p"), (F.col("l_discount") * 10).alias("q"), F.col("l_quantity").alias("w"),
        F.when(F.col("l_returnflag") == "A", "affiliation").when(F.col("l_returnflag") == "N", "event_coincident").otherwise("evidence").alias("kind"), F.col("l_linenumber").cast("long").alias("n"),
    )
    p, q, n = F.col("p"), F.col("q"), F.col("n")
    return v.select(
        "id", scores.ladder(p, scores.CONFIDENCE_LADDER, scores.CONFIDENCE_LAST).alias("label"), scores.ladder(2 * p - 1, scores.VERDICT_LADDER, scores.VERDICT_LAST).alias("verdict"),
        F.round(scores.normal_weight(F.col("w")), 6).alias("norm_w"), F.round(scores.event_strength(q), 6).alias("strength"), F.round(scores.relevance(F.when(n < 5, n)) * p, 6).alias("score"),
        F.round(p * q, 3).alias("joint"), F.round(scores.edge_weight(F.col("kind"), p, q, n), 6).alias("weight"), scores.tier(n).alias("tier"),
    )


@query("fn_similarity", """
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(list_distinct(string_split(a.text, '')), list_distinct(string_split(b.text, '')))) * 1.0
  / len(list_distinct(list_concat(string_split(a.text, ''), string_split(b.text, '')))), 6) AS sim FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1""")
def fn_similarity(spark, d):
    """Character-set similarity of neighbouring benchmark items."""
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("a"), F.col("text").alias("ta"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("b"), F.col("text").alias("tb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(text.char_jaccard(F.col("ta"), F.col("tb")), 6).alias("sim"))


_TITLES = "SELECT doc_id AS id, array_to_string(list_slice(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, CAST(1 + doc_id % 10 AS BIGINT)), ' ') || CASE doc_id % 8 WHEN 0 THEN ' KILLED' WHEN 1 THEN ' supreme court' WHEN 2 THEN ' IRAN' WHEN 3 THEN ' Police' ELSE '' END AS t FROM documents"


@query("flt_names", f"""
WITH n AS ({_TITLES} UNION ALL SELECT -1, 'ALL OTHER UNIQUE IDENTIFIERS' UNION ALL SELECT -2, ''), u AS (SELECT *, list_distinct(regexp_extract_all(upper(trim(t)), '[A-Z]+')) AS k, regexp_split_to_array(trim(t), '\\s+') AS w FROM n)
SELECT id, trim(t) <> '' AND len(w) <= 7 AND NOT list_has_any(k, {quoted(P.HEADLINE_VERBS)}) AND NOT (len(k) > 0 AND list_has_all({quoted(P.GENERIC_TERMS)}, k)) AS valid,
  list_bool_or(list_transform({quoted(P.INSTITUTION_PHRASES)}, lambda p: contains(lower(t), p))) OR list_has_any(regexp_extract_all(lower(t), '[a-z]+'), {quoted(P.INSTITUTION_TOKENS)}) AS institution,
  len(regexp_split_to_array(trim(upper(t)), '\\s+')) <= 3 AND list_has_any(regexp_split_to_array(trim(upper(t)), '\\s+'), {quoted(P.PLACE_TOKENS)}) AS place FROM u""")
def flt_names(spark, d):
    """Validity, institutions and places among names."""
    words = F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, (1 + F.col("doc_id") % 10).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (" KILLED", " supreme court", " IRAN", " Police", "", "", "", "")]), (F.col("doc_id") % 8 + 1).cast("int"))
    n = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.array_join(words, " "), tail).alias("t"))
    n = n.union(spark.createDataFrame([(-1, "ALL OTHER UNIQUE IDENTIFIERS"), (-2, "")], "id long, t string"))
    t = F.col("t")
    return n.select("id", P.valid_canonical(t).alias("valid"), P.institutional(t).alias("institution"), P.country_like(t).alias("place"))


@query("flt_canonical_repair", f"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS labels FROM documents),
v AS (SELECT doc_id, list_filter(labels, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) <= 7 AND NOT list_has_any(regexp_extract_all(upper(trim(x)), '[A-Z]+'), {quoted(P.HEADLINE_VERBS)})
   AND NOT (len(regexp_extract_all(upper(trim(x)), '[A-Z]+')) > 0 AND list_has_all({quoted(P.GENERIC_TERMS)}, regexp_extract_all(upper(trim(x)), '[A-Z]+')))) AS ok FROM l)
SELECT doc_id, (SELECT x FROM (SELECT unnest(ok) AS x, generate_subscripts(ok, 1) AS i) ORDER BY length(x), i LIMIT 1) AS canonical FROM v""")
def flt_canonical_repair(spark, d):
    """The shortest valid label among a record's labels."""
    labels = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", P.better_canonical(labels).alias("canonical"))


@query("flt_publishers", """
WITH e AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || ' ' || lang ELSE source || ' news ' || lang END AS identifier FROM documents),
p AS (SELECT DISTINCT source || ' ' || lang AS publisher FROM documents), et AS (SELECT identifier, list_distinct(regexp_extract_all(upper(identifier), '[A-Z0-9]+')) AS t FROM e), pt AS (SELECT publisher, list_distinct(regexp_extract_all(upper(publisher), '[A-Z0-9]+')) AS t FROM p)
SELECT DISTINCT identifier FROM et JOIN pt ON upper(identifier) = upper(publisher) OR (list_has_all(et.t, pt.t) AND len(pt.t) >= 2) OR (list_has_all(pt.t, et.t) AND len(et.t) >= 2)""")
def flt_publishers(spark, d):
    """Entities that name a publisher, by token sets."""
    docs = table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", "source", "lang")).otherwise(F.concat_ws(" ", "source", F.lit("news"), "lang"))
    return P.publishers_among(docs.select(name.alias("identifier")).distinct(), docs.select(F.concat_ws(" ", "source", "lang").alias("publisher")).distinct())


@query("flt_timeline", f"""
WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Mon, 3 May 2024 10:00:00 GMT' WHEN 1 THEN 'Published article on it' WHEN 2 THEN 'Reported by ' || source ELSE text END AS e FROM documents),
f AS (SELECT doc_id, regexp_matches(trim(e), '(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\\s+\\d{{1,2}}\\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+\\d{{4}}') OR list_bool_or(list_transform({quoted(P.PUBLICATION_PREFIXES)}, lambda p: starts_with(lower(trim(e)), p))) AS gone FROM t)
SELECT count(*) FILTER (gone) AS dropped, count(*) FILTER (NOT gone) AS kept FROM f""")
def flt_timeline(spark, d):
    """Timeline entries about the articles themselves, dropped and kept."""
    k = F.col("doc_id") % 5
    e = F.when(k == 0, "Mon, 3 May 2024 10:00:00 GMT").when(k == 1, "Published article on it").when(k == 2, F.concat(F.lit("Reported by "), "source")).otherwise(F.col("text"))
    return table(spark, d, "documents").select(P.publication_entry(e).alias("gone")).agg(F.count_if("gone").alias("dropped"), F.count_if(~F.col("gone")).alias("kept"))


@query("flt_brands", """
WITH b AS (SELECT p_partkey AS id, 'best phones ' || CASE p_partkey % 3 WHEN 0 THEN 'instead of ' WHEN 1 THEN 'alternatives to ' ELSE 'like ' END || split_part(p_name, ' ', 1) || ' and ' || p_brand || ' for travel' AS q, p_name, p_retailprice AS score FROM part),
x AS (SELECT *, CASE id % 3 WHEN 2 THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct([upper(split_part(p_name, ' ', 1)), upper(regexp_extract(q, ' and (\\S+) for', 1))])) END AS brands FROM b)
SELECT id, array_to_string(brands, ',') AS brands, len(brands) > 0 AS hit, round(score * CASE WHEN len(brands) > 0 THEN 0.1 ELSE 1.0 END, 6) AS demoted FROM x""")
def flt_brands(spark, d):
    """Brands that a query excludes, and the demotion of parts of that brand."""
    k = F.col("p_partkey") % 3
    ask = F.when(k == 0, "instead of ").when(k == 1, "alternatives to ").otherwise("like ")
    q = F.concat(F.lit("best phones "), ask, F.split("p_name", " ")[0], F.lit(" and "), "p_brand", F.lit(" for travel"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.excluded_brands(q).alias("b"), "p_name", "p_retailprice")
    hit = P.matches_brand(F.col("p_name"), F.col("b"))
    return b.select("id", F.array_join("b", ",").alias("brands"), hit.alias("hit"), F.round(F.col("p_retailprice") * F.when(hit, P.BRAND_PENALTY).otherwise(1.0), 6).alias("demoted"))


@query("fn_relations", """
WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{"type": "unknown", "context": ""}' WHEN 1 THEN '{"type": "' || o_orderstatus || '"}' WHEN 2 THEN '{"type": "", "context": "c' || o_custkey || '"}' ELSE '{}' END AS r, CASE WHEN o_custkey % 2 = 0 THEN 'https://x.example/' || o_custkey ELSE 'note' END AS u FROM orders)
SELECT id, coalesce(r->>'type', '') AS kind, coalesce(r->>'context', '') AS context, coalesce(r->>'type', '') NOT IN ('', 'unknown') OR coalesce(r->>'context', '') <> '' AS informative, CASE WHEN starts_with(u, 'http') THEN u END AS best_url FROM r""")
def fn_relations(spark, d):
    """Type, context, informativeness and best URL of JSON relations."""
    k = F.col("o_orderkey") % 4
    r = F.when(k == 0, '{"type": "unknown", "context": ""}').when(k == 1, F.concat(F.lit('{"type": "'), "o_orderstatus", F.lit('"}'))).when(k == 2, F.concat(F.lit('{"type": "", "context": "c'), "o_custkey", F.lit('"}'))).otherwise("{}")
    u = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("https://x.example/"), "o_custkey")).otherwise("note")
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), r.alias("r"), u.alias("u"))
    return df.select("id", F.coalesce(F.get_json_object("r", "$.type"), F.lit("")).alias("kind"), F.coalesce(F.get_json_object("r", "$.context"), F.lit("")).alias("context"), P.informative_relation(F.col("r")).alias("informative"), F.get(text.http_urls(F.col("u"), F.lit(None)), F.lit(0)).alias("best_url"))


@query("src_articles", """
WITH a AS (SELECT doc_id AS ord, source, string_split(text, chr(10))[1] AS title, CASE WHEN doc_id % 7 <> 3 THEN text END AS body FROM documents)
SELECT ord, coalesce(source, 'unknown') || '__' || ord AS key, body IS NOT NULL AND body <> '' AS body_available,
  sha256(CASE WHEN coalesce(body, '') <> '' THEN body ELSE '[HEADLINE ONLY (403)]' || chr(10) || 'Title: ' || trim(title) || chr(10) || 'Publisher: ' || coalesce(source, 'unknown') END) AS text_sha FROM a WHERE coalesce(body, '') <> '' OR trim(coalesce(title, '')) <> ''""")
def src_articles(spark, d):
    """The payload of an investigation, with headlines in place of lost bodies."""
    from casegraph.sources.ingest import payload

    return payload(articles(spark, d)).select("ord", "key", "body_available", F.sha2("text", 256).alias("text_sha"))


@query("src_fixed_chunks", """
WITH c AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 2048.0) AS BIGINT))) AS i, text FROM documents WHERE length(text) > 0)
SELECT doc_id, i, sha256(substr(text, i * 2048 + 1, 2048)) AS chunk_sha FROM c""")
def src_fixed_chunks(spark, d):
    """Documents in pieces of 2048 characters."""
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(text.fixed_chunks(F.col("text"), 2048)).alias("i", "chunk"))
    return pieces.select("doc_id", F.col("i").cast("long").alias("i"), F.sha2("chunk", 256).alias("chunk_sha"))


@query("win_passages", """
WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 900, 1), 200)) AS pos FROM documents),
s AS (SELECT doc_id, pos, list_sum(list_transform(['tion', 'ment', 'ound'], lambda t: (length(lower(substr(text, pos + 1, 900))) - length(replace(lower(substr(text, pos + 1, 900)), t, ''))) // 4)) AS score FROM w)
SELECT doc_id, arg_max(pos, score * 100000 - pos) AS pos FROM s GROUP BY doc_id""")
def win_passages(spark, d):
    """The window of 900 characters of each document with most hits of a claim's terms."""
    return table(spark, d, "documents").select("doc_id", text.best_window(F.col("text"), ["tion", "ment", "ound"], 900, 200).cast("long").alias("pos"))
