"""What reports show: searches, thresholds, attested pairs, coverage, concentration, footnotes, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casegraph.operators.picks import top_rows

# Rows of a search, cross-run themes shown, members of the key network, URLs of a source.
MOST_HITS, MOST_THEMES, LEAST_SEED, MOST_URLS = 500, 20, 6, 25


def score_at_least(rows: DataFrame, least: float, column: str = "score") -> DataFrame:
    """Rows whose score reaches a threshold; a missing score is 0."""
    return rows.filter(F.coalesce(F.col(column), F.lit(0.0)) >= least)


def searched(rows: DataFrame, text: str, columns: list[str], *order: Column | str) -> DataFrame:
    """The first hits of a text, in any case, in the columns of a row put together."""
    return rows.filter(F.contains(F.lower(F.concat(*columns)), F.lit(text.lower()))).orderBy(*order).limit(MOST_HITS)


def attested_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """``theme, attested``: how many pairs of a theme's members an edge attests.

    ``members``: theme, node, a few for each theme; ``edges``: a, b with a < b.
    """
    pairs = members.select("theme", F.col("node").alias("a")).join(members.select("theme", F.col("node").alias("b")), "theme").filter("a < b")
    return pairs.join(edges.select("a", "b"), ["a", "b"]).groupBy("theme").agg(F.count("*").alias("attested"))


def known_at(results: DataFrame, first_seen: DataFrame, day: str) -> DataFrame:
    """Results with their first day, without those that begin later; undated ones stay.

    ``results``: node; ``first_seen``: node, first_seen (date).
    """
    joined = results.join(first_seen, "node", "left")
    return joined.filter(F.col("first_seen").isNull() | (F.col("first_seen") <= F.lit(day).cast("date")))


def run_articles(evidence: DataFrame, articles: DataFrame) -> DataFrame:
    """``entity, run, n``: the articles of each run that an entity's evidence names.

    ``evidence``: entity, doc_ids (several, parted by commas or semicolons); ``articles``: doc, run.
    """
    spread = evidence.select("entity", F.explode(F.split("doc_ids", r"[;,]\s*")).alias("doc")).filter("doc <> ''").distinct()
    return spread.join(articles.distinct(), "doc").groupBy("entity", "run").agg(F.count("*").alias("n"))  # each met once


def open_jobs(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``id, kind``: the artifacts, and the jobs that have none yet."""
    done = artifacts.select("id").distinct()
    return jobs.select("id").join(done, "id", "left_anti").withColumn("kind", F.lit("job")).union(done.withColumn("kind", F.lit("artifact")))


def chunk_edges(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``chunk, edges``: the number of edges that each chunk attests, 0 without any."""
    n = edges.groupBy("chunk").agg(F.count("*").alias("edges"))
    return chunks.select("chunk").join(n, "chunk", "left").select("chunk", F.coalesce("edges", F.lit(0)).alias("edges"))


def source_concentration(pages: DataFrame, top: int = 3) -> DataFrame:
    """``host, n, n_urls, first_url, top, share``: pages by host and the share of the largest hosts.

    ``pages``: host, url.
    """
    g = pages.groupBy("host").agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"), F.min("url").alias("first_url"))
    best = F.broadcast(g.orderBy(F.desc("n"), "host").limit(top).select("host", F.lit(True).alias("top")))
    marked = g.join(best, "host", "left").withColumn("top", F.coalesce("top", F.lit(False)))
    sums = marked.agg((F.sum(F.when(F.col("top"), F.col("n"))) / F.sum("n")).alias("share"))
    return marked.crossJoin(F.broadcast(sums)).select("host", "n", F.least("n_urls", F.lit(MOST_URLS)).alias("n_urls"), "first_url", "top", "share")  # one row


def cross_run_themes(themes: DataFrame, most: int = MOST_THEMES) -> DataFrame:
    """The heaviest theme of each member set that several runs share.  ``themes``: theme, sig, runs, w."""
    one = top_rows(themes, ["sig"], 1, F.desc("runs"), F.desc("w"), "theme").filter("runs >= 2")
    return one.orderBy(F.desc("runs"), F.desc("w"), "theme").limit(most).select("theme", "sig", "runs", "w")


def network_seed(chosen: DataFrame, everyone: DataFrame, most: int, least: int = LEAST_SEED) -> DataFrame:
    """``node, score``: the best of the chosen, filled up with the best of all others.

    ``chosen``: node; ``everyone``: node, score.
    """
    own = everyone.join(chosen.select("node").distinct(), "node", "left_semi").orderBy(F.desc("score"), "node").limit(most)
    place = F.row_number().over(Window.orderBy("filled", F.desc("score"), "node"))  # most + least rows
    rest = everyone.join(chosen.select("node"), "node", "left_anti").orderBy(F.desc("score"), "node").limit(least)
    both = own.withColumn("filled", F.lit(0)).union(rest.select("node", "score", F.lit(1).alias("filled")))
    return both.withColumn("place", place).filter((F.col("filled") == 0) | (F.col("place") <= least)).select("node", "score")


def bibliography(citations: DataFrame) -> DataFrame:
    """``note, source, url, cited``: sources by first citation, with the first URL of each.

    ``citations``: ord, source, url.  Sources are numbered by the rank of their first
    citation, which a sort over ranges of it and counts of the ranges before would spread.
    """
    first = citations.groupBy("source").agg(F.min("ord").alias("first"), F.min_by("url", "ord").alias("url"), F.count("*").alias("cited"))
    return first.select(F.row_number().over(Window.orderBy("first", "source")).cast("long").alias("note"), "source", "url", "cited")


def set_metrics(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall, F1 and the Jaccard index of two sets of keys; null where undefined."""
    a, b = found.select(*keys).distinct().withColumn("_a", F.lit(1)), truth.select(*keys).distinct().withColumn("_b", F.lit(1))
    c = a.join(b, keys, "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("tp"), F.count("_a").alias("found"), F.count("_b").alias("truth"), F.count("*").alias("every"))
    share = lambda x, y: F.when(y > 0, x / y)
    tp = F.col("tp")
    return c.select(share(tp, F.col("found")).alias("precision_"), share(tp, F.col("truth")).alias("recall"), share(2 * tp, F.col("found") + F.col("truth")).alias("f1"), share(tp, F.col("every")).alias("iou"))


def mode_overlap(found: DataFrame) -> DataFrame:
    """``a, b, jaccard``: how alike what two modes find is, over all queries.  ``found``: mode, query, item."""
    rows = found.select("mode", "query", "item").distinct()
    sizes = rows.groupBy("mode").agg(F.count("*").alias("n"))
    both = rows.select(F.col("mode").alias("a"), "query", "item").join(rows.select(F.col("mode").alias("b"), "query", "item"), ["query", "item"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    pairs = sizes.select(F.col("mode").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("mode").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))  # a few modes
    common = F.coalesce("common", F.lit(0))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (common / (F.col("na") + F.col("nb") - common)).alias("jaccard"))


def token_metrics(pairs: DataFrame) -> DataFrame:
    """``id, precision_, recall, f1`` over the words of two texts as bags.  ``pairs``: id, found, truth."""
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    bag = lambda c, n: pairs.select("id", F.explode(words(c)).alias("w")).groupBy("id", "w").agg(F.count("*").alias(n))
    j = bag("found", "x").join(bag("truth", "y"), ["id", "w"], "full").groupBy("id")
    s = j.agg(F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("tp"), F.coalesce(F.sum("x"), F.lit(0)).alias("nx"), F.coalesce(F.sum("y"), F.lit(0)).alias("ny"))
    out = pairs.select("id").join(s, "id", "left")
    share = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    return out.select("id", share(F.col("tp"), F.col("nx")).alias("precision_"), share(F.col("tp"), F.col("ny")).alias("recall"), share(2 * F.col("tp"), F.col("nx") + F.col("ny")).alias("f1"))


def graph_overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row: edges of one graph that the other has too, either way about, that touch it, and
    the common nodes.  Both: src, dst."""
    turned = two.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    mine = one.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    nodes = lambda e: e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    known = nodes(turned)
    same = mine.join(turned, ["a", "b"], "left_semi").agg(F.count("*").alias("same"))
    by_a, by_b = (mine.join(known.withColumnRenamed("node", c), c, "left_semi").select("a", "b") for c in "ab")
    touching = by_a.union(by_b).distinct().agg(F.count("*").alias("touching"))
    common = nodes(mine).join(known, "node", "left_semi").agg(F.count("*").alias("common_nodes"))
    return same.crossJoin(touching).crossJoin(common)  # one row each
