"""Text and URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casegraph.functions.names import found


def host(url: Column) -> Column:
    """Lower-case host of a URL without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<.*?>", "")


def without_controls(text: Column) -> Column:
    """No control characters, plain spaces for no-break ones."""
    return F.regexp_replace(F.regexp_replace(text, "[\\x00-\\x1F]", ""), " ", " ")


def short_url(url: Column, width: int = 60) -> Column:
    bare = F.regexp_replace(url, "^https?://(www\\.)?", "")
    return F.when(F.length(bare) > width, F.concat(F.substring(bare, 1, width - 3), F.lit("..."))).otherwise(bare)


def markdown_escaped(text: Column) -> Column:
    """A text for a table cell: bars escaped, on one line."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


# Words that a news index needs not be asked for, and the most words of a query.
QUERY_STOPS = [
    "a", "an", "the", "of", "to", "and", "or", "in", "on", "for", "with", "by", "links", "link", "linked", "related",
    "activities", "activity", "involving", "involved", "suspected", "alleged", "between", "about", "into", "via",
]
QUERY_TERMS = 6


def query_terms(query: Column, most: int = QUERY_TERMS) -> Column:
    """The first distinctive words of a query; the query itself without any."""
    words = F.filter(found(query, "[A-Za-z0-9]+"), lambda w: ~F.lower(w).isin(QUERY_STOPS))
    return F.coalesce(F.nullif(F.array_join(F.slice(words, 1, most), " "), F.lit("")), query)


def http_urls(*columns: Column) -> Column:
    """Those of the columns that are URLs, in order, once each."""
    return F.array_distinct(F.filter(F.array(*columns), lambda u: F.coalesce(u.startswith("http"), F.lit(False))))


def fixed_chunks(text: Column, size: int) -> Column:
    """A text in pieces of ``size`` characters; none for an empty text."""
    n = F.ceil(F.length(text) / F.lit(size)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))
    return F.when(n > 0, pieces).otherwise(F.array().cast("array<string>"))


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters of two texts."""
    one, two = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(one, two)) / F.size(F.array_union(one, two))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9))


def best_window(text: Column, terms: list[str], width: int, stride: int) -> Column:
    """Start (0-based) of the first window with most hits of the terms, 0 for a short text, null for none.

    The text is cut into pieces of a stride once, and a window is put together from its own
    pieces, so that a long text costs its length.
    """
    last = F.greatest(F.length(text) - width - 1, F.lit(0))
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  # a value of a lambda is made once
    near = -(-width // stride)

    def hits(window: Column) -> Column:
        total = F.lit(0)
        for t in terms:
            total = total + F.floor((F.length(window) - F.length(F.replace(window, F.lit(t), F.lit("")))) / len(t)).cast("int")
        return total

    def scored(pieces: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor(last / stride).cast("int"))
        window = lambda i: F.lower(F.substr(F.array_join(F.slice(pieces, i + 1, F.lit(near)), ""), F.lit(1), F.lit(width)))
        return F.array_max(F.transform(starts, lambda i: F.struct(bound(window(i), hits).alias("score"), (-i * stride).alias("at"))))

    return F.when(text.isNotNull(), -bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0)), scored)["at"])
