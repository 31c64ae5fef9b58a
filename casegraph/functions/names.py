"""Names, identifiers and cleaners as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity in a name.
NAME_STOPS = ["THE", "A", "AN", "OF", "FOR", "AND", "TO", "IN", "ON"]

# Tokens of names, and words that may anchor a text.
NAME_TOKEN = "[A-Z0-9]+"
ANCHOR_WORD = "[A-Za-z][A-Za-z0-9&-]{3,}"

# Ways to say that an attribute is absent.
EMPTY_EXACT = ["", "n/a", "na", "none", "null", "not applicable", "unknown"]
EMPTY_PREFIXES = ["not specified", "not found", "not available", "not provided", "not mentioned", "not disclosed", "not stated"]

# Query words that anchor nothing.
ANCHOR_STOPS = [
    "BEST", "MODERN", "ALTERNATIVE", "ALTERNATIVES", "WITH", "USED", "USING", "THAT", "THIS", "FROM", "INTO", "OVER",
    "ABOUT", "AFTER", "NEWS", "LATEST", "EVIDENCE", "DENIES", "DEBUNKED", "INVOLVEMENT", "TECHNOLOGY", "COMPANY",
]

# Endings and articles of company names.
COMPANY_SUFFIXES = ["CORP", "CORPORATION", "INC", "INCORPORATED", "LTD", "LIMITED", "LLC", "PLC", "CO", "COMPANY", "GROUP", "HOLDINGS", "THE", "AG", "SA", "NV", "GMBH"]


def literals(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def found(text: Column, pattern: str) -> Column:
    """All matches of a pattern."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def name_tokens(name: Column) -> Column:
    """Distinct upper-case tokens without stop words; dotted acronyms are one token."""
    tokens = found(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"\.", ""), NAME_TOKEN)
    return F.array_except(F.array_distinct(tokens), literals(NAME_STOPS))


def norm_key(name: Column) -> Column:
    """Upper-case letters and digits alone."""
    return F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]", "")


def canonical_id(representative: Column, identifier: Column) -> Column:
    return F.upper(F.coalesce(F.when(representative != "", representative), identifier, F.lit("")))


def token_run(tokens: Column, run: Column) -> Column:
    """Whether ``run`` stands in ``tokens`` as a contiguous run; an empty one does not."""
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return (F.size(run) > 0) & F.contains(padded, F.concat(F.lit(" "), F.array_join(run, " "), F.lit(" ")))


def anchor_tokens(text: Column) -> Column:
    """Distinctive upper-case tokens without plural endings, five characters at least."""
    words = found(F.upper(text), ANCHOR_WORD)
    singular = F.transform(words, lambda w: F.regexp_replace(w, "S+$", ""))
    return F.array_distinct(F.array_except(F.filter(singular, lambda w: F.length(w) >= 5), literals(ANCHOR_STOPS)))


def clean(value: Column) -> Column:
    """The trimmed value, or null if it says that there is none."""
    low = F.lower(F.trim(value))
    empty = low.isin(EMPTY_EXACT)
    for prefix in EMPTY_PREFIXES:
        empty = empty | low.startswith(prefix)
    return F.when(~empty, F.trim(value))


def company_tokens(name: Column) -> Column:
    """Significant tokens of a company name."""
    tokens = F.array_except(F.array_distinct(found(F.upper(F.coalesce(name, F.lit(""))), NAME_TOKEN)), literals(COMPANY_SUFFIXES))
    return F.filter(tokens, lambda t: F.length(t) > 1)


def ref_id(text: Column) -> Column:
    """Six upper-case hex digits that name a source."""
    return F.upper(F.substring(F.sha2(text, 256), 1, 6))


def file_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 10)


def slug(text: Column, width: int = 40) -> Column:
    """Lower-case words joined by underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, width)


def truncated(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def first_of(values: Column, default: str = "UNKNOWN") -> Column:
    """First element of an array, or the default for an empty one."""
    return F.coalesce(F.get(values, F.lit(0)), F.lit(default))
