"""Filters and validity rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegraph.functions.names import found, literals

# Verbs that mark a headline.
HEADLINE_VERBS = [
    "KILLS", "KILLED", "STRIKES", "STRUCK", "SANCTIONS", "SANCTIONED", "DESIGNATES", "DESIGNATED", "INDICTS", "INDICTED",
    "ARRESTS", "ARRESTED", "APPROVES", "APPROVED", "CLEARS", "CLEARED", "LIFTS", "LIFTED", "TRIGGERS", "TRIGGERED",
    "DEPORTS", "DEPORTED", "INTERCEPTS", "INTERCEPTED", "REPLACES", "REPLACED", "ORDERS", "ORDERED", "DEMANDS", "DEMANDED",
    "EXPECTS", "EXPECTED", "COMPLETES", "COMPLETED", "INCREASES", "INCREASED", "REVEALS", "REVEALED", "ANNOUNCES",
    "ANNOUNCED", "ELIMINATED", "ELIMINATES", "DISASSEMBLE", "SEIZE", "SEIZED", "BLOCKS", "BLOCKED", "HALTS", "HALTED",
    "ENFORCES", "ENFORCED", "RAMPS", "RAMP",
]

# Words without content in a name.
GENERIC_TERMS = [
    "ALL", "OTHER", "OTHERS", "ANY", "EACH", "EVERY", "SOME", "SUCH", "CERTAIN", "VARIOUS", "SEVERAL", "MANY", "FEW", "BOTH",
    "THESE", "THOSE", "THIS", "THAT", "THE", "A", "AN", "NO", "NONE", "SAME", "MORE", "MOST", "AND", "OR", "OF", "ETC",
    "UNIQUE", "IDENTIFIER", "IDENTIFIERS", "INFORMATION", "DETAIL", "DETAILS", "DATA", "NAME", "NAMES", "NUMBER", "NUMBERS",
    "RECORD", "RECORDS", "ITEM", "ITEMS", "THING", "THINGS", "ENTITY", "ENTITIES", "PERSON", "PERSONS", "PEOPLE", "PARTY",
    "PARTIES", "INDIVIDUAL", "INDIVIDUALS", "COMPANY", "COMPANIES", "ORGANIZATION", "ORGANIZATIONS", "ORGANISATION",
    "ORGANISATIONS", "ENTRY", "ENTRIES", "FIELD", "FIELDS", "VALUE", "VALUES", "TYPE", "TYPES", "ACCOUNT", "ACCOUNTS",
    "REFERENCE", "REFERENCES",
]
MAX_CANONICAL_WORDS = 7

# Tokens and phrases of institutions.
INSTITUTION_TOKENS = [
    "court", "tribunal", "police", "prosecutor", "prosecution", "parliament", "congress", "senate", "assembly", "knesset",
    "ministry", "agency", "bureau", "interpol", "commission", "council", "directorate", "judiciary",
]
INSTITUTION_PHRASES = ["international criminal court", "supreme court", "district court", "high court", "attorney general", "department of justice", "united nations"]

# Tokens of places.
PLACE_TOKENS = [
    "CHINA", "RUSSIA", "IRAN", "UKRAINE", "TURKEY", "INDIA", "EUROPE", "EU", "UNITED", "STATES", "USA", "AMERICA", "BRITAIN",
    "FRANCE", "GERMANY", "JAPAN", "KOREA", "ISRAEL", "PALESTINE", "LEBANON", "YEMEN", "SAUDI", "ARABIA", "EGYPT", "SYRIA",
    "IRAQ", "KAZAKHSTAN", "AZERBAIJAN", "CASPIAN", "STRAIT", "HORMUZ", "MOSCOW", "BEIJING", "TEHRAN", "WASHINGTON",
]

# How timeline entries about the article itself begin, and HTTP dates.
PUBLICATION_PREFIXES = ["published article", "publication date", "article published", "reported by", "as reported", "reporting on", "this article", "news article", "news story", "publication of"]
HTTP_DATE = r"(?i)^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),\s+\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}"

# How a query asks for alternatives to brands.
BRAND_PATTERN = r"(?i)\b(?:alternatives?\s+to|instead\s+of|other\s+than|besides|rather\s+than|not\s+(?:from|by)|excluding|except)\s+(.+?)(?:\s+(?:for|in|on|with|under|that|which|because)\b|[.?!]|$)"
BRAND_BREAK = r"(?i)\s*(?:,|/|\band\b|\bor\b)\s*"
BRAND_PENALTY = 0.1


def valid_canonical(name: Column) -> Column:
    """A noun phrase: few words, no headline verb, some word of content."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    tokens = F.array_distinct(found(F.upper(trimmed), "[A-Z]+"))
    short = F.size(F.split(trimmed, r"\s+")) <= MAX_CANONICAL_WORDS
    generic = (F.size(tokens) > 0) & (F.size(F.array_except(tokens, literals(GENERIC_TERMS))) == 0)
    return (trimmed != "") & short & ~F.arrays_overlap(tokens, literals(HEADLINE_VERBS)) & ~generic


def better_canonical(labels: Column) -> Column:
    """The shortest valid label, the first of equals; null without one."""
    ranked = F.transform(F.filter(labels, valid_canonical), lambda x: F.struct(F.length(x).alias("n"), F.array_position(labels, x).alias("at"), x.alias("label")))
    return F.array_min(ranked)["label"]


def publisher_tokens(name: Column) -> Column:
    return F.array_distinct(found(F.upper(F.coalesce(name, F.lit(""))), "[A-ZА-ЯЇЄІҐ0-9]+"))


def publishers_among(entities: DataFrame, publishers: DataFrame, column: str = "identifier") -> DataFrame:
    """Entities that name a publisher: equal, or the smaller token set of two or more lies in the other.

    Both sides meet by a common token or by name, never all against all.
    """
    mine = entities.select(column, F.upper(F.trim(F.col(column))).alias("u"), publisher_tokens(F.col(column)).alias("t"))
    theirs = publishers.select(F.upper(F.trim("publisher")).alias("cu"), publisher_tokens(F.col("publisher")).alias("ct"))
    equal = mine.join(theirs, mine["u"] == theirs["cu"], "left_semi").select(column)
    one = mine.withColumn("k", F.explode("t"))
    two = theirs.withColumn("k", F.explode("ct"))
    inside = (F.size(F.array_except("ct", "t")) == 0) & (F.size("ct") >= 2)
    around = (F.size(F.array_except("t", "ct")) == 0) & (F.size("t") >= 2)
    return equal.union(one.join(two, "k").filter(inside | around).select(column)).distinct()


def institutional(name: Column) -> Column:
    low = F.lower(name)
    phrases = F.exists(literals(INSTITUTION_PHRASES), lambda p: F.contains(low, p))
    return phrases | F.arrays_overlap(found(low, "[a-z]+"), literals(INSTITUTION_TOKENS))


def country_like(name: Column) -> Column:
    words = F.split(F.trim(F.upper(name)), r"\s+")
    return (F.size(words) <= 3) & F.arrays_overlap(words, literals(PLACE_TOKENS))


def publication_entry(event: Column) -> Column:
    """Whether a timeline entry is about the article and not about its matter."""
    low = F.lower(F.trim(event))
    out = F.trim(event).rlike(HTTP_DATE)
    for prefix in PUBLICATION_PREFIXES:
        out = out | low.startswith(prefix)
    return out


def excluded_brands(query: Column) -> Column:
    """Brands that a product query wants alternatives to, upper case, three words at most."""
    parts = F.flatten(F.transform(F.regexp_extract_all(query, F.lit(BRAND_PATTERN), F.lit(1)), lambda x: F.split(x, BRAND_BREAK)))
    names = F.transform(parts, lambda x: F.upper(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= 3))))


def matches_brand(name: Column, brands: Column) -> Column:
    """Whether all words of some brand stand in a name."""
    tokens = F.split(F.replace(F.upper(name), F.lit("-"), F.lit(" ")), r"\s+")
    return F.exists(brands, lambda b: F.forall(F.split(b, r"\s+"), lambda w: F.array_contains(tokens, w)))


def informative_relation(relation: Column) -> Column:
    """A JSON relation with a known type or some context."""
    kind = F.lower(F.trim(F.coalesce(F.get_json_object(relation, "$.type"), F.lit(""))))
    context = F.trim(F.coalesce(F.get_json_object(relation, "$.context"), F.lit("")))
    return ~kind.isin("", "unknown") | (context != "")


def survives(is_root: Column, is_event: Column, has_evidence: Column, prob: Column, keep_low: bool = False) -> Column:
    """Root and events stay; others need evidence, and a probability unless ``keep_low``."""
    return is_root | is_event | (has_evidence & (F.lit(keep_low) | (prob > 0)))


def without_orphans(edges: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Edges both of whose ends are among the nodes."""
    ends = nodes.select(F.col(node).alias("_n")).distinct()
    return edges.join(ends, edges["src"] == ends["_n"], "left_semi").join(ends, F.col("dst") == ends["_n"], "left_semi")


def step_matches(step: dict, event_type: Column, text: Column) -> Column:
    """Whether an event is of a type of the step or holds one of its keywords."""
    kinds, words = step.get("types") or [], step.get("keywords") or []
    out = F.lower(event_type).isin([k.lower() for k in kinds]) if kinds else F.lit(False)
    for word in words:
        out = out | F.contains(F.lower(text), F.lit(word.lower()))
    return out


def request_fault(session_id: Column, text: Column, threshold: Column) -> Column:
    """What is wrong with a request, null if nothing: it names a session, brings a text, and
    its threshold, if any, is between 0 and 1."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(session_id), "no session").when(blank(text), "no text").when(~F.coalesce(threshold, F.lit(0.7)).between(0, 1), "threshold out of range")


def valid_rule(rule: dict) -> bool:
    """A rule has a name, steps that ask for something, and a whole number of days."""
    if not isinstance(rule, dict) or not str(rule.get("name") or "").strip():
        return False
    steps = rule.get("steps")
    if not isinstance(steps, list) or not steps or not all(isinstance(s, dict) and (s.get("types") or s.get("keywords")) for s in steps):
        return False
    return str(rule.get("windowDays") or 30).lstrip("-").isdigit()
