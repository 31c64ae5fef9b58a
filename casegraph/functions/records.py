"""Nested JSON records: flattening, search, cleaning, cutting and splitting; event fields.

JSON of any depth has no typed schema, so these functions parse it in Arrow batches.  What
is not JSON gives null.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that are dropped whole, the longest query, and the longest text of a record.
DROPPED_KEY, QUERY_KEY, LONGEST_QUERY, LONGEST_TEXT, LONGEST_PREPROCESSED = "response_text", "query", 100, 20_000, 10_000
# Fixed value: how evidence that was routed through an affiliation begins.
ROUTING_LINE = r"^Evidence through affiliations[^\n]*(\n|$)"
_EMPTY = (None, "", [], {})
_CONTROLS = {i: None for i in range(32)} | {0xA0: " "}


def _parsed(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _mapped(column: Column, result: str, function: Callable) -> Column:
    """``function`` of each parsed record; null for null and for what is not JSON."""

    @F.pandas_udf(result)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if (x := _parsed(t)) is None else function(x) for t in texts], dtype=object)

    return run(column)


def _leaves(record: object, path: str = "") -> Iterator[tuple[str, object]]:
    if not isinstance(record, dict):
        return
    for key, value in record.items():
        name = f"{path}.{key}" if path else key
        if isinstance(value, dict):
            yield from _leaves(value, name)
        elif value not in _EMPTY:
            yield name, value


def flattened(record: Column) -> Column:
    """A map of dotted keys to the leaves of a JSON object that are not empty, as text."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    return _mapped(record, "map<string,string>", lambda x: {k: text(v) for k, v in _leaves(x)})


def _first(record: object, key: str):
    """Depth first: the value of the key here, else in what lies below, in order."""
    if isinstance(record, dict) and key in record:
        return record[key]
    below = record.values() if isinstance(record, dict) else record if isinstance(record, list) else ()
    return next((v for x in below if (v := _first(x, key)) is not None), None)


def found_value(record: Column, key: str) -> Column:
    """The first value of a key at any depth, as text."""

    def value(x: object) -> str | None:
        v = _first(x, key)
        return v if v is None or isinstance(v, str) else json.dumps(v)

    return _mapped(record, "string", value)


def _full(x: object):
    if isinstance(x, dict):
        return {k: _full(v) for k, v in x.items() if v not in _EMPTY}
    return [_full(v) for v in x if v not in _EMPTY] if isinstance(x, list) else x


def without_empty(record: Column) -> Column:
    """The record without empty fields and items, at every depth; what that empties stays."""
    return _mapped(record, "string", lambda x: json.dumps(_full(x)))


def _tagless(text: str) -> str:
    out, rest = [], text
    while (at := rest.find("<")) >= 0 and (end := rest.find(">", at)) >= 0 and "\n" not in rest[at:end]:
        out.append(rest[:at])
        rest = rest[end + 1 :]
    return "".join(out) + rest


def _cut(record: dict, most: int) -> dict:
    out = {}
    for key, value in record.items():
        if isinstance(value, dict):
            if inner := _cut(value, most):
                out[key] = inner
        elif not isinstance(value, str):
            out[key] = value
        else:  # what is left after cleaning is measured, the value stays as it came
            n = len(_tagless(urllib.parse.unquote(value).translate(_CONTROLS)))
            if key != DROPPED_KEY and n <= most and not (key == QUERY_KEY and n > LONGEST_QUERY):
                out[key] = value
    return out


def without_long_texts(record: Column, most: int = LONGEST_TEXT) -> Column:
    """The record without raw responses, long queries and texts of more than ``most``
    characters once they are decoded and free of tags; objects that this empties go."""
    return _mapped(record, "string", lambda x: json.dumps(_cut(x, most)) if isinstance(x, dict) else json.dumps(x))


def preprocessed(record: Column) -> Column:
    """A record on one line, without its long texts."""
    return without_long_texts(F.translate(record, "\n\r\t", "   "), LONGEST_PREPROCESSED)


def _as_objects(x: object):
    """Lists as objects by place, so that they can be split."""
    if isinstance(x, list):
        return {str(i): _as_objects(v) for i, v in enumerate(x)}
    return {k: _as_objects(v) for k, v in x.items()} if isinstance(x, dict) else x


def json_pieces(record: object, most: int) -> list[dict]:
    """The record as objects of about ``most`` characters of JSON, each value under its own path.

    Values go into the last piece while they fit; what does not fit is taken apart, in a
    new piece if the last one is nearly full.
    """
    least = max(most - 200, 50)
    pieces: list[dict] = [{}]

    def put(path: tuple, value: object) -> None:
        at = pieces[-1]
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = value

    def place(path: tuple, value: object) -> None:
        if not isinstance(value, dict):
            put(path, value)
            return
        for key, inner in value.items():
            held = len(json.dumps(pieces[-1]))
            if len(json.dumps({key: inner})) < most - held:
                put((*path, key), inner)
            else:
                if held >= least:
                    pieces.append({})
                place((*path, key), inner)

    place((), _as_objects(record))
    return [x for x in pieces if x]


def json_chunks(record: Column, most: int) -> Column:
    """An array of JSON pieces that keep the record's structure."""
    return _mapped(record, "array<string>", lambda x: [json.dumps(p) for p in json_pieces(x, most)] if isinstance(x, dict | list) else [json.dumps(x)])


def is_json(text: Column) -> Column:
    return F.coalesce(_mapped(text, "boolean", lambda _: True), F.lit(False))


def claim_text(reasoning: Column, quotes: Column) -> Column:
    """What a piece of evidence says: its reasoning without the routing line, and its quotes."""
    parts = F.concat(F.array(F.regexp_replace(F.coalesce(reasoning, F.lit("")), ROUTING_LINE, "")), F.coalesce(quotes, F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), " ")


def trimmed(text: Column, width: int = 220) -> Column:
    """A text on one line, cut with an ellipsis."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.substring(line, 1, width - 1), F.lit("…")))


def as_list(value: Column) -> Column:
    """A value as an array of one, nothing as an empty one."""
    return F.when(value.isNotNull(), F.array(value)).otherwise(F.slice(F.array(value), 1, 0))


def as_number(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def as_text(values: Column) -> Column:
    """The items of an array that say something, joined."""
    return F.array_join(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), ", ")


def norm_text(text: Column) -> Column:
    """Upper case with single spaces."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def event_type(data: Column) -> Column:
    """The lower-case type of an event's JSON data, of several the first; empty without one."""
    kind = F.coalesce(F.get_json_object(data, "$.event_type[0]"), F.get_json_object(data, "$.event_type"), F.lit(""))
    return F.lower(F.trim(kind))


def event_dates(data: Column) -> Column:
    """The dates of an event's JSON data, which may be one or a list."""
    several = F.from_json(F.get_json_object(data, "$.date"), "array<string>")
    one = F.get_json_object(data, "$.date")
    dates = F.coalesce(several, F.array(one))
    return F.filter(dates, lambda x: x.isNotNull() & (F.trim(x) != ""))


def participant_names(participants: Column) -> Column:
    """Distinct upper-case names of an array of (name, role)."""
    names = F.transform(participants, lambda p: F.upper(F.trim(F.coalesce(p["name"], F.lit("")))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))
