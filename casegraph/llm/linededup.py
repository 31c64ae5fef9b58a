"""Line dedup by content-defined chunks of lines, and by all repeated passages.

A rolling hash over the hashes of neighbouring lines picks chunk bounds, so that a passage
is cut alike wherever it stands.  Chunks are counted over all documents by 128-bit hash;
of a repeated chunk of several lines all but the first occurrence are removed, after their
bytes have been compared with the first's.

The lines at a passage's edges share chunks with other lines, and so does the whole of a
short passage.  Therefore the shortest windows of lines with enough words are counted as
well, one from each line on and one up to each line: a line is in some repeated run of
lines with enough words if and only if it is in a repeated window.  Windows are told apart
by 128-bit BLAKE2b digests of their lines' digests.

What is shuffled is a row of numbers for each chunk and each window, and the bytes of
repeated chunks.  The lists of repeated chunks and windows are broadcast to the documents
while they are short, and joined to them by row beyond that.  Chunks and windows that very
many documents hold meet their first place in a broadcast and not in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.columns import packed, unpacked
from casegraph.llm.hot import joined_hot
from casegraph.llm.memory import trim, trimmed
from casegraph.llm.scratch import materialize

#: One line pair in this many ends a chunk.
BOUND_EVERY = 2
#: A chunk has two lines at least, or one of so many words.
LONG_LINE_WORDS = 50
#: Shorter chunks are never removed.
MIN_CHUNK_WORDS = 8
#: A run of lines with so many words, be it one line, is a passage.
PASSAGE_WORDS = 50
_MASK = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """Bounds of the chunks of a text's lines: after a line whose hash, rolled with the line
    before it, is a multiple of ``BOUND_EVERY``, if the chunk is large enough by then."""
    out, start, words, before = [], 0, 0, 0
    for i, line in enumerate(lines):
        own = xxhash.xxh3_64_intdigest(line.encode())
        rolled = ((before * _FACTOR) ^ own) & _MASK
        words += len(line.encode().split())
        if (rolled >> 20) % BOUND_EVERY == 0 and (i > start or words >= LONG_LINE_WORDS):
            out.append((start, i + 1))
            start, words = i + 1, 0
        before = own
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def removable(lines: list[str], start: int, end: int) -> bool:
    """Whether a chunk may be removed: several lines with words enough."""
    return end - start > 1 and sum(len(x.encode().split()) for x in lines[start:end]) >= MIN_CHUNK_WORDS


def windows(n_words: list[int], least: int = PASSAGE_WORDS) -> list[tuple[int, int]]:
    """The shortest windows of lines with ``least`` words, from each line with words on and
    up to each such line; they begin and end with lines that have words."""
    at = [i for i, n in enumerate(n_words) if n]
    out: set[tuple[int, int]] = set()
    first = last = 0
    total = ending = 0
    for i, line in enumerate(at):
        ending += n_words[line]
        while ending - n_words[at[first]] >= least:
            ending -= n_words[at[first]]
            first += 1
        if ending >= least:
            out.add((at[first], line + 1))
        while last < len(at) and total < least:
            total += n_words[at[last]]
            last += 1
        if total >= least:
            out.add((line, at[last - 1] + 1))
        total -= n_words[line]
    return sorted(out)


def _window_rows(lines: list[str], least: int) -> Iterator[tuple[int, int, int, int]]:
    """Bounds and digests of a text's windows."""
    data = [x.encode() for x in lines]
    bounds = windows([len(x.split()) for x in data], least)
    digests = [hashlib.blake2b(x, digest_size=16).digest() for x in data] if bounds else []
    for start, end in bounds:
        h = hashlib.blake2b(b"".join(digests[start:end]), digest_size=16).digest()
        yield start, end, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def _with_passages(chunks: list | None, passages: list | None) -> list[dict]:
    """Removed chunks, and runs of the other lines of removed windows with their first key.

    Of the windows over a line the first one names the key.
    """
    out = [{"start": x["start"], "end": x["end"], "first_key": x["first_key"], "kind": "chunk"} for x in (() if chunks is None else chunks)]
    done = {i for x in out for i in range(x["start"], x["end"])}
    run = None
    for x in sorted(() if passages is None else passages, key=lambda x: (x["start"], x["end"])):
        for i in range(x["start"], x["end"]):
            if i in done:
                continue
            done.add(i)
            if run and run["end"] == i and run["first_key"] == x["first_key"]:
                run["end"] = i + 1
            else:
                run = {"start": i, "end": i + 1, "first_key": x["first_key"], "kind": "passage"}
                out.append(run)
    return sorted(out, key=lambda x: x["start"])


def _repeated(places: DataFrame, max_shared: int, owner: str) -> DataFrame:
    """The places whose digest ``h1, h2`` stands at several; most digests stand at one."""
    several = materialize(places.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "repeated", owner)
    if several.count() <= max_shared:
        return places.join(F.broadcast(several.select("h1", "h2")), ["h1", "h2"], "left_semi")
    return joined_hot(places, several, ["h1", "h2"])


def _repeated_windows(selected: DataFrame, least: int, max_shared: int, owner: str) -> DataFrame:
    """``_a, _b, start, end, first_key`` of the windows that stand at an earlier place too.

    Where a window overlaps its first place in the same text, the lines of that stay.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, k, x in zip(batch["_a"], batch["_b"], batch["_key"], batch["_text"], strict=True):
                rows += [(a, b, k, *row) for row in _window_rows((x or "").split("\n"), least)]
            out = pd.DataFrame(rows, columns=["_a", "_b", "_key", "start", "end", "h1", "h2"])
            yield out.astype({"_key": batch["_key"].dtype}) if len(out) else out

    key_type = selected.schema["_key"].dataType.simpleString()
    every = selected.mapInPandas(trimmed(found), f"_a long, _b long, _key {key_type}, start int, end int, h1 long, h2 long")
    every = materialize(every, "windows", owner)
    places = materialize(_repeated(every, max_shared, owner), "window-places", owner)
    order = F.struct("_key", "_b", "start", "_a", "end")
    first = places.groupBy("h1", "h2").agg(F.min(order).alias("_first"), F.count("*").alias("n"))
    later = joined_hot(places, materialize(first, "first-windows", owner), ["h1", "h2"]).filter(order != F.col("_first"))
    own = (F.col("_a") == F.col("_first._a")) & (F.col("_b") == F.col("_first._b"))
    start = F.when(own, F.greatest("start", "_first.end")).otherwise(F.col("start")).alias("start")
    later = later.select("_a", "_b", start, "end", F.col("_first._key").alias("first_key")).filter("start < end")
    return materialize(later.distinct(), "later-windows", owner)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _joined_by_row(docs: DataFrame, lists: DataFrame, n: int, max_shared: int, how: str) -> DataFrame:
    return docs.join(F.broadcast(lists) if n <= max_shared else lists, ["_a", "_b"], how)


def dedup_lines(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    max_shared: int = 1_000_000,
    passage_words: int | None = PASSAGE_WORDS,
    owner: str = "query",
) -> DataFrame:
    """Every row with ``clean_text``, its text without repeated chunks, and what was removed.

    ``removed`` has for each removed chunk ``start``, ``end`` (lines, end exclusive),
    ``first_key``, the key of the document that keeps it: the least key, then the first
    place, and ``kind`` (chunk or passage).  Repetitions within a text count as well.  Chunks are removed whole; lines are
    split at "\\n" and joined again.  Then the other lines go that stand in a run of lines
    with ``passage_words`` words or more which stands at an earlier place as well (None for
    chunks only); they are listed by runs of one ``first_key``.  Blank lines around such a
    run stay.

    A null or empty text stays as it is.  Null keys sort first.  Rows alike in key and text
    are one document and keep the same chunks.  An empty table gives an empty table.
    Input columns of the added names are replaced.  ``max_shared`` is the number of
    repeated digests, and of places of them, up to which they are broadcast (64 bytes each,
    64 MB at the default).
    """
    names = docs.columns
    row = (F.xxhash64(key, text).alias("_a"), F.xxhash64(text, key, F.octet_length(text)).alias("_b"))
    selected = docs.select(*row, F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = "_a long, _b long, at int, h1 long, h2 long"

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, x in zip(batch["_a"], batch["_b"], batch["_text"], strict=True):
                lines = (x or "").split("\n")
                for start, end in chunks(lines):
                    if removable(lines, start, end):
                        h = xxhash.xxh3_128_intdigest("\n".join(lines[start:end]).encode())
                        rows.append((a, b, start, _signed(h >> 64), _signed(h & _MASK)))
            yield pd.DataFrame(rows, columns=["_a", "_b", "at", "h1", "h2"]).astype({"_a": "int64", "_b": "int64", "at": "int32", "h1": "int64", "h2": "int64"})

    found = selected.select("_a", "_b", "_text").mapInPandas(trimmed(hashed), schema)
    keyed = materialize(found, "chunks", owner)
    places = _repeated(keyed, max_shared, owner).distinct()  # rows alike in key and text are one document
    places = materialize(places, "places", owner)
    n = places.count()
    lists = places.groupBy("_a", "_b").agg(F.collect_list(F.struct("at", "h1", "h2")).alias("_list"))
    with_lists = _joined_by_row(selected, lists, n, max_shared, "inner")
    key_type = docs.schema[key].dataType.simpleString()

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, done = [], set()
            for a, b, k, x, own in zip(batch["_a"], batch["_b"], batch["_key"], batch["_text"], batch["_list"], strict=True):
                if (a, b) in done:
                    continue
                done.add((a, b))
                lines = x.split("\n")
                ends = dict(chunks(lines))
                for place in own:
                    at = place["at"]
                    rows.append((a, b, k, at, ends[at], place["h1"], place["h2"], "\n".join(lines[at : ends[at]]).encode()))
            out = pd.DataFrame(rows, columns=["_a", "_b", "_key", "at", "end", "h1", "h2", "bytes"])
            yield out.astype({"_key": batch["_key"].dtype}) if len(out) else out

    texts = with_lists.mapInPandas(trimmed(cut_out), f"_a long, _b long, _key {key_type}, at int, end int, h1 long, h2 long, bytes binary")
    texts = materialize(texts, "texts", owner)
    order = F.struct(F.col("_key"), F.col("_b"), F.col("at"))
    leading = texts.groupBy("h1", "h2").agg(F.min(order).alias("_first"), F.min_by("bytes", order).alias("_bytes"), F.count("*").alias("n"))
    gone = joined_hot(texts, materialize(leading, "leading", owner), ["h1", "h2"])
    gone = gone.filter((order != F.col("_first")) & (F.col("bytes") == F.col("_bytes")))
    gone = gone.select("_a", "_b", F.struct(F.col("at").alias("start"), "end", F.col("_first._key").alias("first_key"), F.lit("chunk").alias("kind")).alias("_gone"))
    gone = materialize(gone.distinct(), "gone", owner)
    removed = gone.groupBy("_a", "_b").agg(F.sort_array(F.collect_list("_gone")).alias("_removed"))
    if passage_words is not None:
        later = _repeated_windows(selected, passage_words, max_shared, owner)
        n = max(n, later.count())

        @F.pandas_udf(removed.schema["_removed"].dataType)
        def both(chunks: pd.Series, passages: pd.Series) -> pd.Series:
            return pd.Series([_with_passages(x, y) for x, y in zip(chunks, passages, strict=True)])

        passages = later.groupBy("_a", "_b").agg(F.collect_list(F.struct("start", "end", "first_key")).alias("_passages"))
        removed = removed.join(passages, ["_a", "_b"], "full").select("_a", "_b", both("_removed", "_passages").alias("_removed"))
        removed = materialize(removed, "removed", owner)
    rows_of = docs.select(packed(docs).alias("_row"), *row)
    final = _joined_by_row(rows_of, removed, n, max_shared, "left")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for x, own in zip(texts, lists, strict=True):
            if own is not None and len(own):
                lines = x.split("\n")
                drop = {i for place in own for i in range(place["start"], place["end"])}
                x = "\n".join(line for i, line in enumerate(lines) if i not in drop)
            out.append(x)
        trim()
        return pd.Series(out, dtype=object)

    cleaned = cleaned.asNondeterministic()  # else a filter on the clean text would clean every text once more
    body = F.col("_row")[text]
    clean = F.when(F.col("_removed").isNull(), body).otherwise(cleaned(F.when(F.col("_removed").isNotNull(), body), "_removed"))
    empty = F.array().cast(f"array<struct<start:int,end:int,first_key:{key_type},kind:string>>")
    return unpacked(final, "_row", names, clean_text=clean, removed=F.coalesce("_removed", empty))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without repeated chunks and passages, with what was removed."""
    deduped = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lines = F.transform("removed", lambda x: x["end"] - x["start"])
    return deduped.select(
        "doc_id",
        F.col("clean_text").alias("text"),
        F.size(F.filter("removed", lambda x: x["kind"] == "chunk")).cast("long").alias("n_removed_chunks"),
        F.size(F.filter("removed", lambda x: x["kind"] == "passage")).cast("long").alias("n_removed_passages"),
        F.aggregate(lines, F.lit(0), lambda a, x: a + x).cast("long").alias("n_removed_lines"),
        F.transform("removed", lambda x: x["first_key"]).alias("first_doc_ids"),
    )
