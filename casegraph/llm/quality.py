"""Quality rules: base features of each text, and cross-document line frequency by host.

Lines are normalised and hashed; for each host the distinct texts that hold a line are
counted.  Lines above the host's limit are boilerplate and go; documents of which little
is left are rejected.

Counts are taken over (host, line, text) first and over (host, line) after that, so a
line that a third of all documents hold is summed before it is shuffled.  The lines above
the limits go to the Python workers while they are at most ``max_shared_lines``; beyond
that they are joined to the documents' lines by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.columns import packed, unpacked
from casegraph.llm.hot import joined_hot, left_joined_salted
from casegraph.llm.memory import trim, trimmed
from casegraph.llm.scratch import materialize
from casegraph.llm.text import shingle_hashes, word_hashes

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Limits of the rules, all parameters.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_TEXTS = 20
HOST_PERCENT = 2
MIN_LEFT_PERCENT = 20


def _normal(line: str) -> str:
    """A line in lower case with single spaces."""
    return " ".join(x for x in line.lower().translate(_TO_SPACE).split(" ") if x)


_TO_SPACE = dict.fromkeys(map(ord, SPACES), " ")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def line_key(host: str | None, line: str) -> int | None:
    """64-bit key of a host and a normalised line; null for a line without words."""
    text = _normal(line)
    if not text:
        return None
    tag = "-" if host is None else "+" + host
    return _signed(xxhash.xxh3_64_intdigest(f"{len(tag)}:{tag}{text}".encode()))


def repeated_words(data: bytes, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice in the text."""
    words = word_hashes(data)
    if len(words) < window:
        return 0
    hashes = shingle_hashes(words, window)
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def features(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = text or ""
    data = text.encode()
    worded = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(data.split()),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(worded) - len(set(worded)),
        repeated_words(data),
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def frequent_lines(docs: DataFrame, text: str, host: str, min_texts: int, host_percent: int) -> DataFrame:
    """``line_key, n``: lines that more texts of their host hold than the host's limit, and
    how many rows hold them."""
    schema = "host string, line_key long, text_key long"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, keys, texts = [], [], []
            for h, x in zip(batch["host"].to_pylist(), batch["text"], strict=True):
                if not (x := x.as_py()):
                    continue
                own = {k for k in (line_key(h, line) for line in x.split("\n")) if k is not None}
                hosts += [h] * len(own)
                keys += own
                texts += [_signed(xxhash.xxh3_64_intdigest(x.encode()))] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(texts, pa.int64())], names=["host", "line_key", "text_key"])

    selected = docs.select(F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    held = selected.mapInArrow(trimmed(lines), schema)
    per_line = held.groupBy("line_key").agg(F.countDistinct("text_key").alias("texts"), F.first("host").alias("host"), F.count("*").alias("n"))
    filled = selected.filter(F.length("text") > 0).select("host", F.xxhash64("text").alias("text_key"))
    per_host = filled.groupBy("host").agg(F.countDistinct("text_key").alias("host_texts"))
    candidates = per_line.filter(F.col("texts") > min_texts)
    limit = F.greatest(F.lit(min_texts), F.col("host_texts") * host_percent / 100)
    joined = candidates.join(per_host, candidates["host"].eqNullSafe(per_host["host"]))
    return joined.filter(F.col("texts") > limit).select("line_key", "n")


def _with_removed(docs: DataFrame, lines: DataFrame, text: str, host: str, owner: str) -> DataFrame:
    """Rows as ``_row`` with the numbers of their lines that are in ``lines``, by joins.

    A boilerplate line is held by many rows, and a copied text by many as well: the lines
    that most rows hold are broadcast, and rows of much copied texts are dealt out.
    """
    schema = "text_key long, host string, line_no int, line_key long"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, done = [], set()
            for k, h, x in zip(*(batch[c].to_pylist() for c in ("text_key", "host", "text")), strict=True):
                if (k, h) in done:
                    continue
                done.add((k, h))
                for i, line in enumerate((x or "").split("\n")):
                    if (own := line_key(None if h == "-" else h[1:], line)) is not None:
                        rows.append((k, h, i, own))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["text_key", "host", "line_no", "line_key"])

    name = F.col(host).cast("string")
    key = F.xxhash64(F.when(F.col(text).isNull(), "-").otherwise("+"), text, F.octet_length(text))
    rows = docs.select(packed(docs).alias("_row"), key.alias("text_key"), F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), name)).alias("host"), F.col(text).alias("text"))
    found = joined_hot(rows.select("text_key", "host", "text").mapInArrow(trimmed(numbered), schema), lines, ["line_key"])
    removed = found.groupBy("text_key", "host").agg(F.collect_set("line_no").alias("_removed"))
    removed = materialize(removed, "removed-lines", owner)
    return left_joined_salted(rows.drop("text"), removed, ["text_key", "host"], owner).select("_row", "_removed")


def apply_quality_rules(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    min_texts: int = MIN_TEXTS,
    host_percent: int = HOST_PERCENT,
    min_left_percent: int = MIN_LEFT_PERCENT,
    max_shared_lines: int = 200_000,
    owner: str = "query",
) -> DataFrame:
    """Every row with its features, its verdicts and its text without boilerplate lines.

    Added: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (of the whole
    text), ``base_failed``, ``n_words_left`` and ``clean_text`` (after the removal) and
    ``kept``.  A line is boilerplate if more distinct texts of its host hold it than
    ``min_texts`` and ``host_percent`` of the host's texts.  Exact copies count once.
    A row is kept unless it fails the base rules or, having lost lines, has less than
    ``min_left_percent`` of its words left.

    A null text has no words and fails; its clean text is null.  A null host is a host.
    Repeated rows get the same verdict.  An empty table gives an empty table.  Input
    columns of the added names are replaced.  Lines are told apart by 64-bit hashes of
    host and line.  A very long text is judged whole, in the memory of its task.
    """
    lines = materialize(frequent_lines(docs, text, host, min_texts, host_percent), "lines", owner)
    n_lines = lines.count()
    shared = None
    if n_lines <= max_shared_lines:  # some 20 MB in each worker at most
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["line_key"] for r in lines.collect()))
        rows = docs.select(packed(docs).alias("_row"), F.lit(None).cast("array<int>").alias("_removed"))
    else:
        rows = _with_removed(docs, lines, text, host, owner)
    names = docs.columns
    added = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("n_words_left", "long"), ("clean_text", "string"), ("kept", "boolean")]
    result = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in added])

    @F.pandas_udf(result)
    def judged(texts: pd.Series, hosts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        rows = []
        for x, h, gone in zip(texts, hosts, removed, strict=True):
            found = features(x)
            failed = base_failed(found[0], found[4])
            all_lines = (x or "").split("\n")
            if shared is not None:
                drop = {i for i, line in enumerate(all_lines) if line_key(h, line) in shared.value}
            else:
                drop = set() if gone is None else set(gone)
            clean, left = x, found[0]
            if drop:
                clean = "\n".join(line for i, line in enumerate(all_lines) if i not in drop)
                left = len(clean.encode().split())
            depleted = bool(drop) and 100 * left < min_left_percent * found[0]
            rows.append((*found, failed, left, clean, not failed and not depleted))
        trim()
        return pd.DataFrame(rows, columns=[n for n, _ in added])

    judged = judged.asNondeterministic()  # else a filter on a verdict would judge every text once more
    verdict = judged(F.col("_row")[text], F.col("_row")[host].cast("string"), F.col("_removed"))
    judged_rows = rows.select("_row", verdict.alias("_v"))
    return unpacked(judged_rows, "_row", names, **{n: F.col("_v")[n] for n, _ in added})


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Features and verdicts of all documents."""
    judged = apply_quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
ln AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
lw AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM ln),
lk AS (SELECT *, lower(array_to_string(ws, ' ')) AS k, len(ws) AS n FROM lw WHERE len(ws) > 0),
hosts AS (SELECT source, count(DISTINCT text) AS host_texts FROM documents WHERE text <> '' GROUP BY source),
freq AS (SELECT lk.source, k, count(DISTINCT text) AS texts FROM lk GROUP BY lk.source, k),
gone AS (SELECT f.source, f.k FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
         WHERE f.texts > 20 AND f.texts > h.host_texts * 2 / 100),
lost AS (SELECT lk.doc_id, CAST(sum(lk.n) AS BIGINT) AS lost FROM lk JOIN gone g ON lk.source IS NOT DISTINCT FROM g.source AND lk.k = g.k GROUP BY lk.doc_id),
dup AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM lk GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, w FROM d WHERE len(w) >= 8),
wk AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 7), ' ') AS s FROM win),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM wk) WHERE c > 1),
rw AS (SELECT doc_id, CAST(count(DISTINCT q) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM rep) GROUP BY doc_id),
f AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(rw.n_repeat_words, 0) AS n_repeat_words, lost.lost
      FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN rw ON d.doc_id = rw.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id),
v AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_words - coalesce(lost, 0) AS n_words_left FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (lost IS NOT NULL AND 100 * n_words_left < 20 * n_words) AS kept, n_words_left FROM v
"""
