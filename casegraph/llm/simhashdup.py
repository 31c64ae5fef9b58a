"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most three agree in at least five of their eight
bytes.  The inverted index has a posting for each byte value at each byte position, and a
pair is a candidate once it has been found in five postings at least; candidates are then
verified bit by bit.

Single postings hold a 256th of all fingerprints each, so they are intersected before
pairs are tallied: of any ``m + 3`` positions, a linked pair shares ``m`` at least, so it
stands in one of the intersections of ``m`` postings over these positions.  ``m`` follows
the number of fingerprints, which keeps chance pairs rare.  Where an intersection is long
all the same, its members are filed once more by each five positions.  What they share is
then the guaranteed minimum already, and what is left of a fingerprint has 24 bits: such a
posting has a proven bound, and beyond a few thousand members neighbours are looked up by
their bits, which costs the same for each member however dense the posting is.

A posting yields a star for each set of linked fingerprints and not its pairs; copies share
a fingerprint and are not compared at all.  Stars are joined by large-star and small-star.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.components import connected_components
from casegraph.llm.hot import joined_hot
from casegraph.llm.memory import trimmed
from casegraph.llm.scratch import materialize
from casegraph.llm.text import pieces_of

SEED = 42
BYTES = 8
#: Members up to which a posting's pairs are tallied as they come.
LONG_POSTING = 1024
#: Members of a five-byte posting from which neighbours are looked up by their bits.
LOOKED_UP = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The 64 bits that are set in over half of the shingles' hashes; 0 without words."""
    votes, n = np.zeros((BYTES, 256), np.int64), 0
    waiting: list[bytes] = []

    def vote(words: list[bytes], size: int) -> int:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        ends = starts + lengths
        spans = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)
        digests = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in spans])
        table = np.frombuffer(digests, np.uint8).reshape(-1, BYTES)
        for at in range(BYTES):
            votes[at] += np.bincount(table[:, at], minlength=256)
        return len(table)

    for piece in pieces_of((text or "").encode().lower()):
        words = waiting + piece.split()
        if len(words) >= shingle_words:
            n += vote(words, shingle_words)
        waiting = words[len(words) - shingle_words + 1 :] if len(words) >= shingle_words else words
    if not n and waiting:
        n = vote(waiting, len(waiting))
    ones = (votes @ _BITS).reshape(-1)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def merged(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The labels with the ends of each edge joined; a label is the least place of its set."""
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def linked(x: np.ndarray, radius: int) -> np.ndarray:
    """Which differences of fingerprints (uint64) share bytes enough and pass verification."""
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    out = shared >= BYTES - radius
    out[out] = np.bitwise_count(x[out]) <= radius
    return out


def tallied(runs: np.ndarray, marks: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the linked marks of each run; ``runs`` numbers the runs in order."""
    labels = np.arange(len(marks))
    at, gap = labels, 1
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    while True:
        at = at[at < len(marks) - gap]
        at = at[runs[at + gap] == runs[at]]
        if not len(at):
            break
        near = at[linked(marks[at] ^ marks[at + gap], radius)]
        held.append((near, near + gap))
        n += len(near)
        if n > 1 << 20:
            labels, held, n = merged(labels, *map(np.concatenate, zip(*held, strict=True))), [], 0
        gap += 1
    return merged(labels, *map(np.concatenate, zip(*held, strict=True))) if held else labels


def looked_up(rest: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """Labels of the distinct numbers below ``1 << bits`` that differ in ``radius`` bits at most."""
    place = np.full(1 << bits, -1, np.int32)
    place[rest] = np.arange(len(rest), dtype=np.int32)
    own = np.arange(len(rest))
    labels = own.copy()
    for n in range(1, radius + 1):
        for flips in itertools.combinations(range(bits), n):
            found = place[rest ^ sum(1 << b for b in flips)]
            u = np.flatnonzero(found > own)
            labels = merged(labels, u, found[u].astype(np.int64))
    return labels


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``combination, run, mark`` of whole postings, from rows sorted by posting."""

    def numbered(parts: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = pd.concat(parts)
        combination, shared = rows["combination"].to_numpy(), rows["shared"].to_numpy()
        new = (combination[1:] != combination[:-1]) | (shared[1:] != shared[:-1])
        return combination, np.concatenate([[0], np.cumsum(new)]), rows["mark"].to_numpy().astype(np.int64).view(np.uint64)

    waiting: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch["combination"] == batch["combination"].iloc[-1]) & (batch["shared"] == batch["shared"].iloc[-1])
        begins = int(np.flatnonzero(~last.to_numpy())[-1]) + 1 if not last.all() else 0
        first = waiting and (waiting[0][["combination", "shared"]].iloc[0] != batch[["combination", "shared"]].iloc[0]).any()
        if begins or first:
            yield numbered([*waiting, batch.iloc[:begins]])
            waiting = []
        waiting.append(batch.iloc[begins:])
    if waiting:
        yield numbered(waiting)


def _combinations(m: int, radius: int) -> list[tuple[int, ...]]:
    return list(itertools.combinations(range(m + radius), m))


def _postings(marks: DataFrame, m: int, radius: int) -> DataFrame:
    """``mark, combination, shared``: the intersections of ``m`` postings that a mark is in."""
    masks = [sum(0xFF << (8 * at) for at in positions) for positions in _combinations(m, radius)]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in masks]
    filed = [F.struct(F.lit(i).alias("combination"), F.col("mark").bitwiseAND(F.lit(x)).alias("shared")) for i, x in enumerate(signed)]
    return marks.select("mark", F.explode(F.array(*filed)).alias("posting")).select("mark", "posting.*")


def _in_stars(postings: DataFrame, positions: list[tuple[int, ...]] | None, radius: int) -> DataFrame:
    """``u, v``: stars over the linked marks of each posting.

    With ``positions``, those that the postings of each combination share, long postings
    are looked up by the bits of the other bytes.
    """

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for combination, runs, marks in _runs(batches):
            labels = np.arange(len(marks))
            sizes = np.bincount(runs)
            long = np.flatnonzero(sizes > LOOKED_UP) if positions else []
            for run in long:
                own = np.flatnonzero(runs == run)
                rest = np.zeros(len(own), np.int64)
                free = [x for x in range(BYTES) if x not in positions[combination[own[0]]]]
                for i, at in enumerate(free):
                    rest |= ((marks[own] >> np.uint64(8 * at)) & np.uint64(0xFF)).astype(np.int64) << (8 * i)
                labels[own] = own[looked_up(rest, 8 * len(free), radius)]
            short = np.flatnonzero(~np.isin(runs, long))
            labels[short] = short[tallied(runs[short], marks[short], radius)]
            ends = np.flatnonzero(labels != np.arange(len(marks)))
            yield pd.DataFrame({"u": marks[ends].view(np.int64), "v": marks[labels[ends]].view(np.int64)})

    dealt = postings.repartition("combination", "shared").sortWithinPartitions("combination", "shared")
    return dealt.mapInPandas(trimmed(stars), "u long, v long")


def linked_marks(marks: DataFrame, *, radius: int = 3, owner: str = "query") -> DataFrame:
    """``node, component`` of the distinct marks (``mark``, long) that are linked with others.

    A component is named by its least mark.
    """
    n = marks.count()
    m = next(x for x in range(1, BYTES - radius + 1) if 256**x >= 16 * n or x == BYTES - radius)
    filed = _postings(marks, m, radius)
    sizes = filed.groupBy("combination", "shared").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = materialize(sizes.withColumn("size", F.col("n")), "postings", owner)
    members = materialize(joined_hot(filed, sizes, ["combination", "shared"]), "members", owner)
    at_end = m == BYTES - radius
    long = members.filter(F.col("size") > LONG_POSTING).select("mark").distinct() if not at_end else marks.limit(0)
    short = members if at_end else members.filter(F.col("size") <= LONG_POSTING)
    links = _in_stars(short.drop("size"), _combinations(m, radius) if at_end else None, radius)
    deep = _in_stars(_postings(long, BYTES - radius, radius), _combinations(BYTES - radius, radius), radius)
    return connected_components(materialize(links.union(deep), "stars-of-postings", owner), owner)


def simhash_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = 3,
    radius: int = 3,
    owner: str = "query",
) -> DataFrame:
    """``key, fingerprint, component_id, n_equal`` for every row of ``docs``.

    Words are lower-cased (A-Z); shingles count as often as they occur, and a text of fewer
    words is one shingle.  Rows are linked where fingerprints differ in at most ``radius``
    bits (3 at most); a component is named by the least key that can be reached.
    ``n_equal`` is the number of rows with the same fingerprint.

    Null, empty and blank texts have the fingerprint zero, which is linked like any other.
    Long texts are read in pieces of a MiB.  Null keys never name a component that has
    others; repeated rows and keys are rows of their own.  An empty table gives an empty
    table; other input columns are dropped.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the index has five of eight bytes in common at the least: radius is 0 to 3")

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle_words) for x in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"key": batch["key"], "mark": found})

    key_type = docs.schema[key].dataType.simpleString()
    selected = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = materialize(selected.mapInPandas(trimmed(marked), f"key {key_type}, mark long"), "marks", owner)
    classes = materialize(rows.groupBy("mark").agg(F.count("*").alias("n"), F.min("key").alias("least")), "classes", owner)
    reached = linked_marks(classes.select("mark"), radius=radius, owner=owner).withColumnRenamed("node", "mark")
    placed = classes.join(reached, "mark", "left").select("mark", F.col("n").alias("n_equal"), "least", F.coalesce("component", "mark").alias("component"))
    placed = materialize(placed, "placed", owner)
    heads = materialize(placed.groupBy("component").agg(F.min("least").alias("head"), F.count("*").alias("n")), "heads", owner)
    judged = joined_hot(placed.select("mark", "n_equal", "component"), heads, ["component"]).select("mark", "n_equal", F.col("n_equal").alias("n"), "head")
    out = joined_hot(rows, materialize(judged, "judged", owner), ["mark"])
    digits = F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint")
    return out.select(F.col("key").alias(key), digits, F.col("head").alias("component_id"), "n_equal")


def op11_simhash_duplicates(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
