"""Near-duplicate documents: MinHash, banding, verification, connected components.

1. One pass over the texts writes, for each row, a key of its word sequence, its number of
   shingles, its band keys and one byte of each of its minima.  Rows of equal sequences
   become one class, so copies cost no more than their row.
2. Classes that share a band key are candidates.  First each bucket's medoid, its member
   with most bucket-mates, is compared with the others, which joins groups of copies
   without expanding them.
3. A compared pair must agree in its signature bytes and is then confirmed on the full
   shingle sets, read again from the texts of just those documents.  Confirmed links are
   closed by large-star and small-star.
4. Buckets that still hold several components are compared in tiles of bounded size, on
   longer signatures and inside numpy: only pairs of different components that may be
   linked leave a tile, once each, and go through step 3.  A bucket whose members are all
   in one component has nothing left to compare.  Pairs that look surely linked join their
   components within a tile; should step 3 refuse one of them, the buckets that are still
   split are compared once more without such trust.

A pair at the threshold is missed by all bands with probability (1 - t^rows)^bands, 1.5e-5
at the defaults.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.components import connected_components
from casegraph.llm.hot import joined_hot
from casegraph.llm.memory import trim, trimmed
from casegraph.llm.scratch import materialize
from casegraph.llm.text import mix64, shingle_hashes, word_hashes

#: Minima that must agree between signatures, of all: 4.4 standard deviations under 0.8.
LEAST_AGREEMENT = 0.65
_BLOCK = 512
#: Length of the longer signatures, and members in a tile's side.
LONG_SIGNATURE = 512
TILE = 1024


class MinHasher:
    """Minima of ``bands * rows`` multiply-add-shift functions of 32-bit shingle keys."""

    def __init__(self, bands: int, rows: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) | np.uint64(1)
        self.shifts = rng.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        self.powers = np.multiply.accumulate(np.full(rows, np.uint64(0x9E3779B97F4A7C15)))
        self.salts = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        keys = shingles >> np.uint64(32)
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for at in range(0, len(keys), _BLOCK):
            table = keys[at : at + _BLOCK, None] * self.factors
            table += self.shifts
            np.minimum(least, table.min(axis=0), out=least)
        return least >> np.uint64(32)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        mixed = (minima.reshape(self.bands, self.rows) + np.uint64(1)) * self.powers
        return mix64(mixed.sum(axis=1) + self.salts).view(np.int64)


def shingle_set(text: str | None, size: int) -> tuple[bytes, np.ndarray]:
    """Key of the lower-cased word sequence and the sorted distinct shingles; (b"", empty) without words."""
    data = (text or "").encode().lower()
    words = word_hashes(data)
    if not len(words):
        return b"", words
    key = hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest()
    return key, np.unique(shingle_hashes(words, size))


def row_marks(key: str, text: str) -> list[Column]:
    """``row, other``: 128 bits that tell rows apart by key and text; a null is like no value."""
    return [F.xxhash64(key, text).alias("row"), F.xxhash64(text, F.octet_length(text), F.col(text).isNull(), F.col(key).isNull(), key).alias("other")]


def _signed_rows(docs: DataFrame, key: str, text: str, size: int, hasher: MinHasher) -> DataFrame:
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, t) for n, t in (("row", T.LongType()), ("other", T.LongType()), ("class", T.BinaryType()), ("n_shingles", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("signature", T.BinaryType()))]])

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, row, other, x in zip(batch["key"], batch["row"], batch["other"], batch["text"], strict=True):
                own, shingles = shingle_set(x, size)
                if not own:
                    rows.append((k, row, other, None, 0, None, None))
                    continue
                minima = hasher.minima(shingles)
                rows.append((k, row, other, own, len(shingles), hasher.band_keys(minima), minima.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields]).astype({"key": batch["key"].dtype})

    selected = docs.select(F.col(key).alias("key"), *row_marks(key, text), F.col(text).alias("text"))
    return selected.mapInPandas(trimmed(signed), schema)


def _agreeing(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in enough bytes."""

    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean()) for x, y in zip(a, b, strict=True)])

    one = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").filter(agreement("sa", "sb") >= LEAST_AGREEMENT).select("a", "b")


def _only_rows(docs: DataFrame, wanted: DataFrame, max_shared: int = 1_000_000) -> DataFrame:
    """Rows of ``docs`` with a ``row`` in ``wanted``, which is broadcast only if it is small."""
    rows = wanted.select("row").distinct()
    return docs.join(F.broadcast(rows) if wanted.count() <= max_shared else rows, "row", "left_semi")


def _texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Texts of the documents that may belong to the nodes, and the nodes' classes.

    Documents are found by a hash of key and text, since a null key is equal to nothing.
    """
    wanted = classes.join(nodes, "node").select("node", "row", "class")
    texts = docs.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))
    return _only_rows(texts, wanted).select("text"), wanted


def _tile(
    band: int, nodes: np.ndarray, components: np.ndarray, bands: np.ndarray, signatures: np.ndarray, left: np.ndarray, right: np.ndarray, least: float, sure: float
) -> list[tuple[int, int, bool]]:
    """Pairs of ``left`` x ``right`` that may be linked across components, and which are surely.

    A pair counts in the first band that it shares.  Pairs that are surely linked join
    their components here, so that a dense group leaves few of its pairs.
    """
    label = components.copy()
    pairs, unsure = [], []
    triangle = np.array_equal(left, right)
    for i in left:
        others = right[label[right] != label[i]]
        if triangle:
            others = others[nodes[others] > nodes[i]]
        if not len(others):
            continue
        agree = (signatures[others] == signatures[i]).mean(axis=1)
        others, agree = others[agree >= least], agree[agree >= least]
        first = bands[i][(bands[others] == bands[i]).argmax(axis=1)] == band
        others, low = others[first], agree[first] < sure
        if low.any():
            unsure.append(np.stack([np.full(int(low.sum()), i), others[low]]))
        others = others[~low]
        while len(others):
            pairs.append((i, others[0], True))
            label[label == label[others[0]]] = label[i]
            others = others[label[others] != label[i]]
    if unsure:
        one, two = np.concatenate(unsure, axis=1)
        apart = label[one] != label[two]  # what the sure pairs have not joined
        pairs += [(i, j, False) for i, j in zip(one[apart], two[apart], strict=True)]
    return [(min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j])), flag) for i, j, flag in pairs]


def _groups(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of rows that are equal in ``names``, over the bounds of batches."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[names].to_numpy()
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(batch)]
        for at, end in zip(edges, edges[1:], strict=False):
            run = batch.iloc[at:end]
            if kept and tuple(kept[0][names].iloc[0]) != tuple(run[names].iloc[0]):
                yield pd.concat(kept)
                kept = []
            kept.append(run)
    if kept:
        yield pd.concat(kept)


def _tiled(rest: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, share: float, hasher: MinHasher, trusting: bool) -> DataFrame:
    """Pairs of buckets split over components that may be linked, by tiles of the buckets.

    The largest component of a bucket meets the others and never itself, so the copies of a
    hot group are dealt out once for each tile of what is not in it.  Unless ``trusting``,
    no pair counts as surely linked.
    """
    longer = MinHasher(1, LONG_SIGNATURE, seed=6)
    deviation = (share * (1 - share) / LONG_SIGNATURE) ** 0.5
    least, sure = share - 4.5 * deviation, share + 5 * deviation if trusting else 2.0

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for own, shingles in (shingle_set(x, size) for x in batch["text"]):
                if own:
                    rows.append((own, hasher.band_keys(hasher.minima(shingles)), longer.minima(shingles).astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["class", "bands", "signature"])

    texts, wanted = _texts_of(rest.select("node").distinct(), classes, docs, key, text)
    found = texts.mapInPandas(trimmed(signed), "class binary, bands array<long>, signature binary").join(wanted.select("node", "class"), "class")
    found = found.groupBy("node").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    held = rest.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = held.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("mates"))
    main = main.select("band", "main", F.ceil((F.col("mates") - F.col("most")) / TILE).cast("int").alias("minor"), F.ceil(F.col("most") / TILE).cast("int").alias("major"))
    placed = rest.join(main, "band")
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("major")).otherwise(F.col("minor"))).cast("int")
    side = F.when(is_main, F.col("minor") + own).otherwise(own)
    minors = F.sequence(F.lit(0), F.col("minor") - 1)
    with_minor = F.transform(minors, lambda i: F.struct(F.least(i, side).alias("one"), F.greatest(i, side).alias("two")))
    with_major = F.transform(F.sequence(F.col("minor"), F.col("minor") + F.col("major") - 1), lambda k: F.struct(side.alias("one"), k.alias("two")))
    tiles = F.when(is_main, with_minor).otherwise(F.concat(with_minor, with_major))
    placed = placed.select("band", side.alias("own"), "node", "component", F.explode(tiles).alias("tile"))
    placed = placed.select("band", "tile.one", "tile.two", "own", "node", "component")
    spread = placed.join(found, "node").repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in _groups(batches, ["band", "one", "two"]):
            own, one, two = tile["own"].to_numpy(), tile["one"].iloc[0], tile["two"].iloc[0]
            pairs = _tile(
                int(tile["band"].iloc[0]),
                tile["node"].to_numpy(),
                tile["component"].to_numpy(),
                np.stack(tile["bands"].to_list()),
                np.stack([np.frombuffer(x, np.uint8) for x in tile["signature"]]),
                np.flatnonzero(own == one),
                np.flatnonzero(own == two),
                least,
                sure,
            )
            yield pd.DataFrame(pairs, columns=["a", "b", "sure"]).astype({"a": "int64", "b": "int64", "sure": "bool"})

    return spread.mapInPandas(trimmed(compared), "a long, b long, sure boolean")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    texts, wanted = _texts_of(nodes, classes, docs, key, text)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(own, found.tobytes()) for own, found in (shingle_set(x, size) for x in batch["text"]) if own]
            yield pd.DataFrame(rows, columns=["class", "shingles"])

    found = texts.mapInPandas(trimmed(sets), "class binary, shingles binary").join(wanted.select("node", "class"), "class")
    found = found.groupBy("node").agg(F.first("shingles").alias("shingles"))

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            out.append(100 * common >= percent * (len(one) + len(two) - common))
        trim()
        return pd.Series(out)

    one = found.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = found.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(one, "a").join(two, "b").filter(similar("sa", "sb")).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 28,
    rows: int = 5,
    with_marks: bool = False,
    owner: str = "query",
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``, and with
    ``with_marks`` the columns of :func:`row_marks`, by which a verdict finds its row.

    Rows are linked where 100 times the common shingles reach ``percent`` times all
    shingles of both; a component is named by its least key and one row of it is kept,
    the one that has that key.  Shingles are of lower-cased (A-Z) words; a text of fewer
    words is one shingle.

    Null and blank texts have no shingles, are linked with nothing and kept.  Rows that
    repeat a key are rows of their own, of which one is kept if their texts are linked;
    null keys never name a component that has others.  An empty table gives an empty
    table; other input columns are dropped.  Set bits are compared by 64-bit hashes.
    """
    hasher = MinHasher(bands, rows)
    signed = _signed_rows(docs, key, text, shingle_words, hasher)
    signed = materialize(signed.withColumn("node", F.monotonically_increasing_id()), "signed", owner)
    first = F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "node")).alias("first")
    least = signed.filter("class is not null").groupBy("class").agg(F.min(F.struct("node", "row")).alias("_least"), F.count("*").alias("n"), first)
    named = materialize(least.select("class", "_least.node", "_least.row", "n", "first"), "classes", owner)
    firsts = signed.select("node", "bands", "signature").join(named.select("node"), "node", "left_semi")
    firsts = materialize(firsts, "firsts", owner)
    signatures = firsts.select("node", "signature")

    banded = firsts.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("mates")).filter("mates > 1")
    buckets = materialize(banded.join(shared, "band"), "buckets", owner)
    degree = buckets.groupBy("node").agg(F.sum("mates").alias("degree"))
    buckets = materialize(buckets.join(degree, "node").select("band", "node", "degree"), "members", owner)

    labels = materialize(degree.select("node", F.col("node").alias("component")), "labels", owner)
    centre = F.max_by("node", F.struct("degree", -F.col("node"))).alias("centre")
    pairs = buckets.join(buckets.groupBy("band").agg(centre), "band").filter("node <> centre")
    pairs = pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    for turn in range(3):
        if turn:
            members = buckets.join(labels, "node")
            split = members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            rest = members.join(split.filter("lo <> hi").select("band"), "band", "left_semi").select("band", "node", "component")
            rest = materialize(rest, "rest", owner)
            pairs = _tiled(rest, named, docs, key, text, shingle_words, percent / 100, hasher, turn == 1)
            agreeing = pairs.groupBy("a", "b").agg(F.bool_or("sure").alias("sure"))
        else:
            agreeing = _agreeing(pairs, signatures).distinct().withColumn("sure", F.lit(False))
        agreeing = materialize(agreeing, "agreeing", owner)
        if agreeing.isEmpty():
            continue
        links = materialize(_confirmed(agreeing.select("a", "b"), named, docs, key, text, shingle_words, percent), "links", owner)
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("u")), "a")
        ends = ends.join(labels.select(F.col("node").alias("b"), F.col("component").alias("v")), "b")
        merged = connected_components(ends.select("u", "v"), owner).select(F.col("node").alias("component"), F.col("component").alias("_new"))
        merged = materialize(merged.join(labels.groupBy("component").agg(F.count("*").alias("n")), "component"), "merged", owner)
        joined = joined_hot(labels, merged, ["component"]).select("node", F.col("_new").alias("component"))
        labels = materialize(joined.union(labels.join(merged, "component", "left_anti").select("node", "component")), "labels", owner)
        if turn == 1 and agreeing.filter("sure").join(links, ["a", "b"], "left_anti").isEmpty():
            break  # else what was left out for a sure pair that is no link is compared as well

    placed = named.select("class", "node", "n", "first").join(labels, "node", "left")
    placed = materialize(placed.select("class", "n", "first", F.coalesce("component", "node").alias("component")), "placed", owner)
    heads = materialize(placed.groupBy("component").agg(F.min("first").alias("head"), F.count("*").alias("n")), "component-heads", owner)
    classes = materialize(joined_hot(placed.select("class", F.col("n").alias("rows"), "component"), heads, ["component"]).select("class", F.col("rows").alias("n"), "head"), "heads", owner)
    marks = ["row", "other"] if with_marks else []
    rows_of = signed.select("node", "key", "class", "n_shingles", *marks)
    judged = joined_hot(rows_of, classes, ["class"]).select("key", "n_shingles", F.col("head.key").alias("component_id"), (F.col("node") == F.col("head.node")).alias("kept"), *marks)
    alone = rows_of.filter("class is null").select("key", "n_shingles", F.col("key").alias("component_id"), F.lit(True).alias("kept"), *marks)
    return judged.union(alone).withColumnRenamed("key", key)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of all documents at 4 words and a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=4)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
s AS (SELECT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
x AS (SELECT DISTINCT doc_id, s FROM s),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN n ON m.doc_id = n.doc_id
"""
