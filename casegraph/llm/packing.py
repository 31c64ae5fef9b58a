"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenized once into pieces of at most ``max_tokens`` ids.  Only the
histogram of piece lengths (at most ``max_tokens`` numbers) goes to the driver, where
lengths are placed longest first, each onto the shortest pack so far, whole groups of
equal packs at a time.  The packs so found say, for each length, which ranks go to which
sequences; pieces are ranked within their length and looked up there.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.hot import hot_limit
from casegraph.llm.memory import trimmed
from casegraph.llm.scratch import materialize

RANK_BLOCKS = 1024
CACHED_WORDS = 400_000
#: Bytes of the longest word that is kept.
LONGEST_CACHED = 256


_MARKS = b"!#$%&*+,-./:;<=>?@^_`|~"


def _byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers use for each byte: itself if it is
    printable in Latin-1 and no blank, else the next code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in printable]
    return [chr(x) if x in printable else chr(256 + others.index(x)) for x in range(256)]


class WordTokenizer(dict):
    """Ids of whole texts by a tokenizer that lowers case and splits at white space.

    Words repeat, so the ids of up to ``most`` are kept, as bytes by word.  A
    document's ids are those of its words in order.  A word of lower-case letters is one
    unit of the tokenizer and goes straight to its model; marks after it are a unit of
    their own; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # it sees lower-cased words, which are cut already
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        if any(x.normalized or x.single_word or x.lstrip or x.rstrip for x in added.values()):
            raise ValueError("added tokens must be found as they are written")
        self.added = {x.content: array("I", [k]).tobytes() for k, x in added.items()}
        longest_first = sorted(self.added, key=lambda x: (-len(x), x))
        self.cuts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        self.letters = _byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        text = core.decode()
        if not text.isalpha() or not (text.isascii() or (text == text.lower() and unicodedata.is_normalized("NFC", text))):
            ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        elif len(core) < len(word):
            ids = self[core] + self._marks(word[len(core) :])
        else:
            unit = text if text.isascii() else "".join(map(self.letters.__getitem__, core))
            ids = array("I", [x.id for x in self.model.tokenize(unit)]).tobytes()
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids

    def _marks(self, marks: bytes) -> bytes:
        if marks not in self:
            self[marks] = array("I", [x.id for x in self.model.tokenize(marks.decode())]).tobytes()
        return self[marks]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().lower().split()))

    def ids(self, text: str) -> bytes:
        """Ids of a text, 4 bytes each."""
        if self.cuts is None or not self.cuts.search(text):
            return self._plain(text)
        return b"".join(self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(self.cuts.split(text)))


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str, most: int) -> WordTokenizer:
    """The worker's tokenizer, which outlives a task with the words it keeps."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path, most)
    _tokenizers[path].most = most
    return _tokenizers[path]


def cut(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n ids."""
    return [(at, min(max_tokens, n - at)) for at in range(0, n, max_tokens)]


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[list[int], int]]:
    """Packs as (lengths in order, how many such packs), all lengths of the histogram placed.

    Groups of equal packs wait in a heap by their total.  The next length goes onto the
    shortest pack if it fits there (else it fits nowhere) and opens a new one if not; a
    group that is only partly used is split.
    """
    waiting: list[tuple[int, int, tuple[int, ...], int]] = []
    made = 0
    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left and waiting and waiting[0][0] + length <= max_tokens:
            total, _, lengths, packs = heapq.heappop(waiting)
            used = min(left, packs)
            left -= used
            if used < packs:
                heapq.heappush(waiting, (total, made := made + 1, lengths, packs - used))
            heapq.heappush(waiting, (total + length, made := made + 1, (*lengths, length), used))
        if left:
            each = max_tokens // length  # equal lengths fill new packs together
            full, rest = divmod(left, each)
            grown = [((length,) * each, full), ((length,) * rest, 1 if rest else 0)]
        for lengths, packs in grown:
            if packs:
                heapq.heappush(waiting, (sum(lengths), made := made + 1, lengths, packs))
    return [(list(lengths), packs) for _, _, lengths, packs in sorted(waiting)]


def _places(packs: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: first rank, first sequence, offset."""
    ranks: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, n in packs:
        offset = 0
        for length in lengths:
            first = ranks.get(length, 0)
            runs.setdefault(length, []).append((first, sequence, offset))
            ranks[length] = first + n
            offset += length
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = 4096,
    end_id: int = 2,
    with_ids: bool = False,
    cached_words: int = CACHED_WORDS,
    owner: str = "query",
) -> DataFrame:
    """Pieces of all rows: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A row's ids are its text's ids and ``end_id``; a null or empty text has that id alone.
    They are cut every ``max_tokens`` ids.  Repeated rows and rows of equal or null key are
    packed each by itself.  ``with_ids`` adds the ids of each piece for writing.  An empty
    table gives an empty table; other input columns are dropped.  A worker keeps the ids of
    ``cached_words`` words, some 200 bytes each.  The driver holds the
    histogram, and each executor the places: both depend on ``max_tokens`` alone.
    """
    key_type = docs.schema[key].dataType
    fields = [T.StructField("key", key_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] if with_ids else []

    def tokenized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer, end = _tokenizer(tokenizer_path, cached_words), end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for k, x in zip(batch["key"], batch["text"], strict=True):
                ids = tokenizer.ids(x or "") + end
                for start, length in cut(len(ids) // 4, max_tokens):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((k, start, length, crc32(piece), len(ids) // 4, piece)[: len(fields)])
            yield pd.DataFrame(rows, columns=[f.name for f in fields]).astype({"key": batch["key"].dtype})

    selected = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    numbered = selected.mapInPandas(trimmed(tokenized), T.StructType(fields)).withColumn("_no", F.monotonically_increasing_id())
    pieces = materialize(numbered, "pieces", owner)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # max_tokens rows at most
    places = _places(shortest_pack_first(histogram, max_tokens))

    block = F.pmod(F.xxhash64("key", "start", "ids_crc32"), F.lit(RANK_BLOCKS)).cast("int")
    blocked = pieces.withColumn("_block", block)
    sizes = materialize(blocked.groupBy("length", "_block").agg(F.count("*").alias("n")), "sizes", owner)
    limit = hot_limit(sizes)  # repeated rows share a block; those of a hot one are dealt out by their number
    hot = F.broadcast(sizes.filter(F.col("n") > limit).select("length", "_block", F.lit(True).alias("_hot")))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64("_no"), F.lit(RANK_BLOCKS))).otherwise(0).cast("int")
    blocked = blocked.join(hot, ["length", "_block"], "left").withColumn("_spread", spread).drop("_hot")
    counts = blocked.groupBy("length", "_block", "_spread").count()  # at most (max_tokens + MOST_KEYS) * RANK_BLOCKS rows
    earlier = Window.partitionBy("length").orderBy("_block", "_spread").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_block", "_spread", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_block", "_spread").orderBy("key", "start", "ids_crc32", "doc_tokens")
    ranked = blocked.join(counts, ["length", "_block", "_spread"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)

    shared = docs.sparkSession.sparkContext.broadcast(places)
    where = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(where)
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(some):
                first, base, at = shared.value[int(lengths[some[0]])]
                run = np.searchsorted(first, ranks[some], side="right") - 1
                sequence[some], offset[some] = base[run] + ranks[some] - first[run], at[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("_place", placed("length", "_rank"))
    names = [F.col("key").alias(key), *[F.col(f.name) for f in fields[1:5]], "_place.sequence_id", "_place.offset"]
    return out.select(*names, *(["ids"] if with_ids else []))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
