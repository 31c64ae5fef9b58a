"""Documents scored by cross-entropy difference between two n-gram models.

The background model is counted over all documents, the target model over those labelled
good, in the same way and over one vocabulary, which is every word of the corpus and a
bound that stands before and after each text.  A document's score is the mean over its
tokens of the background model's loss less the target model's, so higher means closer to
the target.  A document's own counts are taken out of both models before it is scored.

Neither the vocabulary nor the bigrams are cut, so the models grow with the corpus and are
never in one place:

1. Texts become blocks of about ``BLOCK_TOKENS`` tokens, written once: the block's distinct
   words by hash, frequent ones first, and its tokens as places among them.
2. Each block asks for its distinct words and bigrams, with their counts in the block,
   packed in a row for each part of the key space.  A part sums the counts of all blocks
   and answers each of them in the order of its question.
3. A block puts its answers together and scores its documents in numpy.

A key is sent once by each block that holds it, so the most common bigram weighs on its
part with one number a block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from casegraph.llm.memory import trim, trimmed
from casegraph.llm.scratch import forget_shuffles, materialize
from casegraph.llm.text import mix64, word_hashes

#: Tokens of a block, and those for which there is one part of the key space.
BLOCK_TOKENS = 1 << 18
PART_TOKENS = 1 << 20
#: Bits of a word's hash, and of a key within its part.
WORD_BITS, KEY_BITS = 48, 40
#: Shares of the word model in the bigram model, and of the uniform one in the word model.
#: They are the same for both models, so that the smaller one is no kinder to what is new.
WORD_SHARE, UNIFORM_SHARE = 0.5, 0.1
_ODD = np.uint64(1)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_LOW, _WORD = np.uint64((1 << KEY_BITS) - 1), np.uint64((1 << WORD_BITS) - 1)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, the lowest bytes of all first,
    so that the others, which are mostly zero, compress."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    """The numbers of :func:`_narrow`."""
    if not n:
        return np.empty(0, np.int64)
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(f"u{len(planes)}")[:, 0].astype(np.int64)


class Block:
    """Documents of a block: distinct words (the bound first), and bigrams in text order.

    ``before`` and ``after`` are the places of each bigram's words, ``bigram`` its place
    among the distinct ones and ``doc`` its document.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.sizes = words, sizes
        full = np.flatnonzero(sizes)
        lengths = sizes[full] + 1
        ends = np.cumsum(lengths)
        self.doc = np.repeat(full.astype(np.int32), lengths)
        inner = np.ones(int(ends[-1]) if len(ends) else 0, bool)
        inner[ends - 1] = False
        self.after = np.zeros(len(inner), np.int32)
        self.after[inner] = tokens
        self.before = np.zeros(len(inner), np.int32)
        self.before[1:] = self.after[:-1]
        distinct, which = np.unique(self.before * np.int64(len(words)) + self.after, return_inverse=True)
        self.bigram = which.astype(np.int32)
        self.pairs = np.stack(np.divmod(distinct, max(len(words), 1)))

    def keys(self) -> np.ndarray:
        """Even keys of the distinct words, then odd ones of the distinct bigrams."""
        first, second = self.words[self.pairs[0]], self.words[self.pairs[1]]
        return np.concatenate([mix64(self.words) & ~_ODD, mix64(mix64(first + _FACTOR) * _FACTOR + second) | _ODD])

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often the block's chosen documents hold each key; a bound counts once a document."""
        some = chosen[self.doc]
        return np.concatenate([np.bincount(self.after[some], minlength=len(self.words)), np.bincount(self.bigram[some], minlength=self.pairs.shape[1])])


    @functools.cached_property
    def own_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often a bigram's own document holds it, its first and its second word."""
        codes = self.doc * np.int64(max(self.pairs.shape[1], 1)) + self.bigram
        _, at, n = np.unique(codes, return_inverse=True, return_counts=True)
        pair = n[at].astype(np.int32)
        by_word, at, n = np.unique(self.doc * np.int64(len(self.words)) + self.after, return_inverse=True, return_counts=True)
        before = n[np.searchsorted(by_word, self.doc * np.int64(len(self.words)) + self.before)]  # each word stands as often before as after
        return pair, before.astype(np.int32), n[at].astype(np.int32)


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of the key space with the places of their keys, in order of the key."""
    part = ((keys >> np.uint64(KEY_BITS)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((keys & _LOW, part))
    edges = np.flatnonzero(np.diff(part[order])) + 1
    for places in np.split(order, edges):
        if len(places):
            yield int(part[places[0]]), places


def _blocks(texts: DataFrame, key_type: T.DataType, block_tokens: int) -> DataFrame:
    """Blocks of the rows ``key, text, good``."""
    fields = [T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("good", T.ArrayType(T.BooleanType()))]
    fields += [T.StructField("n_words", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_good", T.LongType())]
    arrow_key = to_arrow_type(key_type)

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, good, hashes, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in hashes], np.int64)
            words, tokens, counts = np.unique(np.concatenate([np.zeros(1, np.uint64), *hashes]), return_inverse=True, return_counts=True)
            order = np.argsort(-counts[1:], kind="stable") + 1  # the bound stays first, then frequent words
            rank = np.zeros(len(words), np.int64)
            rank[order] = np.arange(1, len(words))
            words[1:], tokens = words[order], rank[tokens]
            events = np.where(sizes > 0, sizes + 1, 0)
            row = [[number], [list(keys)], [sizes.tolist()], [list(good)], [len(words)], [_narrow(words)], [_narrow(tokens[1:])], [int(events.sum())], [int(events[np.array(good, bool)].sum())]]
            kinds = [pa.int64(), pa.list_(arrow_key), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=[f.name for f in fields])

        for batch in batches:
            for key, text, is_good in zip(batch["key"], batch["text"], batch["good"], strict=True):
                keys.append(key.as_py())
                good.append(bool(is_good.as_py()))
                hashes.append(word_hashes((text.as_py() or "").encode().lower()) & _WORD)
                total += len(hashes[-1]) + 1
                if total >= block_tokens:
                    yield block()
                    number += 1
                    keys, good, hashes, total = [], [], [], 0
        if keys:
            yield block()

    return texts.mapInArrow(trimmed(blocked), T.StructType(fields))


def _read(row: dict) -> tuple[Block, np.ndarray]:
    words = _wide(row["words"], row["n_words"]).astype(np.uint64)
    sizes = np.array(row["sizes"], np.int64)
    return Block(words, _wide(row["tokens"], int(sizes.sum())), sizes), np.array(row["good"], bool)


def _asked(blocks: DataFrame, parts: int) -> DataFrame:
    """A row for each block and part: the block's keys there and their counts."""
    names = ["part", "block", "n", "keys", "every", "good"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                block, good = _read(row)
                keys, every, target = block.keys(), block.counts(np.ones(len(good), bool)), block.counts(good)
                rows = [(part, row["block"], len(at), _narrow(np.diff(keys[at] & _LOW, prepend=np.uint64(0))), _narrow(every[at]), _narrow(target[at])) for part, at in _by_part(keys, parts)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return blocks.select("block", "sizes", "good", "n_words", "words", "tokens").mapInArrow(trimmed(ask), "part int, block long, n long, keys binary, every binary, good binary")


def _answered(asked: DataFrame) -> DataFrame:
    """For each row of :func:`_asked` the counts over all blocks, and once a part its number of words."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:  # about PART_TOKENS keys
        keys = np.concatenate([np.cumsum(_wide(x, n)) for x, n in zip(group["keys"], group["n"], strict=True)]).astype(np.uint64)
        distinct, which = np.unique(keys, return_inverse=True)
        sums = []
        for name in ("every", "good"):
            counts = np.concatenate([_wide(x, n) for x, n in zip(group[name], group["n"], strict=True)])
            sums.append(np.bincount(which, counts, len(distinct)).astype(np.int64)[which])
        edges = np.cumsum(group["n"].to_numpy())[:-1]
        out = group[["part", "block", "n"]].copy()
        out["every"], out["good"] = [[_narrow(x) for x in np.split(s, edges)] for s in sums]
        trim()
        out["n_words"] = [int((distinct & _ODD == 0).sum())] + [0] * (len(group) - 1)
        return out

    return asked.groupBy("part").applyInPandas(answer, "part int, block long, n long, every binary, good binary, n_words long")


def losses(block: Block, good: np.ndarray, counts: np.ndarray, is_target: bool, n_tokens: int, n_words: int) -> np.ndarray:
    """Mean loss of each document under the model of ``counts``, without its own counts.

    p(w) = (1 - u) c(w) / n + u / words and p(w | v) = (1 - s) c(v, w) / c(v) + s p(w), where
    u and s are 1 if n or c(v) is 0.
    """
    n = len(block.words)
    own = good[block.doc] if is_target else np.ones(len(block.doc), bool)
    own_pair, own_before, own_after = block.own_counts
    sizes = np.where(block.sizes > 0, block.sizes + 1, 0)
    of_pair = counts[n:][block.bigram] - own * own_pair
    of_before = counts[block.before] - own * own_before
    of_after = counts[block.after] - own * own_after
    rest = n_tokens - own * sizes[block.doc]
    word = np.where(rest > 0, (1 - UNIFORM_SHARE) * of_after / np.maximum(rest, 1) + UNIFORM_SHARE / n_words, 1 / n_words)
    p = np.where(of_before > 0, (1 - WORD_SHARE) * of_pair / np.maximum(of_before, 1) + WORD_SHARE * word, word)
    total = np.bincount(block.doc, -np.log(p), len(sizes))
    return total / np.maximum(sizes, 1)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    block_tokens: int = BLOCK_TOKENS,
    part_tokens: int = PART_TOKENS,
    max_shared_ids: int = 1_000_000,
    owner: str = "query",
) -> DataFrame:
    """``key, n_tokens, target_loss, background_loss, score`` of every row.

    Losses are mean negative log probabilities (nats) over the text's bigrams of lower-cased
    (A-Z) words, with a bound before the first word and after the last.  ``score`` is
    background less target loss.  Documents whose greatest ``label`` is 1 are the target;
    each document is scored by the models of the others.

    A null or blank text has no tokens and null losses and score, and takes no part in the
    models.  Repeated rows count as often as they stand, so copies know each other; null
    keys and rows without label are background only.  Without any target the target model
    knows the number of words alone and is uniform.  An empty table gives an empty table;
    other columns go.  Words and bigrams are told apart by their part and ``KEY_BITS`` bits
    of a hash: with some 600,000 keys in a part, one in two million meets another.
    """
    greatest = labels.groupBy(F.col(key).alias("key")).agg(F.max(label).alias("label"))
    target = materialize(greatest.filter("label = 1 and key is not null").select("key", F.lit(True).alias("good")), "target", owner)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    few = target.count() <= max_shared_ids
    marked = texts.join(F.broadcast(target) if few else target, "key", "left").select("key", "text", F.coalesce("good", F.lit(False)).alias("good"))
    key_type = docs.schema[key].dataType
    blocks = materialize(_blocks(marked, key_type, block_tokens), "blocks", owner)
    n_tokens, n_good = (x or 0 for x in blocks.agg(F.sum("n_tokens"), F.sum("n_good")).first())
    answers = materialize(_answered(_asked(blocks, max(1, n_tokens // part_tokens))), "answers", owner)
    forget_shuffles(docs.sparkSession)  # the questions are answered
    n_words = answers.agg(F.sum("n_words")).first()[0] or 1
    lists = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "n", "every", "good"))).alias("answers"))
    parts = max(1, n_tokens // part_tokens)
    names = [key, "n_tokens", "target_loss", "background_loss", "score"]
    arrow_key = to_arrow_type(key_type)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                block, good = _read(row)
                keys = block.keys()
                every, chosen = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                for (part, at), answer in zip(_by_part(keys, parts), row["answers"] or (), strict=True):
                    assert part == answer["part"]
                    every[at], chosen[at] = _wide(answer["every"], answer["n"]), _wide(answer["good"], answer["n"])
                a = losses(block, good, chosen, True, n_good, n_words)
                b = losses(block, good, every, False, n_tokens, n_words)
                none = block.sizes == 0
                columns = [pa.array(row["keys"], arrow_key), pa.array(block.sizes, pa.int64()), *[pa.array(x, pa.float64(), mask=none) for x in (a, b, b - a)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField(key, key_type), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in names[2:]]])
    return blocks.join(lists, "block", "left").select("keys", "sizes", "good", "n_words", "words", "tokens", "answers").mapInArrow(trimmed(scored), schema)


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents against those labelled of quality 1."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
