"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary matches of a word; dynamic programming over
its characters carries the best score and that path's number of pieces, and no path.  Ties
are broken as the exact tokenizer does: candidates come by ascending start, and a later
one wins only with a higher score.  Characters that no piece covers cost the lowest score
of the vocabulary less 10 and count one piece for each of their bytes.

Pieces hold the word mark only in front, so a text's count is the sum over its words, and
the counts of words seen before are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 800_000
#: Bytes of the longest word that is kept.
LONGEST_CACHED = 256


def load_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model, without controls, bytes and runs of marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids]
    return [(p, s) for p, s in pieces if MARK not in p[1:]]


class PieceCounter(dict):
    """Pieces of a word's best segmentation, by word, kept for ``CACHED_WORDS`` words."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.singles = frozenset(p for p, _ in vocabulary if len(p) == 1)

    def count(self, marked: str) -> int:
        """Pieces of the best path over a word that begins with the mark."""
        n = len(marked)
        if not self.singles.issuperset(marked):
            return self._count_unknown(marked)
        scores, pieces = [0.0, *[float("-inf")] * n], [0] * (n + 1)
        for last, (length, score) in self.automaton.iter(marked):  # by end, then ascending start
            start = last + 1 - length
            total = scores[start] + score
            if total > scores[last + 1]:
                scores[last + 1], pieces[last + 1] = total, pieces[start] + 1
        return pieces[n]

    def _count_unknown(self, marked: str) -> int:
        """The same, where some characters are no pieces."""
        n = len(marked)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(marked):
            ending[last + 1].append((length, score))
        scores, pieces = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            best, count, single = None, 0, False
            for length, score in sorted(ending[end], reverse=True):  # ascending start
                single |= length == 1
                total = scores[end - length] + score
                if best is None or total > best:
                    best, count = total, pieces[end - length] + 1
            if not single:
                total = scores[end - 1] + self.unknown
                if best is None or total > best:
                    best, count = total, pieces[end - 1] + len(marked[end - 1].encode())
            scores[end], pieces[end] = best, count
        return pieces[n]

    def __missing__(self, word: bytes) -> int:
        found = self.count(MARK + word.decode())
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def count_text(self, text: str) -> tuple[int, int]:
        """Words and pieces of a text."""
        words = text.encode().split()
        return len(words), sum(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(load_vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_chars, n_words, n_tokens`` of every row's whole text.

    Words are runs without space and U+0009..U+000D, each with a mark in front.  A null,
    empty or blank text has no words and no tokens.  Repeated rows and null keys are rows
    like others.  An empty table gives an empty table; other columns go.
    """
    names = [key, "n_chars", "n_words", "n_tokens"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(model_path)
        for batch in batches:
            rows = [(k, len(x or ""), *counter.count_text(x or "")) for k, x in zip(batch["key"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({key: batch["key"].dtype})

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(counted, schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Characters, words and unigram pieces of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
