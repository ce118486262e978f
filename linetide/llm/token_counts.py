"""Token counts by greedy longest match, without building the pieces.

The vocabulary is a trie over byte symbols; a word's last byte is a symbol of its own
(``e</w>`` is not ``e``), as in the vocabulary file.  Every node has a failure link: the node that stands for what is
left of the text on its path after the longest-match pieces that surely go are
popped, and the number of the pieces popped.  A word is read once, symbol by symbol;
where the trie has no child, the walk adds the node's count and follows its link, so
the time is linear in the word's length whatever the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import ROWS, kept_memo, tokenizer, vocabulary_file
from .frames import arrow_map, two_columns

END = "</w>"


class LongestMatch:
    """Trie, failure links and popped counts of a vocabulary in which every single symbol is a piece."""

    def __init__(self, pieces, suffix: str = END):
        self.child: list[dict[str, int]] = [{}]
        piece_at: list[bool] = [False]
        for piece in pieces:
            at = 0
            for symbol in self._symbols(piece, suffix):
                to = self.child[at].get(symbol)
                if to is None:
                    to = self.child[at][symbol] = len(self.child)
                    self.child.append({})
                    piece_at.append(False)
                at = to
            piece_at[at] = True
        self.suffix = suffix
        if not all(piece_at[to] for to in self.child[0].values()):
            raise ValueError("a symbol is missing from the vocabulary")
        n = len(self.child)
        self.link, self.popped = [-1] * n, [0] * n
        row = [0]
        while row:
            below = []
            for at in row:
                for symbol, to in self.child[at].items():
                    below.append(to)
                    if piece_at[to]:
                        self.link[to], self.popped[to] = 0, 1
                        continue
                    back, count = self.link[at], self.popped[at]
                    while back >= 0 and symbol not in self.child[back]:
                        count += self.popped[back]
                        back = self.link[back]
                    if back >= 0:
                        self.link[to], self.popped[to] = self.child[back][symbol], count
            row = below

    @staticmethod
    def _symbols(piece: str, suffix: str) -> list[str]:
        if not piece.endswith(suffix) or piece == suffix:
            return list(piece)
        piece = piece.removesuffix(suffix)
        return [*piece[:-1], piece[-1] + suffix]

    def count(self, word: str) -> int:
        """Number of longest-match pieces of a non-empty word of known symbols."""
        child, link, popped = self.child, self.link, self.popped
        at = total = 0
        for symbol in (*word[:-1], word[-1] + self.suffix):
            to = child[at].get(symbol)
            while to is None:
                total += popped[at]
                at = link[at]
                if at < 0:
                    raise ValueError("unknown symbol")
                to = child[at].get(symbol)
            at = to
        while at > 0:
            total += popped[at]
            at = link[at]
        return total


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: bytes | None = None) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_tokens (greedy longest-match pieces of its words).

    Words come from the vocabulary file's own normalisation and split; a special string counts
    as one word and one token.  Null, empty and blank texts have 0 of both; rows with a
    null id and repeated rows are counted like any other; other columns are not kept.
    """
    source = two_columns(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary or vocabulary_file())

    def make():
        words = tokenizer(shared)
        match = words.memos.get("longest") or words.memos.setdefault("longest", LongestMatch(words.automaton.ids, words.automaton.suffix))

        memo = kept_memo("longest-counts", words, lambda keys: [1 if type(x) is int else match.count(words.symbols(x)) for x in keys])

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, pieces = [], []
            keys, codes = words.split_documents(batch.column(1).to_pylist())
            counts = np.array(memo.values(keys), dtype=np.int64)
            for own in codes:
                n.append(len(own))
                pieces.append(int(counts[own].sum()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(pieces, pa.int64())], ["id", "n_words", "n_tokens"])

        return step

    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return arrow_map(source, make, schema, ROWS).withColumnRenamed("id", id_col)
