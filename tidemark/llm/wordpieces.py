"""Token counts by a linear longest-match automaton, without building pieces.

Method.  The vocabulary is a trie.  Every node has a failure link and the number of pieces a greedy
longest-match tokeniser has finished when it must leave the node for that link.  Reading a word
costs one step a symbol: where the trie has no edge, the count of the node is added and the link
followed.  The number of pieces of a word falls out at its end; no piece is ever cut.

Words are what lies between the six ASCII white-space characters, in lower case, in UTF-8.  The
vocabulary marks the last byte of a word, so that byte is a symbol of its own.  A word in which no
piece fits at some place counts as one unknown piece; with byte-level vocabularies there is none.

Edge cases: null, empty and blank texts have no words and no tokens; a text or word of any length is
read whole; repeated rows are counted alike; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_symbols

FINAL = 256
SYMBOLS = 512
#: Distinct words whose count a worker remembers.
REMEMBERED = 400_000


class LongestMatch:
    """Trie of pieces (sequences of symbols below SYMBOLS) with failure links and popped counts."""

    def __init__(self, pieces: list[list[int]]):
        self.edges: dict[int, int] = {}
        whole, parent, symbol = [False], [0], [0]
        for piece in pieces:
            node = 0
            for s in piece:
                key = node * SYMBOLS + s
                after = self.edges.get(key)
                if after is None:
                    after = self.edges[key] = len(whole)
                    whole.append(False)
                    parent.append(node)
                    symbol.append(s)
                node = after
            whole[node] = bool(piece)
        count = len(whole)
        self.link, self.popped = [-1] * count, [0] * count
        # Nodes in order of depth: a link leads to a shorter string.
        depth = np.zeros(count, np.int64)
        for node in range(1, count):
            depth[node] = depth[parent[node]] + 1
        for node in np.argsort(depth, kind="stable")[1:].tolist():
            if whole[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            at, done = self.link[parent[node]], self.popped[parent[node]]
            while at >= 0 and at * SYMBOLS + symbol[node] not in self.edges:
                done += self.popped[at]
                at = self.link[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.edges[at * SYMBOLS + symbol[node]], done

    def count(self, symbols: bytes | list[int]) -> int:
        """Pieces of a greedy longest match; 1 where it cannot go on, 0 for nothing."""
        edges, link, popped = self.edges, self.link, self.popped
        node = pieces = 0
        for symbol in symbols:
            after = edges.get(node * SYMBOLS + symbol)
            while after is None:
                pieces += popped[node]
                node = link[node]
                if node < 0:
                    return 1
                after = edges.get(node * SYMBOLS + symbol)
            node = after
        while node > 0:
            pieces += popped[node]
            node = link[node]
        return pieces if node == 0 else 1

    def count_word(self, word: bytes) -> int:
        return self.count([*word[:-1], word[-1] + FINAL]) if word else 0


def vocabulary_pieces(path: str) -> list[list[int]]:
    """The symbols of each piece of a byte-level vocabulary with an end-of-word suffix."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, bytes_of = model["end_of_word_suffix"], {s: b for b, s in enumerate(byte_symbols())}
    pieces = []
    for name in model["vocab"]:
        stem = name.removesuffix(suffix)
        if stem and all(letter in bytes_of for letter in stem):
            symbols = [bytes_of[letter] for letter in stem]
            if stem != name:
                symbols[-1] += FINAL
            pieces.append(symbols)
    return pieces


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> LongestMatch:
    """The automaton of a vocabulary file, built once per worker."""
    return LongestMatch(vocabulary_pieces(path))


class WordCounts(dict):
    """Pieces of each distinct word, counted when first asked for."""

    def __init__(self, machine: LongestMatch):
        super().__init__({"": 0})
        self.machine = machine

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
            self[""] = 0
        self[word] = pieces = self.machine.count_word(word.encode("utf-8", "replace"))
        return pieces


BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def count_column(text: Column, vocabulary: str) -> Column:
    """Struct (n_words, n_tokens) of a text column."""

    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: pd.Series) -> pd.DataFrame:
        counts, rows = WordCounts(automaton(vocabulary)), []
        for text in texts:
            words = text.lower().translate(BLANKS).split(" ") if isinstance(text, str) else []
            rows.append((len(words) - words.count(""), sum(map(counts.__getitem__, words))))
        return pd.DataFrame(rows, columns=["n_words", "n_tokens"])

    return count(text)


def token_counts(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens; one narrow pass over whole texts."""
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), count_column(F.col(f"`{text_column}`"), vocabulary).alias("_c"))
    return rows.select("doc_id", "_c.*")
