"""Encode texts word by word, each distinct word once per worker.

White space separates words in every tokenizer used here, so the ids of a text are the ids of its
white-space-delimited words put together.  A run of texts is split and its words are numbered by
Arrow, a cache from word to ids is asked once for each distinct word, and one take lays the ids out.
The cache is cleared when it holds ``limit`` bytes, so its memory has a bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word of ASCII and Latin-1 letters, perhaps with marks behind it: most words of a text.  These letters are
# composed, and every Unicode table has the same lower case for them.  The apostrophe begins contractions and
# the less-than sign special tokens, so they are no such marks.
PLAIN_PARTS = r"(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-&(-/:;=>?@\[-`{-~]*)"
PLAIN = re.compile(PLAIN_PARTS)


class Remembered:
    """Encodings by word, forgotten when they take more than about ``limit`` bytes."""

    #: What Python needs for a word, its encoding and their place in a dictionary, beside the bytes themselves.
    OVERHEAD = 190

    def __init__(self, limit: int):
        self.limit, self.known, self.bytes = limit, {}, 0

    def clear(self) -> None:
        self.known, self.bytes = {}, 0

    def make_room(self) -> None:
        if self.bytes > self.limit:
            self.clear()

    def add(self, words: list[str], encodings: list[bytes]) -> None:
        self.known.update(zip(words, encodings, strict=True))
        self.bytes += self.OVERHEAD * len(words) + sum(map(len, words)) + sum(map(len, encodings))


class WordwiseEncoder:
    """``encode_words`` gets distinct words without blanks and returns the encoding of each as bytes."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], limit: int = 64_000_000, slice_chars: int = 1_000_000):
        self.encode_words, self.slice_chars = encode_words, slice_chars
        self.cache = Remembered(limit)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Encodings of the texts, in order; null counts as empty."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < self.slice_chars):
                chars += len(texts[stop] or "")
                stop += 1
            yield from self._slice(texts[start:stop])
            start = stop

    def _slice(self, texts: list[str | None]) -> Iterator[bytes]:
        runs = pa.array([(text or "").replace("\n", " ") for text in texts], pa.large_string())
        parts = pc.split_pattern(runs, " ")
        numbered = parts.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.cache.make_room()
        found = list(map(self.cache.known.get, words))
        missing = [k for k, encoding in enumerate(found) if encoding is None]
        if missing:
            new = [words[k] for k in missing]
            encoded = self.encode_words(new)
            self.cache.add(new, encoded)
            for k, encoding in zip(missing, encoded, strict=True):
                found[k] = encoding
        laid = pa.array(found, pa.large_binary()).take(numbered.indices)
        _, ends, ids = laid.buffers()
        edges = np.frombuffer(ends, np.int64)[parts.offsets.to_numpy()].tolist()
        for begin, end in zip(edges, edges[1:]):
            yield ids[begin:end].to_pybytes() if ids else b""
