"""Words, n-grams and hashes of many texts at once, on the bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# The first 0 to 8 bytes of a little-endian 64-bit word.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: list[str | None], limit: int = 500_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) in runs of bounded size; one long text is a run of its own."""
    run: list[bytes] = []
    size = first = 0
    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if run and size + len(data) > limit:
            yield first, run
            run, size, first = [], 0, k
        run.append(data)
        size += len(data)
    if run:
        yield first, run


class Batch:
    """Texts laid end to end with a blank behind each.

    ``data`` holds the bytes, ``starts`` where each text begins, ``word_from``/``word_to`` the byte
    ranges of the words and ``word_doc`` the text each word belongs to."""

    def __init__(self, texts: list[bytes], lower: bool, separators: np.ndarray = SPACE):
        padded = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
        if lower:
            padded = LOWER[padded]
        self.data = padded[:-8]
        # The eight bytes from each place on.
        self.lanes = np.ndarray(len(self.data), "<u8", padded, strides=(1,))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.count = len(texts)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.ends = self.starts + sizes
        letter = ~separators[self.data]
        edges = np.diff(np.concatenate([[False], letter]).astype(np.int8))
        self.word_from = np.flatnonzero(edges == 1)
        self.word_to = np.flatnonzero(edges == -1)
        self.word_doc = np.searchsorted(self.starts, self.word_from, side="right") - 1
        self.words = np.bincount(self.word_doc, minlength=self.count)
        self.first_word = np.concatenate([[0], np.cumsum(self.words)])

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: every eight of them are mixed with their place, then summed."""
        size = self.word_to - self.word_from
        out = mix((self.lanes[self.word_from] & MASKS[np.minimum(size, 8)]) + MULTIPLIER)
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) // 8
            begin = np.cumsum(more) - more
            owner = np.repeat(np.arange(len(long)), more)
            turn = np.arange(len(owner)) - begin[owner] + 1
            at = self.word_from[long][owner] + 8 * turn
            part = self.lanes[at] & MASKS[np.minimum(self.word_to[long][owner] - at, 8)]
            out[long] += np.add.reduceat(mix(mix(part) + (turn + 1).astype(np.uint64) * MULTIPLIER), begin)
        return mix(out + size.astype(np.uint64))

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of the first word) of each run of ``width`` words inside one text."""
        count = max(0, len(hashes) - width + 1)
        out = np.zeros(count, np.uint64)
        for k in range(width):
            out = out * MULTIPLIER + hashes[k : k + count]
        inside = self.word_doc[:count] == self.word_doc[width - 1 : width - 1 + count] if count else np.zeros(0, bool)
        return mix(out[inside]), np.flatnonzero(inside)


def per_text_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the byte range of each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]
