"""BPE encoding by a bounded-lookahead transducer, decoding by an incremental byte-to-text machine.

Method.  A merge list has a *sufficient lookahead*: a number of symbols such that what follows
later can no longer change a token.  Text to the right reaches a token only along a chain of
merges of rising rank, each of which takes the left part of the one before into its right part.
``sufficient_lookahead`` adds up the longest chain.  ``Transducer`` holds that many symbols and a
few more, merges its window, emits the tokens that lie behind the lookahead and goes on; a token
border is final, so the rest can start afresh there.  Memory does not depend on the text's length.
Words shorter than a window, nearly all, end before anything could be emitted early; they pass
through the same merges in lockstep, many words of one length at a time.

Results equal those of the tokenizers library for BPE files with an end-of-word suffix, NFC and
lower-case normalisation and byte-level symbols (``word_bpe_49k.json``).

Edge cases: null and empty text give no ids and an empty text; a text of any length, also one
endless word, is encoded whole; special tokens inside a text get their own id, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.scratch import give_back
from tidemark.llm.wordwise import PLAIN, Remembered, WordwiseEncoder

NO_RANK = np.int32(2**31 - 1)
# Fixed value: how the vocabulary splits normalised text into words.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Longest word in bytes that is merged in lockstep; longer ones are streamed.
LOCKSTEP_BYTES = 40
#: Bytes of the words, and of their parts, whose ids a worker remembers.
WORD_BYTES, PART_BYTES = 64_000_000, 48_000_000
#: The same where a worker encodes beside other stages: an executor keeps more workers than cores, each with its own.
FEW_WORD_BYTES, FEW_PART_BYTES = 16_000_000, 24_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (byte for byte in range(256) if byte not in set(printable))
    symbols = {byte: chr(byte) for byte in printable} | {byte: chr(256 + k) for k, byte in enumerate(hidden)}
    return [symbols[byte] for byte in range(256)]


class MergeList:
    """Vocabulary and merges as arrays, with a hashed table from a pair of ids to its rank."""

    SLOTS = 1 << 20

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[s] for s in symbols], np.int32)
        self.final = np.array([vocabulary[s + suffix] for s in symbols], np.int32)
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a.removesuffix(suffix) + b]) for a, b in merges]
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(pairs)}
        self.product = np.array([made for _, _, made in pairs] or [0], np.int32)
        self._fill_table(pairs)
        self.lookahead = sufficient_lookahead(pairs, [*self.inner.tolist(), *self.final.tolist()])

    def _fill_table(self, pairs: list[tuple[int, int, int]]) -> None:
        self.keys = np.full(self.SLOTS + 16, -1, np.int64)
        self.ranks = np.full(self.SLOTS + 16, NO_RANK, np.int32)
        self.probes = 1
        for k, (a, b, _) in enumerate(pairs):
            slot = first = int(self._slot(np.array([a], np.int64), np.array([b], np.int64))[0])
            while self.keys[slot] >= 0:
                slot += 1
            self.keys[slot], self.ranks[slot] = (a << 32) | b, k
            self.probes = max(self.probes, slot - first + 1)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 13) & (self.SLOTS - 1)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where the pair does not merge; ids below 0 stand for nothing."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        slot, key = self._slot(a, b), (a << 32) | b
        found = np.where(self.keys[slot] == key, self.ranks[slot], NO_RANK)
        for step in range(1, self.probes):
            later = self.keys[slot + step] == key
            if later.any():
                found[later] = self.ranks[slot[later] + step]
        found[(a < 0) | (b < 0)] = NO_RANK
        return found

    def merged(self, symbols: list[int]) -> list[int]:
        """Tokens of one run of symbols: lowest rank first, leftmost first."""
        ids, after = list(symbols), list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        end, rank = len(ids), self.rank
        heap = [(rank[pair], k) for k, pair in enumerate(zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            order, left = heapq.heappop(heap)
            right = after[left]
            if ids[left] < 0 or right >= end or rank.get((ids[left], ids[right])) != order:
                continue
            ids[left], ids[right] = int(self.product[order]), -1
            after[left] = after[right]
            if after[left] < end:
                before[after[left]] = left
                if (ids[left], ids[after[left]]) in rank:
                    heapq.heappush(heap, (rank[ids[left], ids[after[left]]], left))
            if before[left] >= 0 and (ids[before[left]], ids[left]) in rank:
                heapq.heappush(heap, (rank[ids[before[left]], ids[left]], before[left]))
        return [i for i in ids if i >= 0]

    def merged_in_lockstep(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many equally long words at once; ``symbols`` has one word a column.

        Each step does every word's first merge.  Returns the tokens row by row, and how many
        each word has."""
        n, count = symbols.shape
        tokens, sizes = np.full((n, count), -1, np.int32), np.full(count, n, np.int32)
        if n == 1:
            return symbols.astype(np.int32), sizes
        live, ids = np.arange(count), symbols.astype(np.int32)
        ranks = self.ranks_of(ids[:-1].ravel(), ids[1:].ravel()).reshape(n - 1, count)
        row = np.arange(n)[:, None]
        while live.size:
            at = ranks.argmin(axis=0)
            column = np.arange(live.size)
            lowest = ranks[at, column]
            done = lowest == NO_RANK
            if done.any():
                tokens[:, live[done]] = ids[:, done]
                keep = ~done
                live, ids, ranks, at, lowest = live[keep], ids[:, keep], ranks[:, keep], at[keep], lowest[keep]
                column = np.arange(live.size)
                if not live.size:
                    break
            made = self.product[lowest]
            source = np.minimum(row + (row > at), n - 1)
            ids = np.take_along_axis(ids, source, axis=0)
            ids[-1] = -1
            ids[at, column] = made
            ranks = np.take_along_axis(ranks, np.minimum(source[:-1], n - 2), axis=0)
            ranks[-1] = NO_RANK
            right = np.minimum(at + 1, n - 1)
            ranks[np.minimum(at, n - 2), column] = self.ranks_of(made, np.where(at + 1 < n, ids[right, column], -1))
            inner = at > 0
            left = at[inner] - 1
            ranks[left, column[inner]] = self.ranks_of(ids[left, column[inner]], made[inner])
            sizes[live] -= 1
        return tokens, sizes


def sufficient_lookahead(pairs: list[tuple[int, int, int]], base: list[int]) -> int:
    """Symbols behind a token's end that settle it, whatever follows them.

    ``pairs`` lists (left, right, product) by rank.  ``reach[t]`` is the longest disturbance that
    has got as far as a token t on its right-hand side being taken away or left over."""
    length = dict.fromkeys(base, 1)
    left_part: dict[int, int] = {}
    reach: dict[int, int] = {}
    longest = 1
    for left, right, made in pairs:
        length[made] = length[left] + length[right]
        left_part[made] = left
        far, part = 0, right
        while part is not None:
            far = max(far, reach.get(part, 0))
            part = left_part.get(part)
        reach[left] = max(reach.get(left, 0), length[left] + far)
        longest = max(longest, reach[left], length[made])
    return longest


class Transducer:
    """Symbols in, final tokens out, with a window of bounded size."""

    def __init__(self, merges: MergeList, slack: int = 256):
        self.merges, self.slack, self.window = merges, slack, []
        # A token is at most as long as the lookahead, so a window of this size always emits.
        self.full = 2 * merges.lookahead + slack

    def push(self, symbols: Iterable[int]) -> Iterator[int]:
        """Take symbols that are not the last of their word; yield the tokens they settle."""
        for symbol in symbols:
            self.window.append(symbol)
            if len(self.window) >= self.full:
                yield from self._emit(len(self.window) - self.merges.lookahead)

    def finish(self, last: int) -> Iterator[int]:
        """Take the word's last symbol and yield the rest."""
        tokens = self.merges.merged([*self.window, last])
        self.window = []
        yield from tokens

    def _emit(self, settled: int) -> Iterator[int]:
        used, sizes = 0, token_lengths(self.merges)
        for token in self.merges.merged(self.window):
            if used + sizes[token] > settled:
                break
            used += sizes[token]
            yield token
        del self.window[:used]


def token_lengths(merges: MergeList) -> dict[int, int]:
    """Symbols in each token."""
    if not hasattr(merges, "_lengths"):
        found = dict.fromkeys([*merges.inner.tolist(), *merges.final.tolist()], 1)
        for (left, right), rank in merges.rank.items():
            found[int(merges.product[rank])] = found[left] + found[right]
        merges._lengths = found
    return merges._lengths


class BpeCodec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, word_bytes: int = WORD_BYTES, part_bytes: int = PART_BYTES):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        self.merges = MergeList(model["vocab"], (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]), model["end_of_word_suffix"])
        self.special = {token["content"]: token["id"] for token in content["added_tokens"]}
        self._special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = model["vocab"] | self.special
        self.pieces = [b""] * (max(names.values()) + 1)
        for name, number in names.items():
            self.pieces[number] = name.encode()
        tokenizer = Tokenizer.from_file(path)
        self._normal, self._pieces_of = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self._byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        self._parts = Remembered(part_bytes)
        self._encoder = WordwiseEncoder(self._encode_words, word_bytes)

    def forget(self) -> None:
        """Forget all words; they are encoded again when they come again."""
        self._parts.clear()
        self._encoder.cache.clear()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self._encoder.encode(texts)

    def decoder(self) -> TextDecoder:
        return TextDecoder(self.pieces)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        parts = [self._split(word) for word in words]
        self._parts.make_room()
        find = self._parts.known
        new = {part for own in parts for part in own if isinstance(part, bytes)} - find.keys()
        for part, ids in self._encode_parts(list(new)):
            self._parts.add([part], [ids])
        return [b"".join([find[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in own]) for own in parts]

    def _split(self, word: str) -> list[bytes | int]:
        """UTF-8 of the word's parts, and ids of special tokens."""
        if plain := PLAIN.fullmatch(word):
            stem, mark = plain.groups()
            return [stem.lower().encode(), mark.encode()] if mark else [stem.lower().encode()]
        if not word:
            return []
        runs = self._special_pattern.split(word) if self._special_pattern and "<|" in word else [word]
        out: list[bytes | int] = []
        for run in runs:
            if run in self.special:
                out.append(self.special[run])
            elif run.isascii():
                out += [found.group().encode() for found in PRETOKEN.finditer(run.lower())]
            else:  # Unicode's tables grow: normal form, case and classes are those of the vocabulary's own library
                out += [bytes(map(self._byte_of.__getitem__, piece)) for piece, _ in self._pieces_of(self._normal(run))]
        return out

    def _encode_parts(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        by_length: dict[int, list[bytes]] = {}
        for part in parts:
            by_length.setdefault(len(part), []).append(part)
        for length, own in by_length.items():
            if length > LOCKSTEP_BYTES:
                for part in own:
                    yield part, np.fromiter(self._stream(part), np.uint32).tobytes()
                continue
            letters = np.frombuffer(b"".join(own), np.uint8).reshape(-1, length).T
            symbols = self.merges.inner[letters]
            symbols[-1] = self.merges.final[letters[-1]]
            tokens, sizes = self.merges.merged_in_lockstep(symbols)
            flat = tokens.T[tokens.T >= 0].astype("<u4").tobytes()
            ends = (np.cumsum(sizes) * 4).tolist()
            for part, start, end in zip(own, [0, *ends[:-1]], ends):
                yield part, flat[start:end]

    def _stream(self, part: bytes) -> Iterator[int]:
        transducer = Transducer(self.merges)
        yield from transducer.push(self.merges.inner[byte].item() for byte in part[:-1])
        yield from transducer.finish(self.merges.final[part[-1]].item())


class TextDecoder:
    """Ids in, text out as soon as its bytes form whole characters.

    State: the joiner still owed and up to three bytes of a character begun.  Bytes that can form
    no character become U+FFFD.  ``pieces`` has the bytes of each id, joined by ``joiner``."""

    def __init__(self, pieces: list[bytes], joiner: bytes = b" "):
        self.pieces, self.joiner = pieces, joiner
        self.begun, self.started = b"", False

    def push(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = self.begun + (self.joiner if self.started else b"") + self.joiner.join([self.pieces[i] for i in ids])
        self.started = True
        cut = len(data) - self._unfinished(data)
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.begun, self.started = self.begun, b"", False
        return rest.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character and may still be completed."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                needed = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if needed > back else 0
            if byte < 0x80:
                return 0
        return 0


@functools.lru_cache(maxsize=2)
def codec(path: str, word_bytes: int = WORD_BYTES, part_bytes: int = PART_BYTES) -> BpeCodec:
    """The codec of a vocabulary file, loaded once per worker."""
    coder = BpeCodec(path, word_bytes, part_bytes)
    give_back()
    return coder


#: Ids decoded at a time.
DECODE_CHUNK = 65_536


def encode_column(text: Column, vocabulary: str) -> Column:
    """Ids of a text column as binary, four little-endian bytes each."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(list(codec(vocabulary).encode(texts.where(texts.notna(), None).tolist())), dtype=object)

    return encode(text)


def decode_column(ids: Column, vocabulary: str) -> Column:
    """Text of a column of binary ids, as the library's ``decode`` gives it."""

    @F.pandas_udf("string")
    def decode(packed: pd.Series) -> pd.Series:
        return pd.Series(["".join(decoded_chunks(data or b"", codec(vocabulary))) for data in packed], dtype=object)

    return decode(ids)


def decoded_chunks(data: bytes, coder: BpeCodec) -> Iterator[str]:
    machine = coder.decoder()
    for start in range(0, len(data), 4 * DECODE_CHUNK):
        yield machine.push(np.frombuffer(data[start : start + 4 * DECODE_CHUNK], "<u4").tolist())
    yield machine.finish()


def round_trip(text: Column, vocabulary: str) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of encoding a text and decoding its ids again."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _digested(batches, codec(vocabulary, FEW_WORD_BYTES, FEW_PART_BYTES))

    return digest(text)


def _digested(batches: Iterable[pd.Series], coder: BpeCodec) -> Iterator[pd.DataFrame]:
    """A worker that has ended its task waits for others of any stage, so it keeps the vocabulary but no words."""
    try:
        for texts in batches:
            rows = []
            for data in coder.encode(texts.where(texts.notna(), None).tolist()):
                decoded = hashlib.sha256()
                for chunk in decoded_chunks(data, coder):
                    decoded.update(chunk.encode())
                rows.append((len(data) // 4, hashlib.sha256(data).hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    finally:
        coder.forget()
        give_back()


def encode_and_decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, and digests of the ids and of the text decoded from them.

    One narrow pass without a shuffle; other columns are ignored, repeated rows give repeated rows."""
    coded = round_trip(F.col(f"`{text_column}`"), vocabulary)
    return df.select(F.col(f"`{id_column}`"), coded.alias("_coded")).select(f"`{id_column}`", "_coded.*")
