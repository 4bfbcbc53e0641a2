"""Token-id files with Simple-8b word-aligned coding.

Format.  A 64-bit word holds a selector in its top four bits and as many ids of one width as fit the
other sixty: selectors 1 to 14 stand for 60 ids of 1 bit down to one id of 60 bits.  Selector 15 is
the escape for ids that need more: the word holds the place of the id in a table of exceptions.  Ids
are packed greedily in blocks of ``BLOCK_IDS``; a table has the first word of each block, so blocks
are decoded independently and all words of one selector at once.

A file is: magic, five counts (documents, ids, blocks, words, exceptions), then document ids and a
byte each for null ids, the end of each document, block offsets, exceptions, words; all numbers
little-endian.  Files are written in ascending doc_id order, one range of documents each, under a
name given by the range's place; a repeated task writes the same bytes and renames over them.

Edge cases: null text counts as empty, an empty document has only its end id, a null doc_id sorts
first, rows with one doc_id are ordered by their text's hash, long documents span blocks and may
exceed a file's target size, an empty table writes no file; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import partitions, written
from tidemark.llm.wordwise import PLAIN_PARTS, Remembered, WordwiseEncoder
from tidemark.session import shared_dir

MAGIC = b"S8BIDS01"
BLOCK_IDS = 1024
#: Ids in a file, about 12 MB, and ids packed at once.
FILE_IDS, GROUP_IDS = 4_000_000, 256 * BLOCK_IDS
#: Bytes of the words, and of the word parts, whose ids a worker remembers.
REMEMBERED_BYTES = 96_000_000
ESCAPE = 15
# Ids per word and their width, for selectors 1 to 14.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
LOW_60 = np.uint64((1 << 60) - 1)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits each id needs, at least 1; looked up for ids of usual size."""
    if ids.size and int(ids.max()) < len(_BITS):
        return _BITS[ids]
    return _bit_lengths(ids)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    out = np.ones(ids.shape, np.uint8)
    for bits in WIDTHS[1:15]:
        out[ids.astype(np.uint64) >> np.uint64(bits) > 0] = bits + 1
    return out


_BITS = _bit_lengths(np.arange(1 << 16))


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the end, exceptions) of a run of ids."""
    count = len(ids)
    blocks = -(-count // BLOCK_IDS)
    # Behind each block room for what a word may take past its end.
    row = BLOCK_IDS + 64
    grid = np.zeros((blocks, row), ids.dtype)
    whole = count // BLOCK_IDS
    grid[:whole, :BLOCK_IDS] = ids[: whole * BLOCK_IDS].reshape(whole, BLOCK_IDS)
    grid[whole:, : count - whole * BLOCK_IDS] = ids[whole * BLOCK_IDS :]
    selector = _selectors(bit_lengths(grid[:, :BLOCK_IDS]))
    starts, owners = _word_starts(selector, np.minimum(BLOCK_IDS, count - np.arange(blocks) * BLOCK_IDS))
    chosen = selector.ravel()[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    flat, places = grid.ravel(), starts + owners * 64
    for s in range(1, ESCAPE):
        at = np.flatnonzero(chosen == s)
        if len(at):
            part, first = words[at], places[at]
            for k in range(COUNTS[s]):
                part |= flat[first + k].astype(np.uint64) << np.uint64(k * WIDTHS[s])
            words[at] = part
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[escaped] |= np.arange(len(escaped)).astype(np.uint64)
    offsets = np.searchsorted(owners, np.arange(blocks + 1)).astype(np.uint64)
    return words, offsets, flat[places[escaped]].astype(np.uint64)


class Packer:
    """Takes ids as they come and packs them a group of blocks at a time."""

    def __init__(self):
        self.count, self.rest, self.held = 0, [], 0
        self.words, self.offsets, self.exceptions = [], [np.zeros(1, np.uint64)], []
        self.n_words = self.n_exceptions = 0

    def add(self, packed: bytes) -> None:
        """Little-endian unsigned 32-bit ids."""
        self.rest.append(packed)
        self.held += len(packed) // 4
        self.count += len(packed) // 4
        if self.held >= GROUP_IDS:
            ids = np.frombuffer(b"".join(self.rest), "<u4")
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            self._pack(ids[:whole])
            self.rest, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def _pack(self, ids: np.ndarray) -> None:
        for start in range(0, len(ids), GROUP_IDS):
            words, offsets, exceptions = encode(ids[start : start + GROUP_IDS])
            # Escapes name their place among all exceptions of the file.
            words[words >> np.uint64(60) == ESCAPE] += np.uint64(self.n_exceptions)
            self.words.append(words)
            self.offsets.append(offsets[1:] + np.uint64(self.n_words))
            self.exceptions.append(exceptions)
            self.n_words += len(words)
            self.n_exceptions += len(exceptions)

    def finish(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._pack(np.frombuffer(b"".join(self.rest), "<u4"))
        self.rest, self.held = [], 0
        none = [np.zeros(0, np.uint64)]
        return tuple(np.concatenate(none + parts) for parts in (self.words, self.offsets, self.exceptions))


def _selectors(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that packs most ids from there on."""
    blocks, size = bits.shape
    windows = {1: np.concatenate([bits, np.ones((blocks, 64), np.uint8)], axis=1)}
    for power in (2, 4, 8, 16, 32):
        half = windows[power // 2]
        windows[power] = np.maximum(half, np.concatenate([half[:, power // 2 :], half[:, -(power // 2) :]], axis=1))
    out = np.full((blocks, size), ESCAPE, np.uint8)
    for s in range(14, 0, -1):
        n = int(COUNTS[s])
        power = 1 << (n.bit_length() - 1)
        power = min(power, 32)
        widest = np.maximum(windows[power][:, :size], windows[power][:, n - power : n - power + size])
        out[widest <= WIDTHS[s]] = s
    return out


def _word_starts(selector: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where words begin, all blocks walking in step, and the block of each, in order."""
    live = np.arange(len(lengths))
    at = np.zeros(len(lengths), np.int64)
    found = [np.zeros(0, np.int64)]
    while live.size:
        found.append(live * BLOCK_IDS + at)
        at = at + COUNTS[selector[live, at]]
        keep = at < lengths[live]
        live, at = live[keep], at[keep]
    starts = np.sort(np.concatenate(found))
    return starts, starts // BLOCK_IDS


def decode(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, count: int, blocks: slice = slice(None)) -> np.ndarray:
    """Ids of some blocks, one pass for each selector."""
    chosen = np.arange(len(offsets) - 1)[blocks]
    if not len(chosen):
        return np.zeros(0, np.uint64)
    first, last = int(chosen[0]), int(chosen[-1]) + 1
    part = words[int(offsets[first]) : int(offsets[last])]
    selector = (part >> np.uint64(60)).astype(np.int64)
    owner = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1].astype(np.int64)))
    sizes = COUNTS[selector]
    before = np.cumsum(sizes) - sizes
    start_of_block = before[(offsets[first:last] - offsets[first]).astype(np.int64)]
    place = owner * BLOCK_IDS + before - start_of_block[owner - first]
    end = np.minimum((owner + 1) * BLOCK_IDS, count)
    out = np.zeros(min(last * BLOCK_IDS, count) - first * BLOCK_IDS, np.uint64)
    for s in range(1, ESCAPE):
        at = np.flatnonzero(selector == s)
        if len(at):
            places = place[at, None] + np.arange(COUNTS[s])
            values = ((part[at] & LOW_60)[:, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << int(WIDTHS[s])) - 1)
            inside = places < end[at, None]
            out[places[inside] - first * BLOCK_IDS] = values[inside]
    at = np.flatnonzero(selector == ESCAPE)
    out[place[at] - first * BLOCK_IDS] = exceptions[(part[at] & LOW_60).astype(np.int64)]
    return out


def file_bytes(doc_ids: list[int | None], ends: np.ndarray, packer: Packer) -> bytes:
    words, offsets, exceptions = packer.finish()
    counts = np.array([len(doc_ids), packer.count, len(offsets) - 1, len(words), len(exceptions)], "<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    none = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([MAGIC, counts.tobytes(), known.tobytes(), none.tobytes(), ends.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), exceptions.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


class IdFile:
    """A file's content, read without copying."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token-id file")
        docs, self.n_ids, blocks, words, exceptions = (int(n) for n in np.frombuffer(data, "<u8", 5, 8))
        at = 48
        parts = []
        for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", blocks + 1), ("<u8", exceptions), ("<u8", words)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        known, none, self.ends, self.offsets, self.exceptions, self.words = parts
        self.doc_ids = [None if n else int(d) for d, n in zip(known, none)]

    def ids(self) -> np.ndarray:
        return decode(self.words, self.offsets, self.exceptions, self.n_ids)

    def document(self, k: int) -> np.ndarray:
        """Ids of one document; only its blocks are decoded."""
        start, end = (int(self.ends[k - 1]) if k else 0), int(self.ends[k])
        first, last = start // BLOCK_IDS, -(-end // BLOCK_IDS)
        part = decode(self.words, self.offsets, self.exceptions, self.n_ids, slice(first, last))
        return part[start - first * BLOCK_IDS : end - first * BLOCK_IDS]


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word a worker meets.

    A word of ASCII and Latin-1 letters needs no normalisation but lower case, so it may skip that step and
    the splitting of the library; all others pass through the whole tokenizer."""

    BREAK = "<|endoftext|>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.plain = Tokenizer.from_file(path)
        self.plain.no_padding()
        self.plain.no_truncation()
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.whole.get_vocab(with_added_tokens=True)
        self.final = np.zeros(max(names.values()) + 1, bool)
        self.final[[number for name, number in names.items() if name.endswith("</w>")]] = True
        self.break_id = self.whole.token_to_id(self.BREAK)
        self._stems = Remembered(REMEMBERED_BYTES)
        self._encoder = WordwiseEncoder(self._encode_words, REMEMBERED_BYTES, slice_chars=2_000_000)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        return self._encoder.encode(texts)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        split = pc.extract_regex(pa.array(words, pa.string()), f"^{PLAIN_PARTS}$")
        stem, mark = (split.field(k).filter(split.is_valid()).dictionary_encode() for k in (0, 1))
        lowered = pc.utf8_lower(stem.dictionary)
        other = np.flatnonzero(split.is_null())
        others = [words[k] for k in other]
        self._stems.make_room()
        self._stems.add([""], [b""])
        stems, marks = (part.to_numpy(zero_copy_only=False).tolist() for part in (lowered, mark.dictionary))
        known = self._stems.known
        letters = list(set(stems) - known.keys())
        self._stems.add(letters, self._by_ends(letters))
        together = [word for word in {*marks} - known.keys() | {*others} if word and "<|" not in word]
        found = {"": b""} | dict(zip(together, self._by_breaks(together), strict=True))
        for word in others:
            if word not in found:
                found[word] = self._packed(self.whole.encode(word, add_special_tokens=False).ids)
        new = [part for part in marks if part not in known]
        self._stems.add(new, [found[part] for part in new])
        joined = [pa.array([known[p] for p in own], pa.binary()).take(part.indices) for own, part in ((stems, stem), (marks, mark))]
        out = np.empty(len(words), object)
        out[np.flatnonzero(split.is_valid())] = pc.binary_join_element_wise(*joined, b"").to_numpy(zero_copy_only=False)
        out[other] = [found[word] for word in others]
        return out.tolist()

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _runs(self, tokenizer, words: list[str], joiner: str) -> np.ndarray:
        runs = [joiner.join(words[k : k + 500]) + joiner for k in range(0, len(words), 500)]
        found = [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, "<u4")

    def _by_ends(self, stems: list[str]) -> list[bytes]:
        """Each stem is one word to the library, so its ids end with a final token."""
        ids = self._runs(self.plain, stems, " ")
        return _split(ids, np.flatnonzero(self.final[ids]) + 1)

    def _by_breaks(self, words: list[str]) -> list[bytes]:
        """A special token behind each word, which no word contains, tells where its ids end."""
        ids = self._runs(self.whole, words, self.BREAK)
        ends = np.flatnonzero(ids == self.break_id)
        kept = np.delete(ids, ends)
        return _split(kept, ends - np.arange(len(ends)))


def _split(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data, cuts = ids.tobytes(), (ends * 4).tolist()
    return [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]


@functools.lru_cache(maxsize=2)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_ids(df: DataFrame, vocabulary: str, folder: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode whole texts and write them in ascending doc_id order; returns the manifest.

    Manifest: file, part, place, n_docs, n_ids, one row a file."""
    text = F.col(f"`{text_column}`")
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_hash"))
    ranged = rows.repartitionByRange(partitions(df.sparkSession), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    ranged = ranged.select(F.spark_partition_id().alias("part"), "doc_id", F.col("doc_id").isNull().alias("none"), "text")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc_ids, lengths, packer, part, place = [], [], Packer(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for frame in frames:
            part = int(frame["part"].iloc[0]) if len(frame) else part
            texts = frame["text"].where(frame["text"].notna(), None).tolist()
            for doc_id, none, data in zip(frame["doc_id"], frame["none"], library(vocabulary).encode(texts), strict=True):
                doc_ids.append(None if none else int(doc_id))
                packer.add(data + end)
                lengths.append(len(data) // 4 + 1)
                if packer.count >= file_ids:
                    yield save(folder, part, place, doc_ids, lengths, packer)
                    doc_ids, lengths, packer, place = [], [], Packer(), place + 1
        if doc_ids:
            yield save(folder, part, place, doc_ids, lengths, packer)

    return written(ranged.mapInPandas(write, "file string, part int, place int, n_docs long, n_ids long"), "id-manifest")


def save(folder: str, part: int, place: int, doc_ids: list[int | None], lengths: list[int], packer: Packer) -> pd.DataFrame:
    """Write one file under its final name and return its manifest row."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    name = f"ids-{part:06d}-{place:06d}.s8b"
    store.create_dir(root, recursive=True)
    hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(file_bytes(doc_ids, np.cumsum(lengths), packer))
    store.move(hidden, f"{root}/{name}")
    return pd.DataFrame([(name, part, place, len(doc_ids), packer.count)], columns=["file", "part", "place", "n_docs", "n_ids"])


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    from pyspark.sql import Window

    spark = manifest.sparkSession
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file of millions of ids.
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("_start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(F.broadcast(starts), "file").select("_start", "content").mapInPandas(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start, content in zip(frame["_start"], frame["content"], strict=True):
            file = IdFile(content)
            data, ends = file.ids().astype("<u4").tobytes(), file.ends.astype(np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pd.DataFrame({"doc_id": pd.array(file.doc_ids, "Int64"), "start": start + begins, "n_tokens": ends - begins, "ids_crc32": sums})


def tokenize_to_files(df: DataFrame, vocabulary: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all documents to files in the shared folder and read them back."""
    folder = shared_dir(df.sparkSession, "token-ids")
    manifest = write_ids(df, vocabulary, folder, end_id, id_column, text_column, file_ids)
    if manifest.isEmpty():
        return df.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_ids(manifest, folder)
