"""Quality rules: counts of words, symbols and repeats, and a calibrated n-gram classifier.

Method.  Hashed word uni- and bigrams and hashed character 4-grams (bytes, two seeds, ``SLOTS`` slots
each) as shares of their number form the features of a text, with the share of letters, capitals,
marks and repeated windows beside them.  A logistic regression is trained on labelled rows and
calibrated on a fold it was not fitted on; texts whose calibrated probability of good quality is at
least ``KEEP_FROM`` are kept, unless a base rule fails.  Texts are scored in Arrow batches, whole,
with array operations over all bytes of a batch.

Training takes at most ``SAMPLE_ROWS`` labelled rows, those with the least hash of doc_id per label,
and reduces each to its features on the executors.

Edge cases: null, empty and blank texts have no words and fail the base rule; without labels of both
kinds the classifier keeps all that the base rules keep; labels without a document and documents
without a label are fine; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytewise import Batch, mix, per_text_sums, slices
from tidemark.llm.logistic import Logistic, fit, stacked
from tidemark.llm.scratch import first_by_hash

BITS = 15
SLOTS = 1 << BITS
#: Features that are plain shares, behind the two hashed parts.
SHARES = 6
SIZE = 2 * SLOTS + SHARES
SAMPLE_ROWS = 2000
KEEP_FROM = 0.5
#: Fixed values of the base rules.
LEAST_WORDS = 10
MOST_REPEATED_PER_CENT = 20
REPEAT_WINDOW = 5

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
MARK = np.zeros(256, bool)
MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass
class Counts:
    """One entry per text."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def counts_of(batch: Batch, hashes: np.ndarray) -> Counts:
    data = batch.data
    # A code point is a byte that does not continue one.
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, batch.word_from, 1)
    np.add.at(inside, batch.word_to, -1)
    points = ((data & 0xC0) != 0x80) & (np.cumsum(inside)[:-1] > 0)
    return Counts(
        batch.words,
        per_text_sums(points, batch.starts, batch.ends),
        per_text_sums(SYMBOL[data], batch.starts, batch.ends),
        _duplicate_lines(batch),
        _repeated_words(batch, hashes),
    )


def _duplicate_lines(batch: Batch) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text, character by character."""
    data, out = batch.data.tobytes(), np.zeros(batch.count, np.int64)
    for k, (start, end) in enumerate(zip(batch.starts.tolist(), batch.ends.tolist())):
        lines = [line for line in data[start:end].split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
        out[k] = len(lines) - len(set(lines))
    return out


def _repeated_words(batch: Batch, hashes: np.ndarray) -> np.ndarray:
    """Words inside a window of five words that occurs at least twice in the text."""
    windows, places = batch.windows(hashes, REPEAT_WINDOW)
    owner = batch.word_doc[places].astype(np.uint64)
    keys = mix(windows ^ (owner * np.uint64(0xD6E8FEB86659FD93)))
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    twin = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = sorted_keys[1:] == sorted_keys[:-1]
        twin[order[1:][equal]] = True
        twin[order[:-1][equal]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, places[twin], 1)
    np.add.at(cover, places[twin] + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(batch.word_doc[covered], minlength=batch.count)


def _hashed(batch: Batch, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots and owners of the word n-grams, and slots of the 4-grams that begin at each byte."""
    shift = np.uint64(64 - BITS)
    pairs, places = batch.windows(hashes, 2)
    word_slots = np.concatenate([(mix(hashes) >> shift), (pairs >> shift)]).astype(np.int64)
    owners = np.concatenate([batch.word_doc, batch.word_doc[places]])
    data = batch.data.astype(np.uint32)
    grams = data.copy()
    for k in (1, 2, 3):
        grams[: len(data) - k] = (grams[: len(data) - k] << np.uint32(8)) | data[k:]
    char_slots = ((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    return word_slots, owners, char_slots, np.maximum(batch.ends - 3, batch.starts)


def _shares(batch: Batch, counts: Counts) -> np.ndarray:
    size = np.maximum(batch.ends - batch.starts, 1)
    sums = [per_text_sums(table[batch.data], batch.starts, batch.ends) / size for table in (UPPER, MARK, SYMBOL)]
    words = np.maximum(counts.n_words, 1)
    return np.stack([*sums, counts.n_repeat_words / words, counts.word_chars / words / 10, counts.n_dup_lines / (counts.n_dup_lines + 3)], axis=1)


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text, for training."""
    rows = []
    for _, run in slices(texts):
        batch = Batch(run, lower=False)
        hashes = batch.word_hashes()
        counts = counts_of(batch, hashes)
        word_slots, owners, char_slots, char_ends = _hashed(batch, hashes)
        shares = _shares(batch, counts)
        for k in range(batch.count):
            own = np.bincount(word_slots[owners == k], minlength=0) if batch.count == 1 else np.bincount(word_slots[_owned(owners, batch, k)])
            chars = np.bincount(char_slots[batch.starts[k] : char_ends[k]])
            at, bt = np.flatnonzero(own), np.flatnonzero(chars)
            slots = np.concatenate([at, SLOTS + bt, 2 * SLOTS + np.arange(SHARES)])
            values = np.concatenate([own[at] / max(1, own.sum()), chars[bt] / max(1, chars.sum()), shares[k]])
            rows.append((slots, values))
    return rows


def _owned(owners: np.ndarray, batch: Batch, k: int) -> np.ndarray:
    """Entries of one text: its words lie together, and so do its word pairs."""
    words = len(batch.word_doc)
    first, last = batch.first_word[k], batch.first_word[k + 1]
    low, high = np.searchsorted(owners[words:], [k, k + 1]) + words
    return np.concatenate([np.arange(first, last), np.arange(low, high)])


def margins(batch: Batch, hashes: np.ndarray, counts: Counts, model: Logistic) -> np.ndarray:
    """The model's raw value of each text, by sums over the whole batch."""
    word_slots, owners, char_slots, char_ends = _hashed(batch, hashes)
    words, chars, rest = model.weights[:SLOTS], model.weights[SLOTS : 2 * SLOTS], model.weights[2 * SLOTS :]
    in_words = np.bincount(owners, weights=words[word_slots], minlength=batch.count) / np.maximum(np.bincount(owners, minlength=batch.count), 1)
    total = np.concatenate([[0.0], np.cumsum(chars[char_slots], dtype=np.float64)])
    in_chars = (total[char_ends] - total[batch.starts]) / np.maximum(char_ends - batch.starts, 1)
    return in_words + in_chars + _shares(batch, counts) @ rest + model.offset


def judge(text: Column, model: Logistic | None) -> Column:
    """Struct of the counts, base_failed and the probability of good quality."""

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double")
    def score(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for _, run in slices(texts.where(texts.notna(), None).tolist()):
            batch = Batch(run, lower=False)
            hashes = batch.word_hashes()
            c = counts_of(batch, hashes)
            failed = (c.n_words < LEAST_WORDS) | (100 * c.n_repeat_words > MOST_REPEATED_PER_CENT * c.n_words)
            good = model.probability(margins(batch, hashes, c, model)) if model is not None else np.ones(batch.count)
            parts.append(pd.DataFrame(vars(c) | {"base_failed": failed, "probability": good}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=[f for f in Counts.__annotations__] + ["base_failed", "probability"])

    return score(text)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Logistic | None:
    """A calibrated model from (doc_id, text) and (doc_id, quality); None without labels of both kinds."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    # Half of the sample each.
    chosen = first_by_hash(usable, "_quality", "doc_id", sample_rows // 2, groups=2).select(F.col("doc_id").alias("_id"), "_quality", "_turn")

    @F.pandas_udf("slots binary, values binary")
    def packed(texts: pd.Series) -> pd.DataFrame:
        rows = features(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame([(s.astype("<u4").tobytes(), v.astype("<f4").tobytes()) for s, v in rows], columns=["slots", "values"])

    # At most sample_rows rows: a proven bound for the broadcast and for what comes back.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # One row an id, before features are built.
    met = met.groupBy("_quality", "_turn", "doc_id").agg(F.min("text").alias("text"))
    sample = met.select("_quality", "_turn", "doc_id", packed("text").alias("f")).select("_quality", "_turn", "doc_id", "f.*").toPandas()
    sample = sample.sort_values(["_turn", "_quality", "doc_id"], kind="stable")
    labelled = sample["_quality"].to_numpy()
    if len(set(labelled.tolist())) < 2:
        return None
    rows = stacked([(np.frombuffer(s, "<u4").astype(np.int64), np.frombuffer(v, "<f4")) for s, v in zip(sample["slots"], sample["values"], strict=True)])
    return fit(rows, labelled, SIZE, ridge=1e-6, steps=120, fold=np.arange(len(labelled)) % 8 < 2)


def apply_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, probability, kept."""
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    model = train(rows, labels, sample_rows)
    judged = rows.select("doc_id", judge(F.col("text"), model).alias("_q")).select("doc_id", "_q.*")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_from))
