"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

Method.  A text's blended spectrum is the set of its byte n-grams of 1 to ``LONGEST`` bytes, hashed
to ``SLOTS`` slots; only presence counts.  The kernel of two texts is the size of the common set over
the root of the product of the set sizes.  ``landmarks`` training texts, shared out over the
languages, are the basis of the features: a text's row of kernels with them, times the inverse root
of the landmarks' own kernel matrix, is its Nyström feature vector.  One ridge regression per language
(that language against the rest) is fitted on the features of every labelled row.  Scoring multiplies
the presence matrix of a batch by the landmark matrix, scales the rows, and multiplies by the weights.

Only the choice of landmarks is bounded: of the ``sample_rows`` rows with the least hash of doc_id, dealt
evenly over the languages, the first ``landmarks``.  The regressions need no more than sums over all rows,
which every task adds up by language, in whole numbers, so that neither order nor partitions change a
model.  Training and prediction read every text whole.

The regression values of a text sum to one, so the best is never low.  Whether a text is in a learned
language at all is told by ``known``: the share of its n-grams that the landmarks of a language hold,
with a margin for short texts.  The least share is calibrated on all held-out labelled rows, half way
between what these reach in their own language and in the best other one.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled
training row all texts are ``und``; with one language all other texts get it; null languages are not
learned from; repeated rows are predicted alike and count as often as they come; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytewise import LOWER
from tidemark.llm.scratch import as_rows, first_by_hash, inside

SLOTS = 1 << 14
LONGEST = 4
SAMPLE_ROWS = 1000
LANDMARKS = 96
RIDGE = 1e-2
#: Texts in one matrix product.
ROWS_AT_ONCE = 128
#: Long texts are looked up in pieces, as a whole one fills more slots than its landmarks have.
PIECE = 1 << 13
#: Kernels are summed in steps of 1 / ``STEPS``: whole numbers, which add up alike in any order.
STEPS = 1 << 20
#: Steps in which the shares of known n-grams are counted for the calibration.
BINS = 1 << 16
#: Labelled rows below which nothing is calibrated, and only texts without a letter go.
LEAST_LABELLED = 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def presence(text: str) -> np.ndarray:
    """Which slots the n-grams of the whole text fill."""
    filled = np.zeros(SLOTS, bool)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    for start in range(0, len(data), 1 << 20):  # parts overlap by an n-gram
        part = LOWER[data[start : start + (1 << 20) + LONGEST - 1]].astype(np.uint32)
        gram = np.zeros(len(part), np.uint32)
        for n in range(LONGEST):
            gram = (gram[: len(part) - n] << np.uint32(8)) | part[n:]
            if len(gram):
                filled[(gram * np.uint32(2654435761) + np.uint32(n * 0x3C6EF372)) >> np.uint32(32 - 14)] = True
    return filled


@dataclass
class LanguageModel:
    """``landmarks`` (slots x m), scaled by the root of their sizes; ``weights`` (m x languages)."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    #: languages x slots: what the landmarks of a language hold.
    held: np.ndarray | None = None

    def known(self, text: str, filled: np.ndarray) -> np.ndarray:
        """Per language the share of the text's n-grams its landmarks hold, plus 1.5 standard errors."""
        pieces = [filled] if len(text) <= PIECE else (presence(text[k : k + PIECE]) for k in range(0, len(text), PIECE))
        common, size = np.zeros(len(self.languages)), 0
        for piece in pieces:
            common += self.held[:, piece].sum(axis=1)
            size += int(piece.sum())
        return common / max(size, 1) + 1.5 * np.sqrt(0.25 / max(size, 1))

    def scores(self, filled: np.ndarray) -> np.ndarray:
        """One row of regression values per text, from its presence row."""
        kernel = filled.astype(np.float32) @ self.landmarks
        kernel /= np.sqrt(np.maximum(filled.sum(axis=1, keepdims=True), 1))
        return kernel @ self.weights + self.offsets


def kernel_steps(filled: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernels of presence rows with the landmarks, in whole steps; common slots are counted exactly."""
    common = (filled.astype(np.float32) @ marks.T.astype(np.float32)).astype(np.float64)
    sizes = np.sqrt(np.maximum(filled.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(marks.sum(axis=1), 1))[None, :]
    return np.rint(common / sizes * STEPS)


def summed(steps: np.ndarray) -> np.ndarray:
    """Rows, sums and products of kernel steps, one after the other.

    Up to ``ROWS_AT_ONCE`` rows: below 2^53, so exact in floating point."""
    return np.concatenate([[len(steps)], steps.sum(axis=0), (steps.T @ steps).ravel()]).astype(np.int64)


def fit(marks: np.ndarray, mark_languages: list[str], names: list[str], sums: Iterable[np.ndarray], ridge: float = RIDGE) -> LanguageModel:
    """Nyström features and one ridge regression per language, from the landmarks and ``sums`` as in ``summed``, per name."""
    if not names:
        return LanguageModel([], np.zeros((SLOTS, 1), np.float32), np.zeros((1, 0), np.float32), np.zeros(0))
    m = len(marks)
    chosen = (marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))).T
    values, vectors = np.linalg.eigh(chosen.T @ chosen)
    inverse_root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    # Each language weighs the same, however many rows it has.
    middles, second = np.zeros((len(names), m)), np.zeros((m, m))
    for k, own in enumerate(sums):
        own = own.astype(np.float64) / max(float(own[0]), 1.0)
        middles[k] = own[1 : m + 1] / STEPS @ inverse_root
        second += inverse_root.T @ (own[m + 1 :].reshape(m, m) / STEPS**2) @ inverse_root / len(names)
    middle, aim = middles.mean(axis=0), np.full(len(names), 1 / len(names))
    spread = second - np.outer(middle, middle)
    towards = middles.T / len(names) - np.outer(middle, aim)
    solved = np.linalg.solve(spread + ridge / 100 * np.eye(m), towards)
    held = np.array([marks[[language == name for language in mark_languages]].any(axis=0) for name in names])
    return LanguageModel(names, chosen.astype(np.float32), (inverse_root @ solved).astype(np.float32), aim - middle @ solved, held)


def _labelled(rows: DataFrame, sample_rows: int) -> DataFrame:
    """lang, _turn, doc_id and text of at most ``sample_rows`` labelled rows, dealt over the languages.

    Rows of one id and language count once, with the least of their texts."""
    usable = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ranked = first_by_hash(usable.select("doc_id", "lang").distinct(), "lang", "doc_id", sample_rows, groups=sample_rows)
    chosen = ranked.orderBy("_turn", "lang").limit(sample_rows)
    picked = chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "_turn")
    # At most sample_rows rows: a proven bound for the broadcast.
    met = usable.join(F.broadcast(picked), usable["doc_id"].eqNullSafe(F.col("_id")) & (usable["lang"] == F.col("_lang")))
    return met.groupBy("lang", "_turn", "doc_id").agg(F.min("text").alias("text"))


def _kernel_sums(rows: DataFrame, marks: np.ndarray, names: list[str]) -> Iterator[np.ndarray]:
    """Sums over every labelled row as in ``summed``, language by language in the order of the names.

    A task leaves one row per language and place of the sums; only their totals reach the driver."""
    size = 1 + len(marks) + len(marks) ** 2

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for frame in frames:
            for language, texts in frame.groupby("language")["text"]:
                texts = texts.tolist()
                for start in range(0, len(texts), ROWS_AT_ONCE):
                    filled = np.array([presence(text) for text in texts[start : start + ROWS_AT_ONCE]])
                    own = summed(kernel_steps(filled, marks))
                    totals[language] = totals[language] + own if language in totals else own
        for language, total in totals.items():
            yield pd.DataFrame({"language": language, "place": np.arange(size, dtype=np.int32), "amount": total})

    place = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1
    used = rows.filter(F.col("lang").isin(names) & F.col("text").isNotNull()).select(place.alias("language"), "text")
    parts = used.mapInPandas(add, "language int, place int, amount long")
    # Totals over all rows may pass 64 bits.
    added = parts.groupBy("language", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).cast("double").alias("amount"))
    lists = added.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("place", "amount"))).alias("sums"))
    for row in lists.orderBy("language").select(F.col("sums.amount").alias("amounts")).toLocalIterator():
        yield np.array(row["amounts"])


def learn(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """A model from (doc_id, text, lang) rows: landmarks from ``sample_rows`` of them, dealt over the languages,
    regressions from every row in one of their languages."""
    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(presence(text)).tobytes() for text in texts], dtype=object)

    sample = _labelled(rows, sample_rows).select("lang", "_turn", "doc_id", bits("text").alias("bits")).toPandas()
    sample = sample.sort_values(["_turn", "lang", "doc_id"], kind="stable")
    names, first = sorted(set(sample["lang"])), sample[:landmarks]
    # Rows come dealt over the languages, so the first ones are shared out among them.
    marks = np.array([np.unpackbits(np.frombuffer(data, np.uint8)) for data in first["bits"]], np.uint8).reshape(-1, SLOTS)
    return fit(marks, first["lang"].tolist(), names, _kernel_sums(rows, marks, names) if names else (), ridge)


def identify(text: Column, model: LanguageModel, with_known: bool = False) -> Column:
    """Struct (lang_pred, score) of a text column; the score is the share of the winner in 0..1.

    ``with_known`` adds ``known``, per language of the model the share of the text's n-grams it holds;
    a text's presence is built once for both."""
    kind = "lang_pred string, score double" + (", known array<double>" if with_known else "")

    @F.pandas_udf(kind)
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, shares = [UNKNOWN] * len(texts), np.zeros(len(texts))
        held = [np.zeros(0)] * len(texts)
        known = [k for k, text in enumerate(texts) if isinstance(text, str) and LETTER.search(text)] if model.languages else []
        values = texts.tolist()
        for start in range(0, len(known), ROWS_AT_ONCE):
            rows = known[start : start + ROWS_AT_ONCE]
            filled = np.array([presence(values[k]) for k in rows])
            scores = model.scores(filled)
            best = scores.argmax(axis=1)
            # Regression values aim at 0 and 1.
            shares[rows] = np.clip(scores[np.arange(len(rows)), best], 0, 1)
            for at, (k, b) in enumerate(zip(rows, best, strict=True)):
                names[k] = model.languages[b]
                if with_known:
                    held[k] = model.known(values[k], filled[at])
        out = {"lang_pred": names, "score": shares} | ({"known": held} if with_known else {})
        return pd.DataFrame(out)

    return predict(text)


def held_out(id_column: Column, folds: int = 5) -> Column:
    """Whether a row belongs to the fold that is never learned from; no row without an id does."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def predict_languages(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; learned from the rows not held out."""
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang"))
    model = learn(rows.filter(~held_out(F.col("doc_id"))), sample_rows)
    out = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), model).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def least_known(labelled: DataFrame, model: LanguageModel) -> float:
    """The share of known n-grams below which a text is in no learned language, from all rows given, none learned from.

    Half way between the share that 99 of 100 texts reach in their own language and the middle share
    in the best other language; with one language four fifths of the former.  Languages weigh the same.
    The shares are counted in steps of 1 / ``BINS``, so that the quantiles see every row and hold no more
    than the counts."""
    rows = labelled.filter(F.col("lang").isin(model.languages) & F.col("text").isNotNull())
    judged = rows.select("lang", identify(F.col("text"), model, with_known=True).alias("_p"))
    # Texts that the model mistakes may carry a wrong label.
    found = judged.filter(F.col("_p.lang_pred") == F.col("lang")).select("lang", F.col("_p.known").alias("known"))
    place = F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int")
    best_other = F.array_max(F.filter("known", lambda _, k: k != place - 1))
    sides = F.array(F.struct(F.lit("own").alias("side"), F.get("known", place - 1).alias("share")), F.struct(F.lit("other").alias("side"), best_other.alias("share")))
    counted = found.select("lang", F.inline(sides)).groupBy("lang", "side", F.rint(F.col("share") * BINS).cast("long").alias("bin")).agg(F.count("*").alias("rows"))
    # A million to every language: whole frequencies in the proportion of the rows.
    spread = F.sum("rows").over(Window.partitionBy("lang", "side"))
    weighed = counted.withColumn("weight", F.greatest(F.rint(F.col("rows") * 1e6 / spread), F.lit(1)).cast("long"))

    def at(side: str, share: float) -> Column:
        of = F.col("side") == side
        return F.percentile(F.when(of, F.col("bin")), share, F.when(of, F.col("weight")).otherwise(F.lit(0)))

    total = weighed.agg(F.sum(F.when(F.col("side") == "own", F.col("rows"))).alias("rows"), at("own", 0.01).alias("own"), at("other", 0.5).alias("other")).first()
    if (total["rows"] or 0) < LEAST_LABELLED:
        return 0.0
    reached = total["own"] / BINS
    if len(model.languages) == 1:
        return 0.8 * reached
    return min(reached, (reached + total["other"] / BINS) / 2)


def with_known_language(df: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", least_score: float = 0.2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows, with all their columns, in a learned language, recognised with at least ``least_score``."""
    rows = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang"))
    model = learn(rows.filter(~held_out(F.col("doc_id"))), sample_rows)
    least = least_known(rows.filter(held_out(F.col("doc_id"))), model) if model.languages else 0.0
    judged = as_rows(df).withColumn("_language", identify(inside(text_column), model, with_known=True))
    place = F.array_position(F.array(*map(F.lit, model.languages)).cast("array<string>"), F.col("_language.lang_pred")).cast("int")
    stay = judged.filter((F.col("_language.lang_pred") != UNKNOWN) & (F.col("_language.score") >= least_score))
    return stay.filter(F.get(F.col("_language.known"), place - 1) >= least).select("row.*")
