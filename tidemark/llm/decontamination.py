"""Benchmark decontamination by winnowing: selected k-gram hashes are joined, and hits extended.

Method.  Of each ``WINDOW - GRAM + 1`` consecutive k-gram hashes of a text the least is selected, so two
texts that share ``WINDOW`` words in a row select a common hash inside them.  Documents keep the selected
hashes that the benchmark has selected too; around these, and only there, their windows are compared with
those of the benchmark, and every word of an occurring window is hit.  An item with fewer words than a
window is one window of its own length; for these lengths every run of the document is a fingerprint.

A benchmark of at most ``BENCHMARK_WORDS`` words is joined inside the tasks: its index has a proven bound,
is broadcast, and the documents are read once without a shuffle; windows are confirmed word by word.  A
larger one is joined by shuffles: fingerprints in a semi join, then the windows around the hits.  Both
give the same rows.  Words are told by 64-bit hashes of their lower-cased bytes, windows of the shuffled
form by a 64-bit hash of their words.

Edge cases: null, empty and wordless texts have no words and are clean; items without words have no
window; a null item_id marks words but is neither counted nor listed; equal item_ids count once; repeated
documents are judged each; an empty benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bytewise import MULTIPLIER, Batch, mix, slices
from tidemark.llm.scratch import lookup, written

GRAM, WINDOW = 5, 10
#: Words of a benchmark that is broadcast.
BENCHMARK_WORDS = 1_000_000

# Fixed value: the ASCII characters that separate words, after lower-casing.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
NO_ITEMS = hashlib.sha256(b"").hexdigest()


class Runs:
    """Word hashes of a run of texts, and the hashes of their windows."""

    def __init__(self, texts: list[bytes]):
        batch = Batch(texts, lower=True, separators=SEPARATORS)
        self.words, self.doc, self.counts = batch.word_hashes(), batch.word_doc, batch.words

    def inside(self, width: int) -> np.ndarray:
        """Whether ``width`` words from each place on are of one text."""
        count = max(0, len(self.words) - width + 1)
        return self.doc[:count] == self.doc[width - 1 : width - 1 + count]

    def hashes(self, width: int) -> np.ndarray:
        count = max(0, len(self.words) - width + 1)
        return _mixed([self.words[k : k + count] for k in range(width)])

    def hashes_at(self, places: np.ndarray, width: int) -> np.ndarray:
        return _mixed([self.words[places + k] for k in range(width)])

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """(places of windows, least gram hash of each)."""
        inside = self.inside(WINDOW)
        least = _sliding_min(self.hashes(GRAM), WINDOW - GRAM + 1)[: len(inside)]
        places = np.flatnonzero(inside)
        return places, least[places]


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    out = columns[0]
    for column in columns[1:]:
        out = out * MULTIPLIER + column
    return mix(out + np.uint64(len(columns)))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: max(0, len(out) - step)], out[step:])
        done += step
    return out


def _found(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each value is known, its place in the sorted ``known``)."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values, at


def windows_of(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, width, windows as word hashes, fingerprints, window hashes) of each benchmark text with words."""
    for first, run in slices(texts):
        runs = Runs(run)
        places, least = runs.selected()
        edges = np.searchsorted(runs.doc, np.arange(len(run) + 1))
        for k, count in enumerate(runs.counts.tolist()):
            if count >= WINDOW:
                a, b = np.searchsorted(places, [edges[k], edges[k + 1]])
                at = places[a:b]
                yield first + k, WINDOW, runs.words[at[:, None] + np.arange(WINDOW)], least[a:b], runs.hashes_at(at, WINDOW)
            elif count:
                whole = runs.hashes_at(edges[k : k + 1], count)
                yield first + k, count, runs.words[edges[k] : edges[k + 1]][None], whole, whole


class Benchmark:
    """Index of a bounded benchmark: fingerprints, windows by width, and the items of each window.

    Windows with the same items share a class, so a document names few of them."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items = sorted({str(item) for item, _ in items if item is not None})
        rank = {item: k for k, item in enumerate(self.items)}
        prints, owners, words = {}, {}, {}
        for k, width, windows, fingerprints, hashes in windows_of([text for _, text in items]):
            prints.setdefault(width, set()).update(fingerprints.tolist())
            own = None if items[k][0] is None else rank[str(items[k][0])]
            for window, h in zip(windows, hashes.tolist()):
                owners.setdefault(width, {}).setdefault(h, set()).add(own)
                words.setdefault(width, {})[h] = window
        self.prints = {width: np.array(sorted(found), np.uint64) for width, found in prints.items()}
        self.windows = {width: np.array(sorted(found), np.uint64) for width, found in owners.items()}
        self.words = {width: np.stack([words[width][h] for h in hashes.tolist()]) for width, hashes in self.windows.items()}
        classes: dict[frozenset, int] = {}
        self.classes = {width: np.array([classes.setdefault(frozenset(owners[width][h]), len(classes)) for h in hashes.tolist()]) for width, hashes in self.windows.items()}
        self.members = [sorted(r for r in members if r is not None) for members in classes]

    def judge(self, texts: list[str | None]) -> Iterator[tuple]:
        """Rows of ``RESULT``."""
        for _, run in slices(texts):
            runs = Runs(run)
            marks = np.zeros(len(runs.words) + 1, np.int64)
            seen: list[np.ndarray] = []
            for width, windows in self.windows.items():
                places, at = self._occurrences(runs, width, windows)
                marks += np.bincount(places, minlength=len(marks)) - np.bincount(places + width, minlength=len(marks))
                seen.append(np.stack([runs.doc[places], self.classes[width][at]], axis=1))
            hit = np.bincount(runs.doc[np.cumsum(marks[:-1]) > 0], minlength=len(run)).tolist()
            pairs = np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 2), np.int64)
            edges = np.searchsorted(pairs[:, 0], np.arange(len(run) + 1)).tolist()
            for k, words in enumerate(runs.counts.tolist()):
                ranks = sorted({r for c in pairs[edges[k] : edges[k + 1], 1].tolist() for r in self.members[c]})
                yield words, hit[k], len(ranks), _digest(self.items[r] for r in ranks), hit[k] > 0

    def _occurrences(self, runs: Runs, width: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of occurring windows, their numbers): only windows with a known fingerprint are looked at."""
        if width < WINDOW:
            places = np.flatnonzero(runs.inside(width))
            least = runs.hashes_at(places, width)
        else:
            places, least = runs.selected()
        # Neighbouring windows mostly select the same hash: each such run is asked once.
        fresh = np.diff(least, prepend=~least[:1]) != 0
        known, _ = _found(least[fresh], self.prints[width])
        places = places[known[np.cumsum(fresh) - 1]] if len(places) else places
        same, at = _found(runs.hashes_at(places, width), windows)
        places, at = places[same], at[same]
        exact = (runs.words[places[:, None] + np.arange(width)] == self.words[width][at]).all(axis=1)
        return places[exact], at[exact]


def _digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _texts(series: pd.Series) -> list[str | None]:
    return series.where(series.notna(), None).tolist()


def contamination(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", benchmark_words: int = BENCHMARK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))).alias("n")).first()["n"] or 0
    text = F.col(f"`{text_column}`")
    docs = df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("_text"))
    if size > benchmark_words:
        return _by_shuffles(docs, items)
    index = df.sparkSession.sparkContext.broadcast(Benchmark([tuple(row) for row in items.collect()]))  # no more than benchmark_words

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = list(index.value.judge(_texts(texts)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select("doc_id", judge("_text").alias("_r")).select("doc_id", "_r.*")


def _fingerprints(widths: list[int]):
    @F.pandas_udf("n_words long, prints array<long>")
    def build(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for _, run in slices(_texts(texts)):
            runs = Runs(run)
            found = [runs.selected(), *((p := np.flatnonzero(runs.inside(w)), runs.hashes_at(p, w)) for w in widths if w < WINDOW)]
            doc, prints = np.concatenate([runs.doc[p] for p, _ in found]), np.concatenate([h for _, h in found])
            order = np.argsort(doc, kind="stable")
            edges = np.searchsorted(doc[order], np.arange(len(run) + 1))
            for k, words in enumerate(runs.counts.tolist()):
                rows.append((words, np.unique(prints[order[edges[k] : edges[k + 1]]]).view(np.int64)))
        return pd.DataFrame(rows, columns=["n_words", "prints"])

    return build


def _near_hits(widths: list[int]):
    @F.pandas_udf("array<struct<window:long,width:int,places:array<int>>>")
    def build(texts: pd.Series, prints: pd.Series) -> pd.Series:
        out = []
        for text, live in zip(_texts(texts), prints, strict=True):
            (_, run), live = next(slices([text])), np.unique(np.asarray(live, np.int64).view(np.uint64))
            runs, found = Runs(run), []
            for width in widths:
                places = np.flatnonzero(runs.inside(width))
                least = runs.selected()[1] if width == WINDOW else runs.hashes_at(places, width)
                places = places[_found(least, live)[0]]
                hashes = runs.hashes_at(places, width).view(np.int64)
                order = np.argsort(hashes, kind="stable")
                edges = np.flatnonzero(np.diff(hashes[order], prepend=~hashes[order][:1]) != 0)
                groups = np.split(places[order], edges[1:]) if len(edges) else []
                found += [{"window": int(h), "width": width, "places": p} for h, p in zip(hashes[order][edges].tolist(), groups, strict=True)]
            out.append(found)
        return pd.Series(out, dtype=object)

    return build


@F.pandas_udf(T.LongType())
def _covered(places: pd.Series) -> pd.Series:
    """Distinct words of runs given as arrays of (place, width)."""
    return pd.Series([len({p + k for run in own for p in run["places"] for k in range(run["width"])}) for own in places], dtype="int64")


def _item_windows():
    @F.pandas_udf("array<struct<window:long,width:int,print:long>>")
    def build(texts: pd.Series) -> pd.Series:
        texts = _texts(texts)
        out = [[] for _ in texts]
        for k, width, _, fingerprints, hashes in windows_of(texts):
            out[k] = [{"window": h, "width": width, "print": f} for h, f in zip(hashes.view(np.int64).tolist(), fingerprints.view(np.int64).tolist(), strict=True)]
        return pd.Series(out, dtype=object)

    return build


def _by_shuffles(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``contamination`` for a benchmark of any size; equal texts are judged once."""
    parts = written(items.select(F.col("item_id").cast("string").alias("item"), F.explode(_item_windows()("text")).alias("_w")).select("item", "_w.*"), "item-windows")
    widths = [row[0] for row in parts.select("width").distinct().collect()]  # no more than WINDOW
    key: Column = F.sha2(F.coalesce("_text", F.lit("")), 256).alias("text_key")
    rows = written(docs.select("doc_id", key, _fingerprints(widths)("_text").alias("_f")).select("doc_id", "text_key", "_f.*"), "document-prints")
    prints = parts.select("print").distinct()
    live = rows.select("text_key", F.explode("prints").alias("print")).join(prints, "print", "left_semi")
    live = written(live.groupBy("text_key").agg(F.collect_set("print").alias("_live")), "live-prints")
    # One row a distinct text: copies merge inside the map tasks.
    texts = docs.select(key, F.coalesce("_text", F.lit("")).alias("_text")).join(live.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.first("_text").alias("_text"))
    near = texts.join(live, "text_key").select("text_key", F.explode(_near_hits(widths)("_text", "_live")).alias("_w")).select("text_key", "_w.*")
    near = written(near, "near-windows")
    sets = parts.groupBy("window", "width").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    sets = sets.withColumn("set_id", F.sha2(F.array_join("_items", "\x00"), 256))
    weights = near.groupBy("window", "width").agg(F.count("*").alias("_times"))
    known = written(sets.join(weights, ["window", "width"]).withColumn("_key", F.struct("window", "width")), "known-windows")
    total = known.agg(F.sum("_times")).first()[0] or 0
    met = lookup(near.withColumn("_key", F.struct("window", "width")).drop("window", "width"), known.select("_key", "_times", "set_id"), "_key", "_times", total, F.col("text_key"))
    met = written(met.select("text_key", "set_id", F.col("_key.width").alias("width"), "places"), "met-windows")
    hit = met.groupBy("text_key").agg(F.collect_list(F.struct("width", "places")).alias("_runs"), F.collect_set("set_id").alias("_sets")).select("text_key", _covered("_runs").alias("n_hit"), F.sort_array("_sets").alias("_sets"))
    # Items are listed once for each distinct collection of sets.
    hit = written(hit.withColumn("_list", F.sha2(F.array_join("_sets", ","), 256)), "hit-texts")
    lists = hit.groupBy("_list").agg(F.first("_sets").alias("_sets")).select("_list", F.explode("_sets").alias("set_id"))
    named = lists.join(known.groupBy("set_id").agg(F.first("_items").alias("_items")), "set_id").select("_list", F.explode("_items").alias("item"))
    named = named.groupBy("_list").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    named = named.select("_list", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"))
    copies = rows.groupBy("text_key").agg(F.count("*").alias("_copies"))
    judged = written(hit.select("text_key", "n_hit", "_list").join(named, "_list", "left").join(copies, "text_key").drop("_list"), "judged-texts")
    met_rows = lookup(rows.select("doc_id", "text_key", "n_words").join(judged.select("text_key"), "text_key", "left_semi"), judged, "text_key", "_copies", rows.count(), F.col("doc_id"))
    clean = rows.join(judged.select("text_key"), "text_key", "left_anti")
    every = met_rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256").unionByName(clean.select("doc_id", "n_words"), allowMissingColumns=True)
    n_hit = F.coalesce("n_hit", F.lit(0))
    return every.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
