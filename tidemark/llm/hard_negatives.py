"""Hard negatives from Hilbert-ordered blocks of vectors, chosen by their zone maps.

Method.  Rows are sorted by label and by their place on a Hilbert curve through the widest dimensions,
and written as blocks of one label with the least and greatest value of every dimension.  An anchor looks
for rows whose inner product lies in a window.  Interval arithmetic over a block's zone map bounds all
inner products with its rows, and only blocks whose bounds meet a window are read for an anchor.

Positives come first: the anchor's own block gives a score that its last positive reaches at least, and
the window is everything from there.  The positives give the windows of the negatives.  Anchors travel in
groups that are neighbours on the curve, zone maps in pages; a group meets every page, then its blocks in
units of bounded size, where it keeps the best rows per anchor and window.  The bounds are exact, so the
results are those of comparing everything; how many blocks they spare depends on the vectors.

Scores are exact integers: products are summed in double precision while 2^53 cannot be exceeded, and
else, with every block read, in whole numbers, kept within 2^62 either way.

Edge cases: rows without a vec_id or label, a vector, or with a null or non-finite component take no part;
shorter vectors are padded with zeros; repeated rows are rows like others, also as each other's positives;
ties go to the smaller vec_id; an empty table has no negatives; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import partitions, written

#: Rows in a block, anchors in a group, zone maps in a page, blocks in a unit of work.
BLOCK, GROUP, PAGE, UNIT = 1024, 512, 1024, 32
#: Dimensions and bits of the curve.
CURVE_DIMENSIONS, CURVE_BITS = 12, 5
LEAST, MOST = -(1 << 62), 1 << 62

# Fixed values of the task: positives an anchor, negatives a positive, the window in per cent of the positive's score.
POSITIVES, NEGATIVES, FROM_PER_CENT, TO_PER_CENT = 5, 3, 50, 95
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10

BLOCK_ROW = "block long, label long, rows int, ids binary, vectors binary, low binary, high binary"
FOUND = "anchor long, place int, score long, vec_id long"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (rows x dimensions, ``bits`` each)."""
    axes = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    step = 1 << (bits - 1)
    while step > 1:
        below = step - 1
        for k in range(len(axes)):
            set_bit = (axes[k] & step) != 0
            swap = np.where(set_bit, 0, (axes[0] ^ axes[k]) & below)
            axes[0] = np.where(set_bit, axes[0] ^ below, axes[0] ^ swap)
            if k:
                axes[k] = axes[k] ^ swap
        step >>= 1
    for k in range(1, len(axes)):
        axes[k] = axes[k] ^ axes[k - 1]
    turn = np.zeros(len(cells), np.int64)
    step = 1 << (bits - 1)
    while step > 1:
        turn = np.where((axes[-1] & step) != 0, turn ^ (step - 1), turn)
        step >>= 1
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


def labelled_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, relabelled, with whole-number components."""
    kept = df.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    kept = kept.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("_v", lambda x: F.floor(256 * x)).alias("vector"))


class Space:
    """What all tasks know of the vectors: dimensions, the curve's axes, whether doubles are exact."""

    def __init__(self, rows: DataFrame):
        spread = rows.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop("x").alias("width"))
        stats = sorted(spread.collect(), key=lambda r: r["at"])  # one row a dimension
        self.dimensions = len(stats)
        widest = sorted((r for r in stats if r["low"] < r["high"]), key=lambda r: (-r["width"], r["at"]))[:CURVE_DIMENSIONS]
        self.axes = [(r["at"], r["low"], r["high"]) for r in widest]
        largest = max((max(abs(r["low"]), abs(r["high"])) for r in stats), default=0)
        self.exact = self.dimensions * largest**2 < 1 << 53
        self.kind = "<i4" if largest < 1 << 31 else "<i8"

    def matrix(self, vectors: pd.Series) -> np.ndarray:
        out = np.zeros((len(vectors), self.dimensions), self.kind)
        for k, vector in enumerate(vectors):
            out[k, : len(vector)] = vector
        return out

    def unpacked(self, vectors: bytes) -> np.ndarray:
        """A matrix to multiply, from bytes."""
        return np.frombuffer(vectors, self.kind).reshape(-1, self.dimensions).astype(np.float64 if self.exact else object)

    def scores(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not self.dimensions:
            return np.zeros((len(left), len(right)), np.int64)
        return np.clip(left @ right.T, LEAST, MOST).astype(np.int64)

    def key(self, vector: Column) -> Column:
        axes, bits = self.axes, CURVE_BITS

        @F.pandas_udf("long")
        def place(vectors: pd.Series) -> pd.Series:
            if not axes:
                return pd.Series(np.zeros(len(vectors), np.int64))
            picked = [[v[at] if at < len(v) else 0 for at, _, _ in axes] for v in vectors]
            low, high = (np.array([a[k] for a in axes], np.float64) for k in (1, 2))
            cells = (np.array(picked, np.float64).reshape(-1, len(axes)) - low) / (high - low) * (1 << bits)
            return pd.Series(hilbert_keys(np.clip(cells, 0, (1 << bits) - 1).astype(np.int64), bits))

        return place(vector)


def _blocks(rows: DataFrame, space: Space) -> DataFrame:
    """The rows of ``BLOCK_ROW`` in order of label and curve."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            cuts = _cuts(held["label"].to_numpy())
            out = [_block(number + k, held.iloc[a:b], space) for k, (a, b) in enumerate(zip(cuts, cuts[1:-1]))]
            number += len(out)
            held = held.iloc[cuts[-2] if len(cuts) > 1 else 0 :]
            if out:
                yield pd.DataFrame(out, columns=_names(BLOCK_ROW))
        if held is not None and len(held):
            yield pd.DataFrame([_block(number, held, space)], columns=_names(BLOCK_ROW))

    ranged = rows.withColumn("_key", space.key(F.col("vector"))).repartitionByRange(partitions(rows.sparkSession), "label", "_key", "vec_id")
    return written(ranged.sortWithinPartitions("label", "_key", "vec_id").mapInPandas(pack, BLOCK_ROW), "vector-blocks")


def _cuts(labels: np.ndarray) -> list[int]:
    """Where blocks begin, and the end: at each new label and every ``BLOCK`` rows of one."""
    starts = np.flatnonzero(np.diff(labels, prepend=labels[:1] - 1) != 0).tolist() + [len(labels)]
    return [at for a, b in zip(starts, starts[1:]) for at in range(a, b, BLOCK)] + [len(labels)]


def _block(number: int, frame: pd.DataFrame, space: Space) -> tuple:
    vectors = space.matrix(frame["vector"])
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    return number, int(frame["label"].iloc[0]), len(frame), frame["vec_id"].to_numpy(np.int64).tobytes(), vectors.tobytes(), low.tobytes(), high.tobytes()


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _anchors(blocks: DataFrame, space: Space) -> DataFrame:
    """(anchor, vec_id, label, vector, low): ``low`` is reached by as many rows of the anchor's block as it has positives."""

    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                own = np.flatnonzero(ids % ANCHOR_EVERY == 0)
                if not len(own):
                    continue
                vectors = space.unpacked(row.vectors)
                scores = space.scores(vectors[own], vectors)
                scores[np.arange(len(own)), own] = LEAST
                low = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES] if len(ids) > POSITIVES else np.full(len(own), LEAST)
                width = len(row.vectors) // len(ids)
                out += [(row.block << 10 | k, ids[k], row.label, row.vectors[k * width : (k + 1) * width], [x], [MOST]) for k, x in zip(own.tolist(), low.tolist())]
            yield pd.DataFrame(out, columns=["anchor", "vec_id", "label", "vector", "low", "high"])

    chosen = blocks.select("block", "label", "ids", "vectors")
    return written(chosen.mapInPandas(seed, "anchor long, vec_id long, label long, vector binary, low array<long>, high array<long>"), "anchors")


def _groups(anchors: DataFrame, count: int) -> DataFrame:
    """Anchors in order of their blocks, about ``GROUP`` in a row: (group, anchors, labels, vectors, low, high)."""
    groups = max(1, math.ceil(count / GROUP))
    bounds = np.array(anchors.approxQuantile("anchor", [k / groups for k in range(1, groups)], 0.1 / groups), np.int64) if groups > 1 else np.zeros(0, np.int64)

    @F.pandas_udf("long")
    def group(anchor: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, anchor.to_numpy(), side="right"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("anchor")
        low, high = (np.stack(frame[c].to_numpy()).astype(np.int64).tobytes() for c in ("low", "high"))
        row = (frame["group"].iloc[0], frame["anchor"].to_numpy(np.int64).tobytes(), frame["label"].to_numpy(np.int64).tobytes(), b"".join(frame["vector"]), low, high)
        return pd.DataFrame([row], columns=["group", "anchors", "labels", "vectors", "low", "high"])

    dealt = anchors.select(group("anchor").alias("group"), "anchor", "label", "vector", "low", "high")
    schema = "group long, anchors binary, labels binary, vectors binary, low binary, high binary"
    return written(dealt.groupBy("group").applyInPandas(pack, schema), "anchor-groups")


def _pages(blocks: DataFrame, pages: int) -> DataFrame:
    """The zone maps of about ``PAGE`` blocks in a row."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        row = (frame["page"].iloc[0], *(frame[c].to_numpy(np.int64).tobytes() for c in ("block", "label")), *(b"".join(frame[c]) for c in ("low", "high")))
        return pd.DataFrame([row], columns=["page", "blocks", "block_labels", "zone_low", "zone_high"])

    zones = blocks.select(F.pmod(F.xxhash64("block"), F.lit(pages)).alias("page"), "block", "label", "low", "high")
    return written(zones.groupBy("page").applyInPandas(pack, "page long, blocks binary, block_labels binary, zone_low binary, zone_high binary"), "zone-maps")


def bounds_of(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each anchor with any vector between ``low`` and ``high`` of each block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _chosen(groups: DataFrame, pages: DataFrame, count: int, space: Space, same_label: bool) -> DataFrame:
    """(group, block, need): the blocks that a group reads, and a bit for each anchor that needs it."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                labels, blocks, own = (np.frombuffer(x, np.int64) for x in (row.labels, row.blocks, row.block_labels))
                need = (labels[:, None] == own) == same_label
                if space.exact and space.dimensions:
                    low, high = (np.frombuffer(x, np.int64).reshape(len(labels), -1) for x in (row.low, row.high))
                    least, most = bounds_of(space.unpacked(row.vectors), space.unpacked(row.zone_low), space.unpacked(row.zone_high))
                    meets = np.zeros(need.shape, bool)
                    for k in range(low.shape[1]):
                        meets |= (most >= low[:, k : k + 1]) & (least <= high[:, k : k + 1]) & (low[:, k : k + 1] <= high[:, k : k + 1])
                    need &= meets
                wanted = np.flatnonzero(need.any(axis=0))
                bits = np.packbits(need[:, wanted].T, axis=1)
                yield pd.DataFrame({"group": row.group, "block": blocks[wanted], "need": [b.tobytes() for b in bits]}, columns=["group", "block", "need"])

    met = groups.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("page", F.col("page").cast("long")).join(pages, "page")
    columns = ["group", "labels", "vectors", "low", "high", "blocks", "block_labels", "zone_low", "zone_high"]
    return written(met.select(*columns).mapInPandas(choose, "group long, block long, need binary"), "chosen-blocks")


def _best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` best rows of each slot, by score, then id."""
    order = np.lexsort((ids, -score, slot))
    sorted_slot = slot[order]
    first = np.searchsorted(sorted_slot, sorted_slot, side="left")
    return order[np.arange(len(order)) - first < count]


def _read(chosen: DataFrame, blocks: DataFrame, groups: DataFrame, units: int, space: Space, count: int) -> DataFrame:
    """The ``count`` best rows of each anchor and window over all blocks: (anchor, place, score, vec_id, turn)."""

    def read(key: tuple, rows: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        names = _names(FOUND)
        if not len(rows) or not len(group):
            return pd.DataFrame({n: [] for n in names}, columns=names)
        own = group.iloc[0]
        anchors = np.frombuffer(own["anchors"], np.int64)
        low, high = (np.frombuffer(own[c], np.int64).reshape(len(anchors), -1) for c in ("low", "high"))
        vectors, floor = space.unpacked(own["vectors"]), low.copy()
        held = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(low.shape[1])]
        for row in rows.itertuples():
            who = np.flatnonzero(np.unpackbits(np.frombuffer(row.need, np.uint8), count=len(anchors)))
            ids = np.frombuffer(row.ids, np.int64)
            scores = space.scores(vectors[who], space.unpacked(row.vectors) if space.dimensions else np.zeros((row.rows, 0)))
            for k, before in enumerate(held):
                a, b = np.nonzero((scores >= floor[who, k][:, None]) & (scores <= high[who, k][:, None]))
                other = anchors[who[a]] != (row.block << 10 | b)
                a, b = a[other], b[other]
                slot, score, found = (np.concatenate(x) for x in zip(before, (who[a], scores[a, b], ids[b])))
                keep = _best(slot, score, found, count)
                held[k] = slot, score, found = slot[keep], score[keep], found[keep]
                # The last of a full slot is what a new row has to reach.
                full = np.flatnonzero(np.bincount(slot, minlength=len(anchors)) == count)
                least = np.full(len(anchors), MOST)
                np.minimum.at(least, slot, score)
                floor[full, k] = least[full]
        out = [pd.DataFrame({"anchor": anchors[s], "place": k, "score": x, "vec_id": i}) for k, (s, x, i) in enumerate(held)]
        return pd.concat(out, ignore_index=True)

    unit = F.pmod(F.xxhash64("block"), F.lit(units)).alias("unit")
    left = chosen.join(blocks.select("block", "rows", "ids", "vectors"), "block").select("group", unit, "block", "need", "rows", "ids", "vectors")
    right = groups.withColumn("unit", F.explode(F.sequence(F.lit(0), F.lit(units - 1)))).withColumn("unit", F.col("unit").cast("long"))
    found = left.groupBy("group", "unit").cogroup(right.groupBy("group", "unit")).applyInPandas(read, FOUND)
    turn = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "vec_id"))
    return written(found.withColumn("turn", turn).filter(F.col("turn") <= count), "best-rows")


def mined(df: DataFrame) -> DataFrame:
    """One row per negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = labelled_vectors(df)
    space = Space(rows)
    blocks = _blocks(rows, space)
    anchors = _anchors(blocks, space)
    n_blocks, n_anchors = blocks.count(), anchors.count()
    n_pages = max(1, math.ceil(n_blocks / PAGE))
    pages = _pages(blocks, n_pages)
    # Enough units for all cores, none above UNIT blocks by much.
    n_groups = max(1, math.ceil(n_anchors / GROUP))
    units = max(math.ceil(n_blocks / UNIT), min(n_blocks, math.ceil(partitions(df.sparkSession) / n_groups)), 1)

    groups = _groups(anchors, n_anchors)
    positives = _read(_chosen(groups, pages, n_pages, space, True), blocks, groups, units, space, POSITIVES)

    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("turn", "score"))).alias("_p"))  # POSITIVES at most
    score = F.transform("_p", lambda p: p["score"])
    # Rounded inwards to whole scores; missing positives have an empty window.
    low, high = F.transform(score, lambda s: -_per_cent(s, -FROM_PER_CENT)), F.transform(score, lambda s: _per_cent(s, TO_PER_CENT))

    def filled(values: Column, rest: int) -> Column:
        return F.slice(F.concat(values, F.array_repeat(F.lit(rest).cast("long"), POSITIVES)), 1, POSITIVES)

    asked = anchors.select("anchor", "label", "vector").join(windows.select("anchor", filled(low, MOST).alias("low"), filled(high, LEAST).alias("high")), "anchor")
    groups = _groups(written(asked, "asking-anchors"), n_anchors)
    negatives = _read(_chosen(groups, pages, n_pages, space, False), blocks, groups, units, space, NEGATIVES)

    named = positives.select("anchor", (F.col("turn") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = negatives.join(named, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return joined.select("anchor_id", "positive_id", F.col("turn").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _per_cent(value: Column, share: int) -> Column:
    """The whole number at or below ``share`` hundredths of a value."""
    wide = value.cast("decimal(20,0)") * F.lit(share).cast("decimal(4,0)")
    return ((wide - F.pmod(wide, F.lit(100).cast("decimal(4,0)"))) / 100).cast("long")
