"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full sets.

Method.  Two collections of short keys are drawn from each document's shingle set, U and V with
``BANDS`` keys of ``ROWS`` minhashes each.  Table (i, j) is keyed by the pair (u_i, v_j), so
BANDS * BANDS tables of 2 * ROWS minhashes need only 2 * BANDS * ROWS minhashes: 64 instead of 1024.
A pair at similarity s is in no common table with probability at most 2 * (1 - s^ROWS)^BANDS, that is
1.6e-7 at 0.8 and far less above.  Table keys are formed only from keys that a second document
shares, which leaves out nearly all documents from the start.

Candidates and links.  Documents with one shingle set form one node.  First, in each bucket of the
tables (i, i) every member is compared with the smallest node, and confirmed links are contracted to
components: a large group costs one comparison a member and table.  Then all tables are searched for
pairs of different components.  They need not be laid out, as (i, j) for all j is one group by u_i
within which some v_j must agree.  Its pairs are compared in blocks of bounded size: sizes first, then
outlines of the sets (least shingle of 512 ranges; a share below 0.7 has probability under 1e-7 at
similarity 0.8), then the full sets.  Only links leave a block.

Shingles are 64-bit hashes of word runs.  Edge cases: null, empty and blank texts have no shingles
and form their own component; with fewer words than a shingle has, all words are one shingle;
repeated rows and equal ids are members like others; extra columns are ignored.
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
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import as_name
from tidemark.llm.scratch import as_rows, having, inside, lookup, numbered_ranges, written

BANDS, ROWS = 16, 2
HASHES = 2 * BANDS * ROWS
#: Members, and shingles, in a block of pairwise comparison.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Members of a group above which it is dealt by both of its keys.
SPLIT = 8192
#: Ranges of a set's outline.
BINS = 512
UNIT = ["_key", "_j", "_at", "_x", "_y"]
_RANDOM = np.random.default_rng(7)
_FACTOR = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)

# Fixed values of the comparison: 100 * intersection >= 80 * union.
SIMILAR_PER_CENT = 80


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, run in slices(texts):
        batch = Batch(run, lower=True)
        words = batch.word_hashes()
        hashes, places = batch.windows(words, width)
        owner = batch.word_doc[places]
        edges = np.searchsorted(owner, np.arange(batch.count + 1))
        for k in range(batch.count):
            if batch.words[k] >= width:
                yield np.unique(hashes[edges[k] : edges[k + 1]])
            elif batch.words[k]:
                one = np.zeros(1, np.uint64)
                for h in words[batch.first_word[k] : batch.first_word[k + 1]]:
                    one = one * MULTIPLIER + h
                yield mix(one + np.uint64(batch.words[k]))
            else:
                yield np.zeros(0, np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        part = shingles[start : start + 2048, None] * _FACTOR + _SHIFT
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketch(text: Column, width: int) -> Column:
    """Struct (n_shingles, set_id, bands): set_id names the set, bands has the keys of U, then of V."""

    @F.pandas_udf("n_shingles long, set_id string, bands array<long>")
    def build(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for shingles in shingle_sets(texts.where(texts.notna(), None).tolist(), width):
            if not len(shingles):
                rows.append((0, None, None))
                continue
            least = minhashes(shingles)
            bands = np.zeros(2 * BANDS, np.uint64)
            for k in range(ROWS):
                bands = mix(bands * MULTIPLIER + least[k::ROWS])
            name = hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()
            rows.append((len(shingles), name, bands.view(np.int64)))
        return pd.DataFrame(rows, columns=["n_shingles", "set_id", "bands"])

    return build(text)


def _packed_sets(text: Column, width: int) -> Column:
    @F.pandas_udf("binary")
    def build(texts: pd.Series) -> pd.Series:
        return pd.Series([s.astype("<u8").tobytes() for s in shingle_sets(texts.where(texts.notna(), None).tolist(), width)], dtype=object)

    return build(text)


@F.pandas_udf(T.BooleanType())
def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_alike(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")) for a, b in zip(left, right, strict=True)], dtype=bool)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar; many pairs may share their b."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
    low, high = F.least(F.length("_a"), F.length("_b")), F.greatest(F.length("_a"), F.length("_b"))
    return both.filter(100 * low >= SIMILAR_PER_CENT * high).filter(_similar("_a", "_b")).select("a", "b")


def _live_bands(nodes: DataFrame, total: int) -> DataFrame:
    """(node, _band, _value, _key) of the band keys that several nodes share."""
    bands = nodes.select("node", F.posexplode("bands").alias("_band", "_value"))
    bands = bands.select("node", "_band", "_value", F.xxhash64("_band", "_value").alias("_key"))
    shared = written(bands.groupBy("_key").agg(F.count("*").alias("_members")).filter("_members > 1"), "shared-bands")
    return written(having(bands, shared, "_key", "_members", total), "live-bands")


def _diagonal_keys(live: DataFrame) -> DataFrame:
    """(node, _key): keys of the tables (i, i), built from band keys that others share."""
    turn = F.col("_band") % BANDS
    halves = live.groupBy("node", turn.alias("_turn")).agg(
        F.max(F.when(F.col("_band") < BANDS, F.col("_value"))).alias("_u"), F.max(F.when(F.col("_band") >= BANDS, F.col("_value"))).alias("_v")
    )
    return written(halves.filter("_u is not null and _v is not null").select("node", F.xxhash64("_turn", "_u", "_v").alias("_key")), "diagonal-keys")


def _star_pairs(keys: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """Each member of a bucket with the bucket's smallest node."""
    met = lookup(keys, buckets, "_key", "_members", total, F.col("node"))
    return met.filter("node <> _least").select(F.col("node").alias("a"), F.col("_least").alias("b")).distinct()


def _crossing_links(live: DataFrame, nodes: DataFrame, sets: DataFrame, parts: DataFrame, total: int) -> DataFrame:
    """Links (a, b) between components of the pairs that meet in a table.

    Members meet by their key u_i and are compared only where some v_j agrees as well, each pair at
    its first u_i.  Groups above ``SPLIT`` members are dealt by (u_i, v_j) from the start."""
    placed = live.filter(F.col("_band") < BANDS).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sized = placed.join(sets.select("node", (F.length("shingles") / 8).alias("_size")), "node")
    groups = sized.groupBy("_key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count("*").alias("_count"), F.sum("_size").alias("_sum"))
    spanning = written(groups.filter("_low <> _high").select("_key", "_count", "_sum"), "open-groups")
    members = lookup(sized.select("node", "component", "_key"), spanning, "_key", "_count", total, F.col("node"))
    members = members.join(nodes.select("node", "bands"), "node").join(sets, "node")
    split = F.when(F.col("_count") > SPLIT, F.sequence(F.lit(BANDS), F.lit(2 * BANDS - 1))).otherwise(F.array(F.lit(-1)))
    members = members.withColumn("_j", F.explode(split))
    members = members.withColumn("_at", F.when(F.col("_j") < 0, F.lit(0)).otherwise(F.element_at("bands", F.col("_j") + 1)))
    blocks = F.greatest(F.ceil(F.col("_count") / BLOCK), F.ceil(F.col("_sum") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("_own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("_key", "_j", "_at", F.least("_own", "_other").alias("_x"), F.greatest("_own", "_other").alias("_y"), "_own", "node", "component", "bands", "shingles")
    grouped = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)
    return grouped.mapInPandas(_links_of_units, "a long, b long")


def _links_of_units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        last = (frame[UNIT] == frame[UNIT].iloc[-1]).all(axis=1) if len(frame) else np.zeros(0, bool)
        rest, whole = frame[last], frame[~last]
        yield _links_of(whole)
    if rest is not None:
        yield _links_of(rest)


def _outline(shingles: np.ndarray) -> np.ndarray:
    """The least shingle of each of ``BINS`` equal ranges, as a byte, 0 where the range is empty."""
    out = np.zeros(BINS, np.uint8)
    bins = (shingles >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out[bins[first]] = mix(shingles[first]) % np.uint64(255) + np.uint64(1)
    return out


def _links_of(frame: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links inside the units of a frame."""
    found: list[tuple[int, int]] = []
    if len(frame):
        fresh = (frame[UNIT] != frame[UNIT].shift()).any(axis=1).to_numpy()
        edges = [*np.flatnonzero(fresh).tolist(), len(frame)]
        node, part, own, split, x, y = (frame[c].to_numpy() for c in ("node", "component", "_own", "_j", "_x", "_y"))
        bands = np.stack(frame["bands"].to_numpy())
        sets = [np.frombuffer(s, "<u8") for s in frame["shingles"]]
        size = np.array([len(s) for s in sets])
        outlines = np.array([_outline(s) for s in sets])
        for start, stop in zip(edges, edges[1:]):
            # Which band of U this unit stands for: all its members agree there.
            alike = (bands[start:stop, :BANDS] == bands[start, :BANDS]).all(axis=0)
            for k in range(start, stop - 1):
                rest = slice(k + 1, stop)
                fits = part[rest] != part[k]
                if x[k] != y[k]:
                    fits &= own[rest] != own[k]
                fits &= 100 * np.minimum(size[rest], size[k]) >= SIMILAR_PER_CENT * np.maximum(size[rest], size[k])
                at = np.flatnonzero(fits) + k + 1
                if not len(at):
                    continue
                same = bands[at] == bands[k]
                # At its first u_i, and at its first v_j where these deal the rows.
                first_u = same[:, :BANDS].argmax(axis=1)
                meets = alike[first_u] & same[:, BANDS:].any(axis=1)
                if split[k] >= 0:
                    meets &= same[:, BANDS:].argmax(axis=1) == split[k] - BANDS
                at = at[meets]
                if not len(at):
                    continue
                filled = (outlines[at] | outlines[k]) > 0
                share = ((outlines[at] == outlines[k]) & filled).sum(axis=1) / filled.sum(axis=1)
                for m in at[share >= (0.7 if size[k] >= 64 else 0.5)]:
                    if _alike(sets[k], sets[m]):
                        found.append((max(node[k], node[m]), min(node[k], node[m])))
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= SIMILAR_PER_CENT * (len(x) + len(y) - shared)


def near_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """One row per input row: doc_id, text_key, n_shingles, component_id, kept, first.

    ``component_id`` is the smallest doc_id linked, directly or through others; ``kept`` says that
    the row has this id; ``first`` marks the rows whose text is the group's first, by (doc_id, text)."""
    text, spark = F.col(f"`{text_column}`"), df.sparkSession
    source = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), sketch(text, width).alias("_s"))
    rows = written(source.select("doc_id", "text_key", "_s.*"), "sketches")
    sets = rows.filter("n_shingles > 0").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_key")).alias("_first"),
        F.count("*").alias("copies"),
        F.first("bands").alias("bands"),
    )
    nodes = numbered_ranges(sets.select("set_id", "_first.*", "copies", "bands"), F.col("doc_id"), F.col("set_id"), purpose="nodes")
    nodes = nodes.withColumn("node", as_name())
    count = nodes.count()

    live = _live_bands(nodes, 2 * BANDS * count)
    keys = _diagonal_keys(live)
    buckets = keys.groupBy("_key").agg(F.count("*").alias("_members"), F.min("node").alias("_least")).filter("_members > 1")
    buckets = written(buckets, "buckets")
    entries = keys.count()

    # A node that shares no key of U, or none of V, is in no table with another.
    met_others = live.groupBy("node").agg(F.min("_band").alias("_low"), F.max("_band").alias("_high")).filter((F.col("_low") < BANDS) & (F.col("_high") >= BANDS)).select("node")
    wanted = met_others.join(nodes, "node").select("node", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"))
    texts = df.select(F.col(f"`{id_column}`").alias("doc_id"), text.alias("_whole")).withColumn("text_key", F.xxhash64("_whole"))
    met = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_doc"]) & (texts["text_key"] == wanted["_text"]))
    packed = met.select("node", _packed_sets(F.col("_whole"), width).alias("shingles"))
    sets_of = written(packed.dropDuplicates(["node"]), "shingle-sets")

    links = written(_confirmed(_star_pairs(keys, buckets, entries), sets_of), "star-links")
    parts = written(components(links), "star-components")
    more = written(_crossing_links(live, nodes, sets_of, parts, live.count()), "cross-links")
    if not more.isEmpty():
        parts = written(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    roots = nodes.select(F.col("node").alias("component"), F.col("doc_id").alias("component_id"), F.col("text_key").alias("_root_text"))
    named = nodes.select("set_id", "copies", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named.join(roots, "component").select("set_id", "copies", "component_id", "_root_text"), "set-components")
    joined = lookup(rows.filter("n_shingles > 0"), named, "set_id", "copies", rows.count(), F.xxhash64("doc_id", "text_key"))
    alone = rows.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "_root_text": F.col("text_key")})
    columns = ["doc_id", "text_key", "n_shingles", "component_id", "_root_text"]
    every = joined.select(*columns).unionByName(alone.select(*columns))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return every.select("doc_id", "text_key", "n_shingles", "component_id", kept.alias("kept"), (kept & (F.col("text_key") == F.col("_root_text"))).alias("first"))


def one_of_each(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5) -> DataFrame:
    """The first row of each group, with all its columns; rows without shingles all stay."""
    rows = written(near_groups(df, id_column, text_column, width), "near-groups")
    stay = rows.filter("first").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (F.col("n_shingles") > 0).alias("_grouped")).distinct()
    keyed = as_rows(df).withColumns({"_own_id": inside(id_column), "_own": F.xxhash64(inside(text_column))})
    met = keyed.join(stay, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")))
    if not rows.filter("first and n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        once = met.filter("_grouped").dropDuplicates(["_id", "_key"])
        met = once.unionByName(met.filter("not _grouped"))
    return met.select("row.*")
