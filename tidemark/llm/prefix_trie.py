"""The trie of conversation prefixes by range-partition splitters and their skeleton.

Method.  A conversation is a path of turn tokens, its turns told by digest.  Equal paths are
aggregated first, in chunks of neighbouring ids, so that a path shared by a third of all conversations
costs one row a chunk.  Splitters drawn from the paths deal them to shards in path order.  A node whose
members are in two shards is a prefix of the splitter between them: the trie of the splitters, the
skeleton, is broadcast, and one pass over each sorted shard finishes every other node with a stack.
Nodes of the skeleton leave partial aggregates there, which are reduced by node; what is below them in
the skeleton is then added up along it.  Results never depend on the splitters, only the balance does.

Memory: a shard keeps its open path and the finished children of open nodes outside the skeleton, so no
more than the shard itself.  Ids that end at a node are hashed as they stream by.  The skeleton has at
most ``splitters * turns`` nodes, see ``splitters_of``.

Edge cases: rows without a conv_id belong to no conversation and are left out; null role or text counts
as empty, a null turn comes first, rows of one turn are ordered by their content; repeated rows are turns
like others; a conversation's path is held by one task (20 bytes a turn); an empty table has no nodes, not
even a root; the remainder of a negative id has its sign, as in SQL; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.scratch import partitions, written

#: Bytes of a turn in a path: 16 of its digest, then the length of its text.
DIGEST, TOKEN = 16, 20
#: Conversation ids in a chunk of equal paths, as a power of two.
CHUNK_BITS = 8
#: Sampled paths for each shard, and bytes of all samples together.
SAMPLES, SAMPLE_BYTES = 20, 32_000_000

NO_MEMBER = hashlib.sha256(b"").hexdigest()
NODE = "skeleton int, below int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
ROW = pa.schema(
    [("skeleton", pa.int32()), ("below", pa.int32())]
    + [(name, pa.int64()) for name in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)


def turn_token(role: Column, text: Column) -> Column:
    """A turn as 40 hexadecimal digits: equal for equal role and text, with the bytes of the text at the end."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.octet_length(text))), 8, "0"))


def rebuilt_paths(conversations: DataFrame, family: int = 5, longest_head: int = 8) -> DataFrame:
    """(conv_id, path): each conversation behind the first turns of its family's first conversation.

    The family of c starts at c - c % family; of that conversation the first h turns are taken, then
    those of c after its own first h, with h = crc32 of c's decimal digits % (longest_head + 1)."""
    c = F.col("conv_id")
    rows = conversations.filter(c.isNotNull()).select(c.cast("long").alias("conv_id"), F.struct(F.col("turn"), turn_token(F.col("role"), F.col("text")).alias("token")).alias("_turn"))
    rows = rows.withColumn("_first", c - c % family)
    # One shuffle by family serves the grouping and the join.
    own = rows.repartition("_first").groupBy("_first", "conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    own = own.withColumn("_turns", F.transform("_turns", lambda t: t["token"]))
    heads = own.filter("conv_id = _first").select("_first", F.col("_turns").alias("_head"))
    h = (F.crc32(c.cast("string").cast("binary")) % (longest_head + 1)).cast("int")
    head = F.slice(F.coalesce("_head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("_turns", h + 1, F.greatest(F.size("_turns") - h, F.lit(0)))
    return own.join(heads, "_first", "left").select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("path"))


def splitters_of(chunks: DataFrame, shards: int) -> list[bytes]:
    """At most ``shards`` - 1 ascending paths that deal the chunks evenly.

    About ``SAMPLES`` paths a shard reach the driver, cut after as many turns as ``SAMPLE_BYTES`` allow.
    A splitter is cut again behind the first turn in which it differs from the sample before it."""
    wanted = SAMPLES * shards
    turns = max(1, SAMPLE_BYTES // (wanted * TOKEN))
    share = min(1.0, wanted / max(1, chunks.count()))
    drawn = chunks.filter(F.pmod(F.xxhash64("path", "bucket"), F.lit(1 << 30)) < share * (1 << 30))
    paths = sorted(bytes(row[0]) for row in drawn.select(F.substring("path", 1, turns * TOKEN)).collect())  # bounded, see above
    found: list[bytes] = []
    for k in range(1, shards):
        at = k * len(paths) // shards
        if at == 0 or paths[at] == paths[at - 1]:
            continue
        cut = paths[at][: (_common(paths[at - 1], paths[at]) + 1) * TOKEN]
        if not found or cut > found[-1]:
            found.append(cut)
    return found


def _common(a: bytes, b: bytes) -> int:
    """Leading turns that two paths share."""
    at, most = 0, min(len(a), len(b))
    while at < most and a[at : at + TOKEN] == b[at : at + TOKEN]:
        at += TOKEN
    return at // TOKEN


class Skeleton:
    """The trie of the splitters: node 0 is the root, children come after their parents."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = splitters
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.text_bytes = [-1], [0], [0]
        for path in splitters:
            node = 0
            for at in range(0, len(path), TOKEN):
                token = path[at : at + TOKEN]
                if (node, token) not in self.child:
                    self.child[node, token] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(at // TOKEN + 1)
                    self.text_bytes.append(int.from_bytes(token[DIGEST:], "big"))
                node = self.child[node, token]

    def totals(self, parts: list) -> list[tuple]:
        """Final rows (node, values) of the skeleton from its reduced partial aggregates."""
        at = {row["skeleton"]: row for row in parts}
        children, leaves, saved = {}, {}, {}
        for node in sorted(at):
            children[node], leaves[node], saved[node] = at[node]["n_children"], at[node]["n_leaves"], at[node]["saved_tokens"]
        for node in sorted(at, reverse=True):
            # All that is below has been added already.
            leaves[node] += children[node] == 0
            saved[node] += (at[node]["n_convs"] - 1) * self.text_bytes[node]
            if node:
                children[self.parent[node]] += 1
                leaves[self.parent[node]] += leaves[node]
                saved[self.parent[node]] += saved[node]
        return [
            (node, None, row["conv_id"], self.depth[node], at[self.parent[node]]["conv_id"] if node else None, row["n_convs"], children[node], leaves[node], saved[node], row["ends_sha256"] or NO_MEMBER)
            for node, row in at.items()
        ]


class _Node:
    __slots__ = ("depth", "text_bytes", "skeleton", "least", "convs", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, text_bytes: int, skeleton: int):
        self.depth, self.text_bytes, self.skeleton = depth, text_bytes, skeleton
        self.least = None
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends = None
        self.waiting: list[tuple] = []


def nodes_of_shard(rows: Iterator[tuple[bytes, int, int, str]], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of ``NODE`` from (path, least id, conversations, ids) in order of path, then of ids."""
    stack: list[_Node] = []
    last = None

    def close() -> Iterator[tuple]:
        node = stack.pop()
        above = stack[-1] if stack else None
        if above is not None:
            above.convs += node.convs
            above.least = node.least if above.least is None else min(above.least, node.least)
        ends = node.ends.hexdigest() if node.ends else None
        if node.skeleton >= 0:
            yield (node.skeleton, None, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, ends)
            return
        for child in node.waiting:
            yield (None, None, *child[:2], node.least, *child[2:])
        node.leaves += node.children == 0
        node.saved += (node.convs - 1) * node.text_bytes
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        own = (node.least, node.depth, node.convs, node.children, node.leaves, node.saved, ends or NO_MEMBER)
        if above.skeleton >= 0:
            yield (None, above.skeleton, *own[:2], None, *own[2:])
        else:
            above.waiting.append(own)

    for path, least, convs, ids in rows:
        if path != last:
            if last is None:
                stack.append(_Node(0, 0, 0))
            keep = _common(last or b"", path)
            while len(stack) > keep + 1:
                yield from close()
            for at in range(keep * TOKEN, len(path), TOKEN):
                token = path[at : at + TOKEN]
                known = skeleton.child.get((stack[-1].skeleton, token), -1) if stack[-1].skeleton >= 0 else -1
                stack.append(_Node(at // TOKEN + 1, int.from_bytes(token[DIGEST:], "big"), known))
            last = path
        top = stack[-1]
        if top.ends is None:
            top.ends = hashlib.sha256(ids.encode())
        else:
            top.ends.update(b"," + ids.encode())
        top.convs += convs
        top.least = least if top.least is None else min(top.least, least)
    while stack:
        yield from close()


def _batched(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ROW)], schema=ROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), ROW)], schema=ROW)


def _finish(spark: SparkSession, nodes: DataFrame, skeleton: Skeleton) -> DataFrame:
    parts = nodes.filter("skeleton is not null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends_sha256").alias("ends_sha256")
    )
    top = spark.createDataFrame(skeleton.totals(parts.collect()), NODE)  # one row a node of the skeleton
    parents = top.select(F.col("skeleton").alias("below"), F.col("conv_id").alias("_above"))
    rest = nodes.filter("skeleton is null").join(F.broadcast(parents), "below", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    columns = [name for name in ROW.names if name not in ("skeleton", "below")]
    return rest.select(*columns).unionByName(top.select(*columns))


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path), each conversation once.

    Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, over the members whose path ends there."""
    spark = paths.sparkSession
    bucket = F.shiftright("conv_id", CHUNK_BITS).alias("bucket")
    chunks = paths.groupBy("path", bucket).agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    chunks = written(chunks.select("path", "bucket", F.col("_ids")[0].alias("least"), F.size("_ids").alias("convs"), F.array_join(F.col("_ids").cast("array<string>"), ",").alias("ids")), "trie-paths")
    skeleton = Skeleton(splitters_of(chunks, shards or partitions(spark)))
    shared = spark.sparkContext.broadcast(skeleton)

    @F.pandas_udf(T.IntegerType())
    def shard(paths: pd.Series) -> pd.Series:
        splitters = shared.value.splitters
        return pd.Series([bisect_right(splitters, bytes(path)) for path in paths], dtype="int32")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(name).to_pylist() for name in ("path", "least", "convs", "ids"))))
        return _batched(nodes_of_shard(rows, shared.value))

    dealt = chunks.withColumn("_shard", shard("path")).repartition("_shard").sortWithinPartitions("path", "bucket")
    nodes = written(dealt.select("path", "least", "convs", "ids").mapInArrow(build, NODE), "trie-nodes")
    return _finish(spark, nodes, skeleton)
