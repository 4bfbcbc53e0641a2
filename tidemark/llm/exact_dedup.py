"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Method.  A normalised text is cut into blocks of a fixed number of characters.  The distinct blocks
are sorted and numbered, so a block's integer name stands for its whole content.  Adjacent names
are paired, the distinct pairs sorted and numbered again, and so on: each round halves a document
until one name is left.  Two texts are equal exactly if they have as many blocks and the same last
name; no step takes equality of a hash for equality of text.

Blocks travel once: with a 64-bit key in front, copies merging inside the map tasks, to count the
distinct texts under each key; nearly always there is one.  Names are the places in the sorted
table of (key, place of the text under its key).  Occurrences look their name up by the key alone;
those whose key has several texts, if any, go back for their text.

Edge cases: null counts as empty, and empty texts form one group; repeated rows count as members;
rows without a doc_id are kept as rows and sort first; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import as_rows, inside, lookup, numbered_ranges, written

# Fixed value: the characters deleted before texts are compared.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Characters in a block.
BLOCK_CHARS = 4096


def without_white_space(text: Column) -> Column:
    """The text, null as empty, without the six ASCII white-space characters."""
    text = F.coalesce(text, F.lit(""))
    for character in WHITE_SPACE:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def blocks_of(text: Column, size: int) -> Column:
    """The text cut into blocks in one pass; an empty text is one empty block."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def block_key(block: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(block), 64 - bits)


def exact_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_chars: int = BLOCK_CHARS, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_chars, text_sha256, and the identity (blocks, name) of its text.

    ``key_bits`` below 64 makes keys collide, to test that names stay free of collisions."""
    text = F.col(f"`{text_column}`")
    normal = without_white_space(text)
    source = df.select(F.col(f"`{id_column}`").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), normal.alias("_normal"), F.xxhash64(text).alias("_content"))
    cut = source.withColumn("_blocks", blocks_of(F.col("_normal"), block_chars))

    # One row of keys per document; the text itself stays behind.
    keyed = written(
        cut.select(
            "doc_id",
            "n_chars",
            "_content",
            F.sha2("_normal", 256).alias("text_sha256"),
            F.transform("_blocks", lambda b: block_key(b, key_bits)).alias("_keys"),
        ).withColumn("_row_id", F.monotonically_increasing_id()),
        "block-keys",
    )
    blocks = cut.select(F.explode("_blocks").alias("_block")).select(block_key(F.col("_block"), key_bits).alias("_key"), "_block")
    counts = written(blocks.distinct().groupBy("_key").agg(F.count("*").cast("int").alias("_count")), "block-counts")
    names = numbered_ranges(counts.withColumn("_place", F.explode(F.sequence(F.lit(1), F.col("_count")))), "_key", "_place", purpose="block-names")
    names = names.select("_key", "_place", "_count", as_name().alias("_name"))

    occurrences = keyed.select("_row_id", F.posexplode("_keys").alias("_at", "_key"))
    sizes = keyed.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count("*").alias("_times"))
    sizes = written(sizes, "block-times")
    total = sizes.agg(F.sum("_times")).first()[0] or 0
    single = names.filter("_count = 1").select("_key", "_name").join(sizes, "_key")
    named = lookup(occurrences, single, "_key", "_times", total, F.col("_row_id")).select("_row_id", "_at", "_name")
    if not counts.filter("_count > 1").isEmpty():
        named = named.unionByName(_named_by_text(df, text_column, block_chars, key_bits, keyed, blocks, names))
    last = _folded(written(named, "block-occurrences"))
    return keyed.withColumn("_blocks", F.size("_keys")).join(last, "_row_id").select("doc_id", "n_chars", "_content", "text_sha256", "_row_id", "_blocks", "_name")


def as_name() -> Column:
    """The place in a sorted table as one integer that keeps the order."""
    return F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_row")


def _named_by_text(df: DataFrame, text_column: str, block_chars: int, key_bits: int, keyed: DataFrame, blocks: DataFrame, names: DataFrame) -> DataFrame:
    """Names of the occurrences whose key several texts share, found by the text itself."""
    several = names.filter("_count > 1").select("_key", "_place", "_name")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_block")).alias("_place")
    texts = blocks.join(several.select("_key").distinct(), "_key", "left_semi").distinct().select("_key", "_block", place).join(several, ["_key", "_place"])
    rows = df.select(without_white_space(F.col(f"`{text_column}`")).alias("_normal")).distinct()
    own = rows.select(F.sha2("_normal", 256).alias("text_sha256"), F.posexplode(blocks_of(F.col("_normal"), block_chars)).alias("_at", "_block"))
    own = own.withColumn("_key", block_key(F.col("_block"), key_bits)).join(texts, ["_key", "_block"]).select("text_sha256", "_at", "_key", "_name")
    wanted = keyed.select("_row_id", "text_sha256", F.posexplode("_keys").alias("_at", "_key"))
    return wanted.join(own, ["text_sha256", "_at", "_key"]).select("_row_id", "_at", "_name")


def _folded(named: DataFrame) -> DataFrame:
    """One name per row: adjacent names are paired and renamed until a row has one left."""
    finished = None
    level = named
    widest = level.agg(F.max("_at")).first()[0]
    while widest:
        # A row whose only name is its first is done; the others go on.
        ends = level.groupBy("_row_id").agg(F.max("_at").alias("_end"))
        level = level.join(ends, "_row_id")
        done = level.filter("_end = 0").select("_row_id", "_name")
        finished = done if finished is None else finished.unionByName(done)
        halves = (
            level.filter("_end > 0")
            .groupBy("_row_id", F.floor(F.col("_at") / 2).alias("_at"))
            .agg(F.max(F.when(F.col("_at") % 2 == 0, F.col("_name"))).alias("_left"), F.max(F.when(F.col("_at") % 2 == 1, F.col("_name"))).alias("_right"))
        )
        # No right neighbour: a name of its own, below all others.
        pairs = written(halves.withColumn("_right", F.coalesce("_right", F.lit(-1))), "pairs")
        times = pairs.groupBy("_left", "_right").agg(F.count("*").alias("_times"))
        names = numbered_ranges(times, "_left", "_right", purpose="pair-names")
        names = names.select(F.struct("_left", "_right").alias("_pair"), "_times", as_name().alias("_name"))
        total = names.agg(F.sum("_times")).first()[0] or 0
        occurrences = pairs.select("_row_id", "_at", F.struct("_left", "_right").alias("_pair"))
        level = written(lookup(occurrences, names, "_pair", "_times", total, F.col("_row_id")).select("_row_id", "_at", "_name"), "pair-occurrences")
        widest = level.agg(F.max("_at")).first()[0]
    done = level.filter("_at = 0").select("_row_id", "_name")
    return done if finished is None else finished.unionByName(done)


def exact_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_chars: int = BLOCK_CHARS, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most characters before normalisation, then the smallest
    doc_id stays; of rows alike in both, the first by a hash of the original text."""
    rows = written(exact_groups(df, id_column, text_column, block_chars, key_bits), "identities")
    rows = rows.withColumn("_identity", F.struct("_blocks", "_name"))
    best = F.min(F.struct((-F.col("n_chars")).alias("_chars"), F.col("doc_id").alias("keep_id"), "_content", F.col("_row_id").alias("_keep_row")))
    groups = written(rows.groupBy("_identity").agg(best.alias("_best"), F.count("*").alias("group_size")), "groups")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    joined = lookup(rows, groups, "_identity", "group_size", total, F.col("_row_id"))
    return joined.select("doc_id", F.col("_best.keep_id").alias("keep_id"), "group_size", (F.col("_row_id") == F.col("_best._keep_row")).alias("kept"), "text_sha256")


def without_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    rows = written(exact_dedup(df, id_column, text_column), "copies")
    kept = rows.filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_text"))
    text = inside(text_column)
    keyed = as_rows(df).withColumns({"_id": inside(id_column), "_text": F.sha2(without_white_space(text), 256), "_chars": F.coalesce(F.length(text), F.lit(0))})
    stay = keyed.join(kept, keyed["_id"].eqNullSafe(kept["_kept_id"]) & (keyed["_text"] == kept["_kept_text"]), "left_semi")
    if not rows.groupBy("doc_id", "text_sha256").count().filter("count > 1").isEmpty():
        # One id and text in several rows: the longest of them, then the first by content.
        order = [F.col("_chars").desc(), *[inside(c).cast("string") for c in df.columns]]
        stay = stay.withColumn("_rank", F.row_number().over(Window.partitionBy("_id", "_text").orderBy(*order))).filter("_rank = 1")
    return stay.select("row.*")
