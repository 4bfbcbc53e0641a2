"""Wire formats: framed binary headers, JSON bodies, message keys (SCA17-SCA20)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import ColumnLike, as_column

HEADER_BYTES = 5


def magic_byte(payload: ColumnLike) -> Column:
    return F.conv(F.hex(F.substring(as_column(payload), 1, 1)), 16, 10).cast("int")


def schema_id(payload: ColumnLike) -> Column:
    """Big-endian four-byte schema id behind the magic byte (SCA18)."""
    return F.conv(F.hex(F.substring(as_column(payload), 2, 4)), 16, 10).cast("bigint")


def body(payload: ColumnLike) -> Column:
    """The bytes behind the header."""
    return F.substr(as_column(payload), F.lit(HEADER_BYTES + 1))


def frame(schema: int, content: Column) -> Column:
    """Header plus content, the inverse of the three readers above."""
    return F.concat(F.unhex(F.lit(f"00{schema:08X}")), content)


def json_struct(text: ColumnLike, schema: T.StructType) -> Column:
    """One typed parse of a JSON text instead of a path lookup per field (SCA17)."""
    return F.from_json(as_column(text), schema, {"mode": "PERMISSIVE"})


def dead_letter_key(topic: str, partition: ColumnLike, offset: ColumnLike) -> Column:
    """``topic-partition-offset`` (SCA19)."""
    return F.concat_ws("-", F.lit(topic), as_column(partition).cast("string"), as_column(offset).cast("string"))


def pattern_key(pattern: str, name: str, value: ColumnLike) -> Column:
    """Fill ``{name}`` of a key pattern such as ``features:customer:{customer_id}:v1`` (SCA19)."""
    before, _, after = pattern.partition("{" + name + "}")
    return F.concat(F.lit(before), as_column(value).cast("string"), F.lit(after))


def source_event_id(source: str, partition: ColumnLike, offset: ColumnLike) -> Column:
    """Deterministic id of a log position, shaped like a UUID (SCA20)."""
    position = F.concat_ws(":", F.lit(source), as_column(partition).cast("string"), as_column(offset).cast("string"))
    digest = F.sha2(position, 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def decode_key(key: ColumnLike) -> Column:
    """Readable record key (SRC6).

    UTF-8 JSON: the ``payload`` object if there is one; an object with a single
    field gives that field's value, any other object its JSON text.  Plain UTF-8
    stays as it is, other bytes become base64.
    """
    raw = as_column(key)
    text = F.try_validate_utf8(raw.cast("string"))
    inner = F.coalesce(F.get_json_object(text, "$.payload"), text)
    fields = F.json_object_keys(inner)
    single = F.map_values(F.from_json(inner, T.MapType(T.StringType(), T.StringType())))[0]
    readable = F.when(F.size(fields) == 1, single).otherwise(inner)
    return F.when(raw.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(readable, F.base64(raw)))
