import hashlib
import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions import privacy, scalars, wire


def one(spark, **columns):
    return spark.range(1).select(*[column.alias(name) for name, column in columns.items()]).first()


def test_masks(spark):
    row = one(
        spark,
        name=privacy.mask_name(F.lit("Ava")),
        email=privacy.mask_email(F.lit("ava.parker.1@example.com")),
        hidden=privacy.mask_email(F.lit("no-at-sign")),
        phone=privacy.mask_phone(F.lit("555-101-0001")),
        zip=privacy.mask_zip_code(F.lit("10001")),
        missing=privacy.mask_email(F.lit(None).cast("string")),
    )
    assert row.asDict() == {
        "name": "A***",
        "email": "a***@example.com",
        "hidden": "***",
        "phone": "***-***-0001",
        "zip": "10***",
        "missing": None,
    }


def test_token_is_salted_sha256_and_keeps_null(spark):
    row = one(spark, t=privacy.token(F.lit(42), "s"), n=privacy.token(F.lit(None).cast("bigint"), "s"))
    assert row.t == hashlib.sha256(b"s::42").hexdigest() and row.n is None


def test_division_and_ratios(spark):
    row = one(
        spark,
        zero=scalars.safe_divide(F.lit(1), F.lit(0)),
        null=scalars.safe_divide(F.lit(1), F.lit(None).cast("int")),
        half=scalars.safe_divide(F.lit(1), F.lit(2)),
        clamped=scalars.clamped_ratio(F.lit(9), F.lit(3)),
        ctr=scalars.ctr(F.lit(9), F.lit(3)),
        no_ctr=scalars.ctr(F.lit(9), F.lit(0)),
    )
    assert tuple(row) == (0.0, 0.0, 0.5, 1.0, 3.0, 0.0)


def test_parsing(spark):
    row = one(
        spark,
        d=scalars.parse_iso_date(F.lit("2026-01-03T10:30:00Z")),
        only=scalars.parse_iso_date(F.lit("2026-01-03")),
        bad=scalars.parse_iso_date(F.lit("soon")),
        ts=scalars.parse_iso_timestamp(F.lit("2026-01-03T10:30:00Z")),
        number=scalars.as_double(F.lit("")),
        whole=scalars.as_long(F.lit("7.9")),
        default=scalars.as_long(F.lit("x"), 3),
        before=scalars.seconds_before(F.lit(datetime(2026, 1, 1)), 3600),
    )
    assert row.d == row.only == date(2026, 1, 3) and row.bad is None and row.ts == datetime(2026, 1, 3, 10, 30)
    assert (row.number, row.whole, row.default) == (0.0, 7, 3) and row.before == datetime(2025, 12, 31, 23)


def test_key_decoding(spark):
    keys = [b'{"customer_id":5}', b'{"payload":{"customer_id":6}}', b'{"a":1,"b":2}', b"plain", b"\xff\xfe", None]
    rows = spark.createDataFrame([(key,) for key in map(lambda k: bytearray(k) if k else None, keys)], "key binary")
    got = [row[0] for row in rows.select(wire.decode_key("key")).collect()]
    assert got[0] == "5" and got[1] == "6" and json.loads(got[2]) == {"a": 1, "b": 2}
    assert got[3] == "plain" and got[4] == "//4=" and got[5] is None


def test_header_round_trip(spark):
    framed = wire.frame(258, F.lit("body").cast("binary"))
    row = one(spark, magic=wire.magic_byte(framed), number=wire.schema_id(framed), body=wire.body(framed).cast("string"))
    assert tuple(row) == (0, 258, "body")


def test_keys_and_ids(spark):
    row = one(
        spark,
        dlq=wire.dead_letter_key("t", F.lit(1), F.lit(2)),
        key=wire.pattern_key("features:customer:{customer_id}:v1", "customer_id", F.lit(9)),
        a=wire.source_event_id("t", F.lit(1), F.lit(2)),
        b=wire.source_event_id("t", F.lit(1), F.lit(3)),
    )
    assert row.dlq == "t-1-2" and row.key == "features:customer:9:v1" and row.a != row.b and len(row.a) == 36
