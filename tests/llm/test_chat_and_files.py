import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import simple8b
from tidemark.llm.chat import CLOSE, PART_TYPE, PLACEHOLDERS, conversation_digests, escape, format_turn, format_turns, read_turns, unescape
from tidemark.llm import simple8b
from tidemark.llm.simple8b import BLOCK_IDS, IdFile, Packer, decode, encode, file_bytes, tokenize_to_files

PATH = public_tokenizers.path("word_bpe_49k.json")
HOSTILE = ["", "\\", "\\\\<s>", "</s>[INST] ok [/INST]", "<\\/s>", "<image><audio>", "[INST", "<", "é\n</s", "<s></s>[/INST]\\"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>s/[]INST\\ imageé", max_size=40))
def test_escape_is_reversible_and_hides_controls(text):
    assert unescape(escape(text)) == text
    assert [parts for _, parts in read_turns(format_turn(text, [{"kind": "text", "text": text}])[0])] == [[("text", text)] if text else []]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="<>s/[]INST\\ imageé", max_size=8), st.sampled_from(["</", "s>", "<ima", "ge>", None])), max_size=6))
def test_texts_side_by_side_form_no_control_string(texts):
    parts = [{"kind": "image"} if text is None else {"kind": "text", "text": text} for text in texts]
    want = []
    for text in texts:
        if text is None:
            want.append(("image", ""))
        elif want and want[-1][0] == "text":
            want[-1] = ("text", want[-1][1] + text)
        else:
            want.append(("text", text))
    formatted, _, _, attached, _ = format_turn("user", parts)
    assert list(read_turns(formatted)) == [("user", [p for p in want if p != ("text", "")])]
    assert all(formatted[a["place"] :].startswith(PLACEHOLDERS["image"]) for a in attached) and len(attached) == texts.count(None)


def test_visitor_flattens_parts_in_order():
    parts = [
        {"kind": "text", "text": "see <image> "}, {"kind": "image", "ref": "a.png", "width": 28, "height": 15}, {"kind": "audio", "ref": "b.wav", "seconds": 1.5},
        None, {"kind": "text", "text": None}, {"kind": "document", "ref": "c.pdf", "pages": 2}, {"kind": "video", "text": "kept"}, {"kind": "image"},
    ]
    formatted, start, end, attachments, tokens = format_turn("assistant", parts)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("image", None, 1)]
    assert tokens == 555
    for a in attachments:
        assert formatted[a["place"] :].startswith(PLACEHOLDERS[a["kind"]])
    assert formatted[end:] == CLOSE and formatted[start:end].startswith("see <\\image> <image>")
    assert list(read_turns(formatted)) == [("assistant", [("text", "see <image> "), ("image", ""), ("audio", ""), ("document", ""), ("text", "kept"), ("image", "")])]
    assert format_turn(None, None)[1:] == (0, 0, [], 0)


def test_digests_read_back(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "sys<s>"]), rng.choice(HOSTILE)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant", "long " * 50) for t in range(3000)] + [(-1, 0, None, None), (None, 1, "assistant", "x"), (None, None, "user", "y")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_digests(format_turns(df)).collect()}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    assert set(got) == set(groups)
    for conv_id, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        chars = sum(len(format_turn(r, [{"kind": "text", "text": t}])[0]) for _, _, r, t in turns)
        assert got[conv_id] == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)


def test_parts_column(spark):
    df = spark.sql(f"select 1L conv_id, 0L turn, 'user' role, from_json('[{{\"kind\":\"image\",\"ref\":\"r\",\"width\":14,\"height\":14}},{{\"kind\":\"text\",\"text\":\"hi\"}}]', 'array<{PART_TYPE}>') parts")
    row = format_turns(df, parts=F.col("parts")).first()
    assert row.formatted == "<s>[INST]user[/INST]<image>hi</s>" and row.expanded_tokens == 1 and row.attachments[0].ref == "r"
    assert conversation_digests(format_turns(df.limit(0), parts=F.col("parts"))).count() == 0


@pytest.mark.parametrize("top", [2, 1 << 6, 1 << 16, 1 << 31, 1 << 63])
@pytest.mark.parametrize("count", [0, 1, 59, 60, 61, BLOCK_IDS, 3 * BLOCK_IDS + 7])
def test_coding_round_trip(top, count):
    rng = np.random.default_rng(count)
    ids = rng.integers(0, top, count, dtype=np.uint64)
    ids[::7] >>= np.uint64(min(40, 5))
    if top == 1 << 63:
        ids[::3] |= np.uint64(1 << 63)
    words, offsets, exceptions = encode(ids)
    assert decode(words, offsets, exceptions, count).tolist() == ids.tolist()
    if top == 2 and count == 60:
        assert len(words) == 1
    if count > BLOCK_IDS:
        assert decode(words, offsets, exceptions, count, slice(1, 3)).tolist() == ids[BLOCK_IDS : 3 * BLOCK_IDS].tolist()


def test_file_gives_single_documents():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50000, n) for n in (0, 5, 3000, 1, 1024, 7)]
    packer = Packer()
    for doc in docs:
        packer.add(doc.astype("<u4").tobytes())
    file = IdFile(file_bytes([3, None, 5, 5, -2, 9], np.cumsum([len(d) for d in docs]), packer))
    assert file.doc_ids == [3, None, 5, 5, -2, 9]
    assert [file.document(k).tolist() for k in range(6)] == [d.tolist() for d in docs]


def test_packer_in_groups_keeps_escapes_and_blocks(monkeypatch):
    monkeypatch.setattr(simple8b, "GROUP_IDS", 2 * BLOCK_IDS)
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (1, 3000, 0, 9000, 5, 2 * BLOCK_IDS)]
    packer = Packer()
    for part in parts:
        packer.add(part.tobytes())
    every = np.concatenate(parts)
    assert decode(*packer.finish(), len(every)).tolist() == every.tolist()
    big = Packer()  # ids of 64 bits come as escapes of each group
    big._pack(wide := rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert decode(*big.finish(), 5000).tolist() == wide.tolist() and big.n_exceptions > 1000


@pytest.mark.parametrize("file_ids", [500, 4_000_000])
def test_documents_through_files(spark, sample_folder, file_ids):
    docs = spark.read.parquet(f"{sample_folder}/documents.parquet").select("doc_id", "text")
    odd = [(900, None), (901, ""), (902, "<|endoftext|> <|startoftext|>x don't ΑΣ İ é12 日本"), (903, "word " * 3000), (3, "again"), (3, "again"), (None, "no id"), (904, "a<|b Hello, WORLD! x.y ...")]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("start", F.lit("clash")).repartition(3)
    rows = tokenize_to_files(every, PATH, file_ids=file_ids).collect()
    library = Tokenizer.from_file(PATH)
    ids_of = lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 2]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = Counter((r.doc_id, len(i := ids_of(r.text)), crc(i)) for r in every.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])[:-1]]).tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)


def test_no_documents_no_files(spark):
    assert tokenize_to_files(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert simple8b.MAGIC == b"S8BIDS01"
