import hashlib
import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.bpe import BpeCodec, TextDecoder, Transducer, decode_column, encode_and_decode, encode_column, sufficient_lookahead, token_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  ", "\n", "<|endoftext|>x<|startoftext|>", "<|endoftext", "don't I'LL we've o'neil''s", "ΑΣ ΣΑΣ", "İstanbul ﬁ", "é ́x",
    "a b c\x85d\x1ce\x0bf", "naïve 12345 ٣٤", "日本語テキスト😀👩‍👩‍👧", "\x00\x01", "՘⃁", "ab" * 5000,
    "\u1c89x \ua7dc", "a\u0897b", "\U00010d50\U0001e5d0 x", "\u1c8a\u0301 ÀÇ!? ß$$$ µª º× ÷ÿ", "thetheirthereof" * 700, "!?." * 900,
]


@pytest.fixture(scope="module")
def codec():
    return BpeCodec(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def random_texts():
    rng = random.Random(3)
    letters = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 4000))) for _ in range(20)]
    mixed = ["".join(rng.choice("abcdeth rin'é.,!AB\n") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    return letters + mixed


def test_ids_equal_the_library(codec, library):
    texts = ODD + random_texts()
    for text, data in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == ids_of(library, text), text


def test_ids_equal_the_library_on_all_sample_documents(codec, library, spark, sample_folder):
    texts = [row.text for row in spark.read.parquet(f"{sample_folder}/documents.parquet").select("text").collect()]
    for text, data in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(data, "<u4").tolist() == ids_of(library, text)


def test_transducer_window_is_bounded_and_emits_early(codec, library):
    word = "".join(random.Random(5).choice("etaoinsh") for _ in range(9000)).encode()
    machine, out, widest = Transducer(codec.merges), [], 0
    for byte in word[:-1]:
        out += machine.push([int(codec.merges.inner[byte])])
        widest = max(widest, len(machine.window))
    assert widest <= machine.full and len(out) > 1000
    out += machine.finish(int(codec.merges.final[word[-1]]))
    assert out == ids_of(library, word.decode())


def test_lookahead_holds_for_every_continuation(codec):
    """Tokens behind the lookahead stay the same whatever follows."""
    rng, merges = random.Random(7), codec.merges
    sizes = token_lengths(merges)
    for _ in range(20):
        start = [int(merges.inner[ord(rng.choice("etaoinshr"))]) for _ in range(merges.lookahead + 60)]
        settled, used = [], 0
        for token in merges.merged(start):
            used += sizes[token]
            if used > len(start) - merges.lookahead:
                break
            settled.append(token)
        for _ in range(4):
            more = [int(merges.inner[ord(rng.choice("etaoinshr"))]) for _ in range(rng.randint(1, 30))]
            assert merges.merged(start + more)[: len(settled)] == settled


def test_lookahead_of_small_lists():
    assert sufficient_lookahead([(0, 1, 2)], [0, 1]) == 2
    # bc before ab: whether a takes b depends on the symbol behind b.
    assert sufficient_lookahead([(1, 2, 3), (0, 1, 4)], [0, 1, 2]) == 2


def test_lockstep_equals_the_heap(codec):
    rng, merges = random.Random(9), codec.merges
    for length in (1, 2, 3, 7, 40):
        words = np.array([[rng.choice(b"etaoinshr") for _ in range(length)] for _ in range(50)], np.uint8).T
        symbols = merges.inner[words]
        tokens, sizes = merges.merged_in_lockstep(symbols)
        for k in range(50):
            assert tokens[: sizes[k], k].tolist() == merges.merged(symbols[:, k].tolist())


def test_decoder_state_machine_keeps_characters_whole():
    whole = "aé日😀".encode()
    pieces = [whole[k : k + 1] for k in range(len(whole))] + [b"\xff"]
    machine = TextDecoder(pieces, joiner=b"")
    shown = [machine.push([k]) for k in range(len(whole))]
    assert "".join(shown) + machine.finish() == "aé日😀" and shown[1] == "" and shown[2] == "é"
    machine = TextDecoder(pieces, joiner=b"")
    assert machine.push([1]) + machine.push([len(whole)]) + machine.finish() == "��"
    assert machine.push([1]) + machine.finish() == "�"


def test_query_on_odd_rows(spark, library):
    rows = [(k, text, "x") for k, text in enumerate(ODD)] + [(None, "null id", "x"), (3, "again", "y"), (3, "again", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted(map(tuple, encode_and_decode(df, PATH).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids = ids_of(library, text)
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = df.withColumn("decoded", decode_column(encode_column(F.col("text"), PATH), PATH))
    assert all(row.decoded == library.decode(ids_of(library, row.text), skip_special_tokens=False) for row in back.collect())


def test_a_task_leaves_no_words_behind(library):
    """What a worker remembers is bounded while it encodes, and gone when its task ends, also early."""
    texts = [*ODD, *random_texts(), *(f"word{k} Wört{k}" for k in range(3000))]
    coder, most = BpeCodec(PATH, 50_000, 50_000), 0
    expected = [len(ids_of(library, text)) for text in texts]
    for count in (len(texts), 2):
        held = bpe._digested((pd.Series(texts[k : k + 50], dtype=object) for k in range(0, len(texts), 50)), coder)
        got = []
        for frame in held:
            got += frame["n_tokens"].tolist()
            most = max(most, coder._parts.bytes)
            if len(got) >= count:
                break
        held.close()
        assert got == expected[: len(got)] and len(got) >= count
        assert not coder._parts.known and not coder._encoder.cache.known and coder._parts.bytes == 0
    assert 0 < most < 400_000  # the bound and the new parts of one batch, of over a million in all


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_and_decode(df, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert encode_and_decode(df, PATH).count() == 0
