import hashlib
import random
import re

import pytest

from tidemark.llm.bytewise import Batch
from tidemark.llm.decontamination import contamination

LOWER = {k: k + 32 for k in range(65, 91)}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text, *_ in items:
        own = words_of(text)
        width = min(10, len(own))
        for k in range(len(own) - width + 1 if own else 0):
            windows.setdefault(tuple(own[k : k + width]), set()).add(item)
    widths = {len(w) for w in windows}
    out = []
    for doc, text, *_ in docs:
        own, hit, met = words_of(text), set(), set()
        for width in widths:
            for k in range(len(own) - width + 1):
                if (found := windows.get(tuple(own[k : k + width]))) is not None:
                    hit.update(range(k, k + width))
                    met |= found
        ids = sorted(str(i) for i in met if i is not None)
        out.append((doc, len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def judged(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit int, text_key string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string, window int").repartition(2)
    columns = "doc_id n_words n_hit n_items items_sha256 contaminated".split()
    return sorted((tuple(r[c] for c in columns) for r in contamination(df, bench, **options).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    # Few words, so that runs of five words meet by chance and windows do not.
    word = lambda: rng.choice("aa b cc d ee f9 é über x".split())
    items = [(k, " ".join(word() for _ in range(rng.randint(8, 40)))) for k in range(12)]
    items += [(100, items[0][1]), (100, items[1][1]), (None, " ".join(word() for _ in range(15))), (13, None), (14, "..."), (15, "Zebra crossing"), (16, "loner")]
    docs = [None, "", "?!", "zebra-CROSSING zebra", "loners", "A loner!"]
    for _ in range(60):
        own = [word() for _ in range(rng.randint(1, 80))]
        for _ in range(rng.randint(0, 3)):
            given = words_of(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(given) - 1))
            at = rng.randint(0, len(own))
            own[at:at] = given[a : a + rng.randint(6, 25)]
        docs.append(rng.choice([" ", "\n", ", "]).join(own).replace("x", "X"))
    docs += [docs[10]] * 30 + [" ".join([word() for _ in range(30_000)] + words_of(items[3][1]))]
    return [(k, t, 1, "x") for k, t in enumerate(docs)] + [(3, docs[20], 1, "x"), (None, docs[21], 1, "x")], [(i, t, 0) for i, t in items]


@pytest.mark.parametrize("benchmark_words", [1_000_000, 0])
def test_hits_equal_brute_force(spark, benchmark_words):
    docs, items = corpus(3)
    want = brute(docs, items)
    assert 30 < sum(row[-1] for row in want) < len(docs) - 10
    assert judged(spark, docs, items, benchmark_words=benchmark_words) == want


@pytest.mark.parametrize("benchmark_words", [1_000_000, 0])
def test_empty_tables(spark, benchmark_words):
    docs, items = corpus(4)
    assert judged(spark, [], items, benchmark_words=benchmark_words) == []
    assert judged(spark, docs[:9], [], benchmark_words=benchmark_words) == brute(docs[:9], [])


def test_word_hashes_tell_words_apart():
    """Words of all lengths, and the pair on which polynomial hashes modulo 2^64 always collide."""
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [thue, thue.translate(str.maketrans("ab", "ba")), *("a" * k for k in range(1, 40)), *("b" * k + "a" for k in range(40)), "\x00", "\x00\x00"]
    batch = Batch([t.encode() for t in texts], lower=False)
    assert len(set(batch.word_hashes().tolist())) == len(set(texts))
    again = Batch([b" ".join(t.encode() for t in texts)], lower=False)
    assert again.word_hashes().tolist() == batch.word_hashes().tolist()
