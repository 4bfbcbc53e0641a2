import random
import re

import numpy as np
import pytest

from tidemark.llm import near_dedup
from tidemark.llm.components import components
from tidemark.llm.near_dedup import _crossing_links, near_groups, one_of_each, shingle_sets

LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, width):
    return [row[:3] for row in grouped(rows, width)]


def grouped(rows, width):
    """Component of each row by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    members = {}
    for k, (doc_id, _) in enumerate(rows):
        members.setdefault(find(k), []).append(doc_id)
    least = {k: min(own, key=lambda i: (i is not None, i or 0)) for k, own in members.items()}
    return [(doc_id, len(sets[k]), least[find(k)], find(k)) for k, (doc_id, _) in enumerate(rows)]


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = [None, "", " \n", "one", "One", "one two", "a b c", "A  b\tc", "a b c d", "É b c d e f", "é b c d e f"]
    passage = [word() for _ in range(60)]
    for _ in range(25):  # near copies at all distances around the threshold, and chains of them
        own = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(own))
            own = list(own)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = word()
    for _ in range(40):  # different texts around one passage
        texts.append(" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]))
    texts += ["copy of one text with quite a few words in it"] * 50
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, "again again again again"), (3, "again again again again"), (None, "no id at all here"), (None, "no id at all here")]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string").repartition(3)
    for width in (4, 5):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_groups(df, width=width).collect()), key=str)
        assert got == sorted(brute(rows, width), key=str)


def test_one_row_of_each_group_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node int").repartition(3)
    stay = one_of_each(df)
    assert stay.columns == df.columns
    assert stay.count() == len({root for *_, root in grouped(rows, 5)})


@pytest.mark.parametrize("split", [8192, 100])
def test_links_across_blocks_of_a_large_group(spark, monkeypatch, split):
    """Members of one group in many blocks: each link across components is found once."""
    monkeypatch.setattr(near_dedup, "SPLIT", split)
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.integers(0, 2**63, 90, dtype=np.uint64) * np.uint64(2)) for _ in range(150)]
    sets[7] = np.sort(np.concatenate([sets[3][:85], sets[7][:5]]))
    sets[140] = np.sort(np.concatenate([sets[20][:88], sets[140][:2]]))
    bands = [[5] * 16 + [9] * 16 for _ in sets]
    nodes = spark.createDataFrame([(k, b) for k, b in enumerate(bands)], "node long, bands array<long>")
    packed = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "node long, shingles binary")
    live = spark.createDataFrame([(k, i, 5, i, 150) for k in range(150) for i in range(16)], "node long, _band int, _value long, _key long, _members long")
    parts = spark.createDataFrame([], "node long, component long")
    got = [(r.a, r.b) for r in _crossing_links(live, nodes, packed, parts, 150 * 16).collect()]
    assert sorted(set(got)) == [(7, 3), (140, 20)]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(1, k) for k in range(2, 90)]
    got = dict(components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 90)}


def test_sets_do_not_depend_on_the_batch():
    texts = [t for _, t in corpus()]
    together = [s.tolist() for s in shingle_sets(texts, 5)]
    assert together == [next(shingle_sets([t], 5)).tolist() for t in texts]


def test_empty_and_blank_tables(spark):
    for rows in ([], [(1, None), (2, " ")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert near_groups(df).count() == len(rows) and one_of_each(df).count() == len(rows)
