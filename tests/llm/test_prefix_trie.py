import hashlib
import random
import zlib

import pytest

from tidemark.llm.prefix_trie import prefix_trie, rebuilt_paths

SCHEMA = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    return out


def brute(rows):
    paths = {conv: tuple(turns) for conv, turns in rebuilt(rows).items()}
    nodes = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(conv)
    saved = {q: (len(m) - 1) * (len(q[-1][1].encode()) if q else 0) for q, m in nodes.items()}
    children = {}
    for q in nodes:
        if q:
            children.setdefault(q[:-1], []).append(q)
    out = []

    def subtree(q):
        rest = [q]
        while rest:
            rest += children.get(top := rest.pop(), [])
            yield top

    for q, members in nodes.items():
        below = list(subtree(q))
        ends = sha(",".join(map(str, sorted(c for c in members if len(paths[c]) == len(q)))))
        parent = min(nodes[q[:-1]]) if q else None
        out.append((min(members), len(q), parent, len(members), len(children.get(q, [])), sum(p not in children for p in below), sum(saved[p] for p in below), ends))
    return sorted(out, key=str)


def trie(spark, rows, shards=None, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3)
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[c] for c in columns) for r in prefix_trie(rebuilt_paths(df), shards).collect()), key=str)


def talks(seed, count=160):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        if rng.random() < 0.1:
            continue  # some families have no first conversation
        like = rng.choice([conv, 7, 7])  # one conversation that a large part repeats
        own = random.Random(like)
        length = own.randint(1, 12)
        for turn in range(length):
            rows.append((conv, turn, own.choice(["user", "assistant"]), own.choice(["ja", "é", "", "a longer text"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_trie_equals_brute_force(spark, shards):
    rows = talks(shards)
    assert trie(spark, rows, shards) == brute(rows)


def test_nulls_ties_copies_and_more_columns(spark):
    rows = [(None, 1, "user", "x"), (5, None, None, None), (5, 0, "user", None), (5, 1, None, "é" * 3000), (6, 0, "user", "a"), (7, 3, "b", "c"), (1000, 0, "u", "t")]
    assert trie(spark, rows) == brute(rows)
    more = [(*row, 1, "x") for row in rows]
    assert trie(spark, more, schema=SCHEMA + ", path int, bucket string") == brute(rows)
    same = [(c, 0, "user", "same") for c in range(700)]
    assert trie(spark, same, 5) == brute(same)
    # Rows of one turn have one order, however they come.
    tied = [(3, 0, "user", t) for t in "abcd"]
    assert trie(spark, tied) == trie(spark, tied[::-1])


def test_empty_table(spark):
    assert trie(spark, []) == []


def test_long_conversation_and_deep_chain(spark):
    rows = [(c, t, "user", f"t{t}") for c in (0, 1, 2, 3) for t in range(150)] + [(4, t, "user", f"t{t}") for t in range(300)]
    assert trie(spark, rows, 6) == brute(rows)
