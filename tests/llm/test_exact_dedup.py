import hashlib
import random
import re

import pytest

from tidemark.llm.exact_dedup import exact_dedup, exact_groups, without_copies


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) by a dictionary of normalised texts."""
    groups = {}
    for k, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id, k))
    out = []
    for normal, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0, m[2]))
        for _, doc_id, k in members:
            out.append((doc_id, best[1], len(members), hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def sample():
    rng = random.Random(4)
    texts = [None, "", " \n", " ", "a b", "ab", "a\tb\x0b", "A b", "ab ", "é" * 9, "é" * 5 + " " + "é" * 4]
    long = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    near = [t[:-1] + "z" for t in long[:20]] + [" ".join(t) for t in long[:20]]
    hot = ["same text " * 30] * 200
    rows = list(enumerate(texts + long + near + hot))
    return rows + [(5, "ab"), (5, "ab"), (None, "no id"), (None, "no id")]


@pytest.mark.parametrize(("size", "bits"), [(7, 64), (7, 3), (3, 1), (4096, 64)])
def test_groups_equal_brute_force(spark, size, bits):
    rows = sample()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(3)
    assert rows_of(exact_dedup(df, block_chars=size, key_bits=bits)) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    rows = sample()
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _name string, n_chars int").repartition(3)
    kept = exact_dedup(df).filter("kept").collect()
    normal = {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows}
    assert len(kept) == len(normal)
    stay = without_copies(df)
    assert stay.columns == df.columns
    got = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in stay.collect()]
    assert sorted(got) == sorted(normal)


def test_names_are_one_integer_per_text_and_need_no_python(spark):
    df = spark.createDataFrame([(k, "x" * k) for k in range(40)], "doc_id long, text string")
    groups = exact_groups(df, block_chars=3)
    assert groups.select("_blocks", "_name").distinct().count() == 40
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(df).count() == 0 and without_copies(df).count() == 0
