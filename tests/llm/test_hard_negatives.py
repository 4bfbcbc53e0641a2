import math

import numpy as np
import pytest

from tidemark.llm import hard_negatives
from tidemark.llm.hard_negatives import bounds_of, hilbert_keys, mined

SCHEMA = "vec_id long, embedding array<float>, label int, block string, score int"
COLUMNS = "anchor_id positive_id rank negative_id positive_score negative_score".split()


def brute(rows):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for k, (anchor, label, vector) in enumerate(kept):
        if anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(vector, v)), i, own == label) for j, (i, own, v) in enumerate(kept) if j != k]
        for p, positive, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted(s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)[:3]
            out += [(anchor, positive, rank, i, -p, -n) for rank, (n, i, _) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r[c] for c in COLUMNS) for r in mined(df).collect())


def vectors(seed, count, dimensions=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.5, (10, dimensions))
    labels = rng.choice(10, count, p=[0.4] + [0.6 / 9] * 9)  # one label owns a large part
    return [(k, [float(x) for x in centres[rng.integers(10)] + rng.normal(0, 0.2, dimensions)], int(labels[k]), "x", 1) for k in range(count)]


@pytest.mark.parametrize("block,group,unit", [(1024, 512, 32), (16, 5, 3)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, group, unit):
    for name, value in (("BLOCK", block), ("GROUP", group), ("UNIT", unit), ("PAGE", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(block, 1200)
    assert len(want := brute(rows)) > 100
    assert found(spark, rows) == want


def test_nulls_copies_ties_and_lengths(spark):
    rows = vectors(2, 300, 3)
    rows += [(50, rows[50][1], rows[50][2], "x", 1), (None, [1.0] * 3, 1, "x", 1), (400, None, 1, "x", 1), (450, [1.0, None, 2.0], 1, "x", 1)]
    rows += [(500, [float("nan")] * 3, 1, "x", 1), (550, [float("inf"), 0.0, 0.0], 2, "x", 1), (600, [0.3] * 3, None, "x", 1), (650, [], 3, "x", 1), (700, [0.5], 3, "x", 1)]
    rows += [(1000 + k, rows[60][1], k % 2, "x", 1) for k in range(80)]  # one vector many times
    assert found(spark, rows) == brute(rows)


def test_large_components_and_empty_table(spark):
    rows = [(k, [float(1e5 * (k % 11 + 1)), float(-3e4 * k)], k % 3, "x", 1) for k in range(120)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] == found(spark, [(50, None, 1, "x", 1)])


def test_curve_visits_neighbours():
    for dimensions, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), axis=-1).reshape(-1, dimensions)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(1)
    rows, anchors = rng.integers(-50, 50, (40, 6)).astype(float), rng.integers(-50, 50, (9, 6)).astype(float)
    least, most = bounds_of(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (least <= scores.min(axis=1, keepdims=True)).all() and (most >= scores.max(axis=1, keepdims=True)).all()
