"""Packed products and hard negatives against plain Python."""

import math
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from filmgrain.llm.negatives import PackedShots, mine_hard_negatives

SCHEMA = "shot_id bigint, lighting_key string, features array<double>, rank int, anchor_id string"


def brute(rows, anchors, positives=5, negatives=10):
    good = {}
    for key, label, vector in rows:
        if key is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * x) for x in vector])
        good[key] = min(row, good.get(key, row))
    out = []
    for a in sorted(set(anchors) & set(good)):
        label, mine = good[a]
        score = lambda k: sum(x * y for x, y in zip(mine, good[k][1]))
        ranked = sorted((k for k in good if k != a and len(good[k][1]) == len(mine)), key=lambda k: (-score(k), k))
        for p in [k for k in ranked if good[k][0] == label][:positives]:
            fits = [k for k in ranked if good[k][0] != label and 30 * score(p) <= 100 * score(k) <= 90 * score(p)]
            out += [(a, p, r + 1, k, score(p), score(k)) for r, k in enumerate(fits[:negatives])]
    return sorted(out)


def found(spark, rows, anchors, **sizes):
    shots = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in mine_hard_negatives(shots, spark.createDataFrame([(a,) for a in anchors], "shot_id bigint"), **sizes).collect())


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_packed_products_are_exact(data):
    dims, most = data.draw(st.integers(1, 9)), data.draw(st.sampled_from([1, 3, 160, 40_000, 1 << 28]))
    number = st.integers(-most, most)
    vector = st.lists(number, min_size=dims, max_size=dims)
    shots, anchor = np.array(data.draw(st.lists(vector, min_size=1, max_size=20)), np.int64), data.draw(vector)
    assert PackedShots(shots, most).scores(anchor).tolist() == (shots @ np.array(anchor, np.int64)).tolist()


def test_equals_brute_force_in_small_blocks(spark):
    rng = random.Random(2)
    keys = ["low_key", "high_key", "balanced"]
    # Four of five shots share one key; ties and repeated vectors; vectors of two lengths.
    rows = [(i, keys[rng.randrange(3)] if i % 5 == 0 else "low_key", [rng.uniform(0, 1) for _ in range(6 if i % 9 else 4)]) for i in range(150)]
    rows += [(200 + i, keys[i % 3], [0.5] * 6) for i in range(30)] + [(300, "high_key", [-1.0] * 6)]
    rows += [(400, None, [0.5] * 6), (401, "low_key", None), (402, "low_key", []), (403, "low_key", [0.5, None, 1.0, 1.0, 1.0, 1.0]), (404, "balanced", [float("nan")] * 6),
             (405, "balanced", [float("inf")] * 6), (None, "balanced", [0.5] * 6), (3, "balanced", [0.5] * 6), (3, "balanced", [0.5] * 6)]
    anchors = [0, 3, 7, 9, 45, 200, 201, 300, 400, 401, 404, 7, 999]
    want = brute(rows, anchors)
    assert len(want) > 100
    assert found(spark, rows, anchors, block=7, anchor_block=2) == want
    assert found(spark, rows, anchors) == want


def test_no_rows_few_rows_and_one_key(spark):
    assert found(spark, [], [1]) == []
    assert found(spark, [(1, "low_key", [1.0]), (2, "low_key", [1.0])], []) == []
    assert found(spark, [(1, "low_key", [1.0]), (2, "low_key", [1.0])], [1]) == []
    assert found(spark, [(1, "low_key", [1.0]), (2, "low_key", [1.0]), (3, "high_key", [0.5])], [1]) == [(1, 2, 1, 3, 65536, 32768)]
