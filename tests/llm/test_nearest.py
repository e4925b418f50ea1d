"""Best matches against plain Python."""

import math
import random

import numpy as np
import pytest

from filmgrain.llm import nearest


def brute(rows, asked, top=5):
    whole = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(key, set()).add(tuple(math.floor(256 * x) for x in v))
    out = []
    for q in sorted(set(asked) & set(whole)):
        found = {(-sum(a * b for a, b in zip(v, w)), key) for v in whole[q] for key, ws in whole.items() if key != q for w in ws if len(w) == len(v)}
        out += [(q, i + 1, key, -score) for i, (score, key) in enumerate(sorted(found)[:top])]
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(9)] + [(3, rows[3][1])]
    rows += [(300, None), (301, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (302, [math.nan] * 6), (303, [math.inf] * 6), (304, []), (305, [1.0, 2.0]), (306, [0.0] * 6), (None, [1.0] * 6)]
    asked = [i for i, _ in rows if i is not None and i % 3 == 0]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "shot_id bigint, features array<double>, pivot int")
    got = nearest.nearest_shots(df, df.where("shot_id % 3 = 0"), block=block, query_block=block, pivots=4, sample=50)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "shot_id", "score").collect()) == brute(rows, asked)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(1 << 19) + i, 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "shot_id bigint, features array<double>")
    got = nearest.nearest_shots(df, df.where("shot_id = 0"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [0])


def test_no_rows(spark):
    df = spark.createDataFrame([], "shot_id bigint, features array<float>")
    assert nearest.nearest_shots(df, df).collect() == []


def test_best_breaks_ties_by_id():
    scores, ids = np.array([5, 7, 7, 7, 1, 7] * 9), np.arange(54)[::-1].copy()
    assert ids[nearest._best(scores, ids, 3)].tolist() == sorted(ids[scores == 7].tolist())[:3]
