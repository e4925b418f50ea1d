"""Repeated substrings against plain Python."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from filmgrain.llm import substrings
from tests.llm.data import awkward, prose


def brute(rows, size):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for (key, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - size + 1):
            if seen[d[i:i + size]] > 1:
                gone[i:i + size] = 1
        out.append((key, len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), bytes(b for b, g in zip(d, gone) if not g)))
    return out


def result(df):
    return Counter((r.critique_run_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_equals_brute_force(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    rows = awkward(rng)[:-1] + [(60, "é" * 300), (61, "x" + "é" * 150), (62, "ab" * 400), (63, passage[3:260]), (64, passage[:250])]
    rows += [(100 + i, prose(rng, 15) + passage + prose(rng, 15)) for i in range(30)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "critique_run_id bigint, text string, key int")
    want = Counter(brute(rows, 200))
    assert result(substrings.remove_repeats(df)) == want
    # Every window counted by itself where a key has more than two different pieces.
    assert result(substrings.remove_repeats(df, max_variants=2)) == want


def test_no_rows_and_short_rows(spark):
    df = spark.createDataFrame([], "critique_run_id bigint, text string")
    assert substrings.remove_repeats(df).collect() == []
    df = spark.createDataFrame([(1, "a" * 199), (2, "a" * 199)], "critique_run_id bigint, text string")
    assert result(substrings.remove_repeats(df)) == Counter([(1, 199, 0, 0, b"a" * 199), (2, 199, 0, 0, b"a" * 199)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=6), st.integers(1, 20))
def test_index_finds_exactly_the_repeated_strings(texts, size):
    data = [t.encode() for t in texts]
    seen = Counter(d[i:i + size] for d in data for i in range(len(d) - size + 1))
    want = [i + size <= len(d) and seen[d[i:i + size]] > 1 for d in data for i in range(len(d))]
    got = substrings.repeated_starts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), size)
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120), st.binary(max_size=120), st.integers(4, 24))
def test_equal_windows_have_equal_anchors(a, b, size):
    data = np.frombuffer(a + b + a, np.uint8)
    offsets = np.cumsum([0, len(a), len(b), len(a)])
    key, _, text, low, high = substrings.anchored_runs(data, offsets, size, 3)
    runs = lambda n: [(int(k), int(x), int(y)) for k, t, x, y in zip(key, text, low, high) if t == n]
    assert runs(0) == runs(2)
    assert sum(y - x + 1 for _, x, y in runs(0)) == max(0, len(a) - size + 1)
