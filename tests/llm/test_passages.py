"""First passages against plain Python."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from filmgrain.llm import passages
from tests.llm.data import awkward, prose


def brute(rows, size=13):
    said = [(key, (text or "").encode().split()) for key, text in rows]
    first = {}
    for key, words in said:
        if key is not None:
            for i in range(len(words) - size + 1):
                window = tuple(words[i:i + size])
                first[window] = min(key, first.get(window, key))
    out = []
    for key, words in said:
        gone = set()
        for i in range(len(words) - size + 1):
            if key is not None and first[tuple(words[i:i + size])] < key:
                gone |= set(range(i, i + size))
        out.append((key, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return Counter(out)


def rows_of(spark, rows, **settings):
    kind = "string" if any(isinstance(k, str) for k, _ in rows) else "bigint"
    df = spark.createDataFrame([(i, t, 0, 1, "k") for i, t in rows], f"critique_run_id {kind}, text string, key int, first int, kept string")
    return passages.keep_first_passages(df, **settings).collect()


def result(found):
    return Counter((r.critique_run_id, r.n_words, r.n_removed, r.kept) for r in found)


def hard_rows():
    rng = random.Random(4)
    passage = prose(rng, 70).split()
    rows = awkward(rng)[:-1]
    rows += [(100 + i, " ".join([prose(rng, 9), *passage[rng.randrange(0, 30):rng.randrange(40, 70)], prose(rng, 9)])) for i in range(40)]
    # Small vocabularies branch at every word; loops meet themselves; one id twice with different texts.
    rows += [(200 + i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(30)]
    rows += [(300, "no " * 40), (301, "no " * 12), (302, "no " * 13), (299, "a b " * 30), (303, " ".join(passage)), (303, prose(rng, 40)), (250, prose(rng, 8) + " " + " ".join(passage[5:40])), (250, " ".join(passage[20:60])),
             (304, "\n".join(passage[:13])), (305, " ".join(passage[:12])), (None, " ".join(passage))]
    return rows, " ".join(passage)


def test_equals_brute_force(spark):
    rows, _ = hard_rows()
    assert result(rows_of(spark, rows)) == brute(rows)
    assert result(rows_of(spark, rows, words=5, anchor_words=2)) == brute(rows, 5)


def test_spans_name_their_source(spark):
    rng = random.Random(1)
    passage = prose(rng, 80)
    rows = [("a", prose(rng, 5) + " " + passage), ("b", prose(rng, 20) + " " + passage + " " + prose(rng, 20)), ("c", passage)]
    spans = {r.critique_run_id: [tuple(s) for s in r.spans] for r in rows_of(spark, rows)}
    assert spans == {"a": [], "b": [(20, 80, "a", 5)], "c": [(0, 80, "a", 5)]}


def test_spans_are_true_and_cover_what_goes(spark):
    rows, _ = hard_rows()
    rows = [(k, t) for k, t in rows if k is not None and k not in (303, 250)]
    said = {}
    for k, t in rows:
        said.setdefault(k, (t or "").split())
    for r in rows_of(spark, rows):
        words = said[r.critique_run_id]
        assert len({i for s in r.spans for i in range(s.start, s.start + s.words)}) == r.n_removed
        for s in r.spans:
            assert s.source_id < r.critique_run_id
            assert words[s.start:s.start + s.words] == said[s.source_id][s.source_start:s.source_start + s.words]


def test_no_rows(spark):
    assert rows_of(spark, []) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4), st.integers(3, 7))
def test_equal_windows_have_equal_keys(texts, size):
    words = np.array([w for t in texts for w in t], np.uint64)
    bounds = np.cumsum([0, *map(len, texts)])
    text, key, _, first, count = passages.anchored_windows(words, bounds, size, 2)
    seen = {}
    for t, k, f, c in zip(text.tolist(), key.tolist(), first.tolist(), count.tolist()):
        for i in range(f, f + c):
            assert seen.setdefault(tuple(texts[t][i:i + size]), k) == k
    assert int(count.sum()) == sum(max(0, len(t) - size + 1) for t in texts)
