"""Benchmark leaks against plain edit distance."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from filmgrain.llm import leaks
from tests.llm.data import awkward, prose


def least_distance(item, text):
    """Sellers' table: the least edit distance of item to any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row, best = new, min(best, new[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=120))
def test_bit_parallel_distance(item, text):
    assert leaks.distance_within(item, text) == least_distance(item, text)


def stands(item, text):
    """Whether item occurs somewhere without beginning or ending inside a word."""
    inside = lambda a, b: a.isalnum() and b.isalnum()
    return any(text[i:i + len(item)] == item and not (i and inside(text[i - 1], item[0])) and not (text[i + len(item):] and inside(item[-1], text[i + len(item)])) for i in range(len(text)))


@settings(max_examples=300, deadline=None)
@given(st.text("ab -", min_size=1, max_size=11), st.text("ab -", max_size=60))
def test_short_items_are_found_between_word_ends(item, text):
    assert leaks.Searcher([(1, item)], 5).find(text) == ({1: 0} if stands(item, text) else {})


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", min_size=12, max_size=40), st.text("ab ", max_size=150), st.integers(0, 20))
def test_search_misses_nothing(item, text, percent):
    least = least_distance(item, text)
    found = leaks.Searcher([(1, item)], percent).find(text)
    assert found == ({1: least} if least <= len(item) * percent // 100 else {})


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + rng.choice((0, 1))] = rng.choice(("", "q", "zz"[:1]))
    return "".join(out)


@pytest.mark.parametrize("block", [8 << 20, 150])
def test_equals_brute_force(spark, block):
    rng = random.Random(6)
    items = [(i, prose(rng, 12)) for i in range(6)] + [(6, "Short  ITEM here"), (7, None), (8, "tiny"), (9, "Forty  two"), (10, " "), (11, "x"), (None, prose(rng, 9)), (1, "one more text of item one")]
    texts = [(i, t) for i, t in awkward(rng)[:-1]]
    texts += [(100 + n, prose(rng, 20) + "\n " + edited(rng, items[n % 6][1], n // 2).upper() + " " + prose(rng, 5)) for n in range(24)] + [(200, "a short item\nhere"), (201, "say forty\ttwo, Tiny!"), (202, "forty twos, destiny, ax"), (203, "(X)"), (None, items[1][1])]
    critiques = spark.createDataFrame([(i, t, 4) for i, t in texts], "critique_run_id bigint, text string, found int")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = leaks.find_leaks(critiques, benchmark, block_chars=block, carry=("found",)).collect()
    want = []
    for i, t in texts:
        near = {}
        for key, item in items:
            item = leaks.plain(item)
            if key is None or not item:
                continue
            if len(item) < leaks.WORD_CHARS:
                near |= {key: 0} if stands(item, leaks.plain(t)) else {}
            elif (d := least_distance(item, leaks.plain(t))) <= len(item) * leaks.PERCENT // 100:
                near[key] = min(d, near.get(key, d))
        want.append((i, 4, sorted(near), min(near.values(), default=None), bool(near)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert any(w[3] for w in want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "critique_run_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.find_leaks(none, items).collect() == []
    assert [tuple(r) for r in leaks.find_leaks(spark.createDataFrame([(1, "text")], none.schema), items).collect()] == [(1, [], None, False)]
