"""Near copies against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from filmgrain.llm import near_copies
from tests.llm.data import awkward, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset([tuple(words[k:k + 5]) for k in range(len(words) - 4)] or ([tuple(words)] if words else [])))
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if sets[i] and key is not None:
            least[find(i)].append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        component = (min(least[find(i)]) if least[find(i)] else None) if sets[i] else key
        out.append((key, len(sets[i]), component))
    return out


def chained(rng):
    """Copies that drift away from each other, so a group hangs together through its middle."""
    words, out = prose(rng, 150).split(), []
    for i in range(12):
        words[rng.randrange(len(words))] = f"new{i}"
        out.append((100 + i, " ".join(words)))
    return out


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows = awkward(rng) + chained(rng) + [(200 + i, prose(rng, 40)) for i in range(30)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "critique_run_id bigint, text string, root int")
    got = near_copies.link_near_copies(df).collect()
    want = brute(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r.critique_run_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(want, key=order)
    assert all(r.kept == (r.critique_run_id == r.component_id or r.critique_run_id is None or r.component_id is None) for r in got)


def test_blocks_find_the_same_links(spark):
    rng = random.Random(5)
    df = spark.createDataFrame(chained(rng) + [(300 + i, prose(rng, 30)) for i in range(5)], "critique_run_id bigint, text string")
    small = {tuple(r) for r in near_copies.link_near_copies(df, block_bytes=4000).collect()}
    assert small == {tuple(r) for r in near_copies.link_near_copies(df).collect()}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2 ** 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(1, 2 ** 63, 200, dtype=np.uint64)])
    marks = near_copies.signatures([a, b], 512)
    assert (marks[0] == marks[1]).mean() == pytest.approx(1800 / 2200, abs=0.06)


def test_no_rows(spark):
    df = spark.createDataFrame([], "critique_run_id bigint, text string")
    assert near_copies.link_near_copies(df).collect() == []
    assert near_copies.keep_first_copies(df).collect() == []


def test_keep_first_copies_keeps_columns_and_one_row(spark):
    text = prose(random.Random(1), 30)
    rows = [(2, text, "a"), (1, text, "b"), (1, text, "b"), (3, None, "c"), (4, None, "d"), (None, "x y", "e")]
    kept = near_copies.keep_first_copies(spark.createDataFrame(rows, "critique_run_id bigint, text string, digest string")).collect()
    assert Counter((r.critique_run_id, r.digest) for r in kept) == Counter([(1, "b"), (3, "c"), (4, "d"), (None, "e")])
