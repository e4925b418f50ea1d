"""Line dedup against plain Python, and its reversible state."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from filmgrain.llm import lines
from tests.llm.data import awkward

ROWS = [(i, f"Shared line\n own {i}\n\n shared LINE \t\nrare {i % 4}") for i in range(12)]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(rows, bound=10):
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if seen[key(x)] < bound]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


def result(df):
    return Counter((r.critique_run_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def test_equals_brute_force(spark):
    rows = ROWS + awkward(random.Random(2)) + [(None, "shared line\nx")] * 2 + [(90, "É line"), (91, "\n" * 500 + "Shared line")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "critique_run_id bigint, text string, key int")
    got = lines.drop_common_lines(df)
    assert got.columns == ["critique_run_id", "text", "key", "n_lines", "n_dropped"]
    assert result(got) == Counter(brute(rows))
    assert result(lines.drop_common_lines(df, shards=3, salts=2)) == Counter(brute(rows))


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a\nb", 9, 9)], "critique_run_id bigint, text string, n_lines int, n_dropped int")
    assert [tuple(r) for r in lines.drop_common_lines(df).collect()] == [(1, "a\nb", 2, 0)]


def test_deleting_what_was_added_restores_counts_and_filters(spark):
    rows = lambda some: spark.createDataFrame(some, "critique_run_id bigint, text string")
    first, more = rows(ROWS[:9]), rows(ROWS[9:])
    before = lines.count_lines(first)
    after = lines.changed_counts(before, added=more)
    again = lines.changed_counts(after, deleted=more)
    table = lambda df: {bytes(r.key): r.n_critiques for r in df.collect()}
    assert table(again) == table(before) != table(after)
    filters = lines.build_filters(before, 2)
    grown = lines.changed_filters(filters, before, after, 2)
    shrunk = lines.changed_filters(grown, after, again, 2)
    every = rows(ROWS)
    assert result(lines.drop_common_lines(every, counts=after, filters=grown, shards=2)) == Counter(brute(ROWS))
    assert result(lines.drop_common_lines(every, counts=again, filters=shrunk, shards=2)) == Counter((i, t, 5, 0) for i, t in ROWS)


def test_no_rows(spark):
    assert lines.drop_common_lines(spark.createDataFrame([], "critique_run_id bigint, text string")).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.sets(st.binary(min_size=16, max_size=16), min_size=1, max_size=120), st.integers(1, 4))
def test_cuckoo_filter_holds_what_was_added_and_loses_what_was_taken_out(keys, size):
    keys = sorted(keys)
    matrix = lines._matrix(keys)
    made = lines.CuckooFilter(size)  # far too small, so the stash is used
    made.add(matrix)
    made = lines.CuckooFilter(data=made.to_bytes())
    assert made.holds(matrix).all()
    half = len(keys) // 2
    made.discard(matrix[:half])
    assert made.holds(matrix[half:]).all()
    made.discard(matrix[half:])
    assert not made.table.any() and not made.stash


def test_filter_rarely_errs():
    rng = np.random.default_rng(1)
    made = lines.CuckooFilter(2000)
    made.add(rng.integers(0, 256, (2000, 16), dtype=np.uint8))
    assert made.holds(rng.integers(0, 256, (20_000, 16), dtype=np.uint8)).mean() < 0.002
