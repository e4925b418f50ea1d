"""Looping critiques against plain Python that tries every period."""

import random
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from filmgrain.llm import loops, queries
from tests.llm.data import awkward, prose


def brute(words, least=24, turns=3):
    """(start, length, period) of every run: each period in turn, only the smallest of a stretch."""
    n, found, seen = len(words), [], set()
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e + q - i
            if length >= max(least, turns * q) and not any(q % p == 0 and (s, m) in seen for p in range(1, q) for s, m in [(i, (length, p))]):
                found.append((i, length, q))
                seen.add((i, (length, q)))
            i = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def want(key, text):
    words = (text or "").encode().split()
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return key, len(words), len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, tuple(runs), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def got(df):
    return [(r.critique_run_id, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in df.collect()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=5))
def test_runs_of_small_words_equal_brute_force(parts):
    words = [w for unit, times in parts for w in unit * times]
    hashes = np.array(words, np.uint64)
    place, segment = loops.frequent_segments(hashes, np.zeros(len(words), np.int64), 8, 3)
    first, length, period = loops.lag_scan(hashes[place], segment, 8, 3)
    assert list(zip(place[first].tolist(), length.tolist(), period.tolist())) == brute(words, 8)


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    rows = awkward(rng)[:-1]
    for i in range(60):
        unit = prose(rng, rng.randrange(1, 30))
        rows.append((100 + i, " ".join([prose(rng, rng.randrange(0, 40)), *[unit] * rng.randrange(1, 9), unit[:len(unit) // 2], prose(rng, rng.randrange(0, 40))])))
    rows += [(200, "no " * 23), (201, "no\t" * 24), (202, "a b " * 12), (203, "\x1fx y " * 30), (204, "same " * 5000), (205, ("a " * 30 + "b ") * 5)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "critique_run_id bigint, text string, n_runs int, collapsed string")
    assert sorted(got(loops.find_loops(df)), key=repr) == sorted((want(*r) for r in rows), key=repr)


def test_no_rows(spark):
    assert loops.find_loops(spark.createDataFrame([], "critique_run_id bigint, text string")).collect() == []


def test_a_long_text_with_a_long_period(spark):
    rng = random.Random(8)
    unit = prose(rng, 9_000)
    text = "begin " + " ".join([unit] * 3) + " end"
    row = got(loops.find_loops(spark.createDataFrame([(1, text)], "critique_run_id bigint, text string")))[0]
    assert row[1:7] == (27_002, 1, 1, 27_000, 9_000, 3_000)
    assert row[8] == f"begin {unit} end"


def test_query_equals_brute_force_on_planted_loops(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 120)), "en", "s") for i in range(150)] + [(150, None, None, None), (None, "one two", None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

    def planted(key, text):
        words, h = (text or "").encode().split(), zlib.crc32(str(key).encode())
        n, g = len(words), h // 10
        if key is None or h % 10 or not n:
            return text
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)).decode()

    import hashlib
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for key, text, *_ in rows:
        w = want(key, planted(key, text))
        wanted.append((key, w[2], *w[3:7], sha("".join(f"{s},{n},{q}\n" for s, n, q in w[7])), sha(w[8])))
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = [tuple(r) for r in queries.op11_critique_loops(spark, str(tmp_path)).select(*cols).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert sum(w[1] > 0 for w in wanted) >= 5
