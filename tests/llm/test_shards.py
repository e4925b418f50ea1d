"""Shards against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from filmgrain.llm import shards
from tests.llm.data import awkward


def brute(rows, count, seed="filmgrain"):
    models = defaultdict(list)
    for key, text, model in rows:
        digest = int(hashlib.md5(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:15], 16)
        data = (text or "").encode()
        models["" if model is None else "m" + model].append((digest, key is not None, key or 0, zlib.crc32(data), len(data) + 16, key))
    order = []
    for model, members in models.items():
        for rank, m in enumerate(sorted(members), 1):
            order.append(((2 * rank - 1) / (2 * len(members)), model, m))
    n, out = len(rows), []
    for at, (_, _, m) in enumerate(sorted(order)):
        shard = at * count // n
        out.append((m[5], m[4], m[3], "rows", shard, at - -(-shard * n // count), None))
    return Counter(out)


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_equals_brute_force(spark, buckets):
    rng = random.Random(9)
    rows = [(k, t, rng.choice(["a", "a", "a", "b", None, "c"])) for k, t in awkward(rng)] + [(500 + i, "same", "a") for i in range(90)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "critique_run_id bigint, text string, model_name string, size string")
    got = shards.deal_shards(df, 7, buckets=buckets)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 7)


def test_counts_and_mixture_match(spark):
    rows = [(i, "t", "abc"[0 if i % 3 else i % 2 + 1]) for i in range(900)]
    found = shards.deal_shards(spark.createDataFrame(rows, "critique_run_id bigint, text string, model_name string"), 9).collect()
    model = {i: m for i, _, m in rows}
    assert set(Counter(r.shard for r in found).values()) == {100}
    for m, n in Counter(model.values()).items():
        per = Counter(r.shard for r in found if model[r.critique_run_id] == m)
        assert all(abs(per[s] - n / 9) <= 1 + 3 * n / 900 for s in range(9))
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(100)) for s in range(9))


def test_fewer_rows_than_shards_and_none(spark):
    schema = "critique_run_id bigint, text string, model_name string"
    got = shards.deal_shards(spark.createDataFrame([(1, None, None), (2, "é", "m")], schema), 40).collect()
    assert sorted((r.size, r.slot) for r in got) == [(16, 0), (18, 0)] and len({r.shard for r in got}) == 2
    assert shards.deal_shards(spark.createDataFrame([], schema)).collect() == []


def test_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a", "m")], "critique_run_id bigint, text string, model_name string")
    plan = shards.deal_shards(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
