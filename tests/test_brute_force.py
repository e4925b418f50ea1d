"""Operators against direct loops on random small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmgrain.config import Spatial
from filmgrain.operators import audio as A, colour as C, motion as M, ordered as O, sampling as P, shots as S, spatial as X
from filmgrain.operators.ordered import join_one, with_neighbour_mean, with_next_marked, with_previous, with_row_number
from filmgrain.operators.quantiles import Pick, grouped_medians, grouped_quantiles

RNG = random.Random(7)


def merge_by_repeated_scan(cuts, duration, shortest):
    """Join the first short interval to its neighbour until none is left."""
    edges = [0, *cuts, duration]
    while len(edges) > 2:
        short = next((i for i in range(len(edges) - 1) if edges[i + 1] - edges[i] < shortest), None)
        if short is None:
            break
        edges.pop(short + 1 if short < len(edges) - 2 else short)
    return list(zip(edges, edges[1:]))


def test_merge_short_shots(spark, table):
    clips, bounds, want = [], [], {}
    for clip in range(300):
        duration = RNG.randint(1, 4000)
        cuts = [RNG.randint(-10, duration + 10) for _ in range(RNG.randint(0, 25))]
        clips.append((clip, duration))
        bounds += [(clip, p, i) for i, p in enumerate(cuts)]
        want[clip] = merge_by_repeated_scan(sorted({p for p in cuts if 0 < p < duration}), duration, 300)
    d = table("clip_id int, duration_ms bigint", clips)
    cuts = S.internal_cuts(table("clip_id int, position_ms bigint, ord bigint", bounds), d)
    got = {}
    for r in S.merge_short_shots(cuts, d, 300).orderBy("clip_id", "shot_index").collect():
        got.setdefault(r.clip_id, []).append((r.start_ms, r.end_ms))
    assert got == want


@pytest.fixture(scope="module")
def ordered(spark):
    rows, n = [], 0
    for key in (1, 2, 3):
        for _ in range(RNG.choice([1, 60, 200])):
            rows.append((key, RNG.randint(0, 40), n, RNG.choice([None, RNG.random()])))
            n += 1
    df = spark.createDataFrame(rows, "k int, t bigint, id bigint, v double")
    by_key = {k: sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])) for k in (1, 2, 3)}
    return df, by_key


def test_row_number_and_previous(ordered):
    df, by_key = ordered
    chunk = F.floor(F.col("t") / 3)
    got = {r.id: (r.rn, r.n) for r in with_row_number(df, ["k"], ["t", "id"], chunk, "rn", "n").collect()}
    prev = {r.id: r.prev and r.prev["id"] for r in with_previous(df, ["k"], ["t", "id"], chunk, ["id", "v"]).collect()}
    for rows in by_key.values():
        for i, r in enumerate(rows):
            assert got[r[2]] == (i, len(rows)) and prev[r[2]] == (rows[i - 1][2] if i else None)


def test_next_marked(ordered):
    df, by_key = ordered
    got = {r.id: r.hit for r in with_next_marked(df, ["k"], ["t", "id"], F.floor(F.col("t") / 3), "v", "hit").collect()}
    for rows in by_key.values():
        for i, r in enumerate(rows):
            assert got[r[2]] == next((x[3] for x in rows[i:] if x[3] is not None), None)


def test_neighbour_mean_across_blocks(ordered):
    df, by_key = ordered
    df = df.withColumn("v", F.coalesce("v", F.lit(0.0)))
    out = with_neighbour_mean(df, ["k"], ["t", "id"], F.floor(F.col("t") / 3), "v", 2, "m", block=5)
    got = {r.id: r.m for r in out.collect()}
    for rows in by_key.values():
        v = [x[3] or 0.0 for x in rows]
        for i, r in enumerate(rows):
            near = v[max(0, i - 2):i] + v[i + 1:i + 3]
            assert got[r[2]] == (pytest.approx(sum(near) / len(near), abs=1e-12) if near else None)


def test_join_one_keeps_every_row(spark, table):
    big, one = table("k int, v int", [(1, i) for i in range(100)] + [(2, 0)]), table("k int, w int", [(1, 7)])
    assert join_one(big, one, ["k"]).count() == 100 and join_one(big, one, ["k"], "left").where("w is null").count() == 1


def test_quantiles_are_exact(spark, table):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(size=501), 1: np.array([5.0]), 2: rng.integers(-3, 3, 400).astype(float), 3: rng.random(1000) * 1e-9,
              4: np.concatenate([rng.random(50) * 1e12, -rng.random(50)]), 5: np.zeros(10)}
    df = table("g int, v double", [(g, float(x)) for g, v in groups.items() for x in v] + [(0, None)])
    picks = [Pick("p10", q=0.1), Pick("mid"), Pick("p90", q=0.9), Pick("low", "lower", 0.1), Pick("up", "upper")]
    for r in grouped_quantiles(df, ["g"], "v", picks).collect():
        v = np.sort(groups[r.g])
        assert r.n == len(v)
        np.testing.assert_allclose([r.p10, r.mid, r.p90], np.percentile(v, [10, 50, 90]), rtol=1e-12, atol=1e-18)
        assert r.low == v[int(0.1 * (len(v) - 1))] and r.up == v[len(v) // 2]


def test_medians_of_several_columns(spark, table):
    df = table("g int, a double, b double", [(1, 1.0, None), (1, 2.0, 5.0), (1, 4.0, 7.0), (2, None, 1.0)])
    got = {r.g: (r.a_median, r.b_median) for r in grouped_medians(df, ["g"], ["a", "b"]).collect()}
    assert got == {1: (2.0, 6.0), 2: (None, 1.0)}


def test_cut_matching(spark, table):
    pred, exp, want = [], [], {}
    for clip in range(40):
        p = sorted(RNG.sample(range(0, 3000, 10), RNG.randint(1, 15)))
        e = sorted(RNG.sample(range(0, 3000, 10), RNG.randint(1, 15)))
        pred += [(clip, x, i) for i, x in enumerate(p)]
        exp += [(clip, x, i) for i, x in enumerate(e)]
        left, hits = list(p), 0
        for target in e:
            close = sorted((abs(x - target), i) for i, x in enumerate(left) if abs(x - target) <= 200)
            if close:
                left.pop(close[0][1])
                hits += 1
        want[clip] = hits
    schema = "clip_id int, position_ms bigint, ord bigint"
    assert {r.clip_id: r.matched for r in S.match_cuts(table(schema, pred), table(schema, exp)).collect()} == want


def test_frames_at_or_after(spark, table):
    frames = [(1, RNG.randint(0, 60_000), i) for i in range(80)]
    asks = [(1, f"s{i}", t, 20_000, 50_000) for i, t in enumerate(RNG.sample(range(0, 70_000), 100))]
    got = {r.sample_id: (r.decoded_ms, r.frame_index, r.unavailable_reason) for r in P.match_frames(
        table("clip_id int, sample_id string, requested_ms bigint, start_ms bigint, end_ms bigint", asks),
        table("clip_id int, at_ms bigint, frame_index bigint", frames)).collect()}
    for _, sid, t, lo, hi in asks:
        later = sorted((f[1], f[2]) for f in frames if f[1] >= t)
        if not later:
            assert got[sid] == (None, None, P.MISSING)
        elif lo <= later[0][0] < hi:
            assert got[sid] == (*later[0], None)
        else:
            assert got[sid] == (None, None, P.OUTSIDE)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def test_tracker(spark, table):
    rows, want = [], {}
    for shot in range(12):
        live = {}
        for sample in range(15):
            hits = []
            for h in range(RNG.randint(0, 4)):
                x, y = RNG.choice([0.1, 0.15, 0.3, 0.5]), RNG.choice([0.1, 0.2, 0.4])
                hits.append((x, y, x + 0.3, y + RNG.choice([0.3, 0.4])))
                rows.append((shot, sample, h, "person", 0.9, *hits[-1]))
            given = {}
            ranked = sorted(((-overlap(b, hit), t, h) for t, b in live.items() for h, hit in enumerate(hits)))
            for score, t, h in ranked:
                if -score >= 0.3 and h not in given and t not in given.values():
                    given[h] = t
            for h, hit in enumerate(hits):
                t = given.get(h) or f"t{len(live) + 1:04d}"
                live[t] = hit
                want[shot, sample, h] = t
    schema = "shot_id int, sample_ord bigint, hit_ord bigint, class_name string, confidence double, x_min double, y_min double, x_max double, y_max double"
    got = {(r.shot_id, r.sample_ord, r.hit_ord): r.track_id for r in X.track_subjects(table(schema, rows), Spatial()).collect()}
    assert got == want


def naive_flux(x):
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 511)
    mags = [np.abs(np.fft.rfft(x[i:i + 512] * window)) for i in range(0, len(x) - 511, 256)]
    rises = [np.maximum(b - a, 0).sum() for a, b in zip(mags, mags[1:])]
    return sum(rises) / len(rises) if rises else 0.0


@pytest.mark.parametrize("hop,window", [(500, 1000), (300, 1000)])
def test_audio_windows(spark, table, hop, window):
    rate, n = 2001, 6000
    rng = np.random.default_rng(1)
    x = np.sin(np.arange(n) / 9.0) * (np.arange(n) > 2500) + rng.normal(size=n) * 0.01
    x[:600] = 0.0
    duration = 2_800
    pcm = table("clip_id int, i bigint, x double", [(1, i, float(v)) for i, v in enumerate(x)])
    clips = table("clip_id int, duration_ms bigint", [(1, duration), (2, 700)])
    got = {(r.clip_id, r.start_ms): r for r in A.audio_windows(pcm, clips, rate, hop, window).collect()}
    for s in range(0, duration, hop):
        part = x[int(s * rate / 1000):int(min(s + window, duration) * rate / 1000)]
        assert got[1, s].rms_dbfs == pytest.approx(20 * np.log10(np.sqrt(np.mean(part**2)) + 1e-12), abs=1e-9)
        assert got[1, s].flux == pytest.approx(naive_flux(part), rel=1e-9) and got[1, s].onset == got[1, s].flux
    assert got[2, 0].rms_dbfs == -120.0 and got[2, 0].flux == 0.0


def test_masked_flow_statistics(spark, table):
    rng = np.random.default_rng(5)
    vec = [(p, y, x, float(rng.normal(1, 1)), float(rng.normal(0, 1)), float(rng.random() * 10)) for p in (1, 2) for y in range(12) for x in range(16)]
    vec.append((1, 0, 0, float("nan"), 0.0, 9.0))
    boxes = [(1, 0.2, 0.1, 0.55, 0.6), (1, 0.5, 0.5, 0.9, 0.95)]
    v = table("pair_id int, row_i int, col_i int, dx double, dy double, gradient double", vec)
    b = table("pair_id int, x_min double, y_min double, x_max double, y_max double", boxes)
    totals = v.groupBy("pair_id").agg(F.count("*").alias("cell_count"), F.lit(160).alias("dt_ms"))
    got = {r.pair_id: r for r in M.flow_statistics(M.outside_boxes(v, b, 12, 16), totals, 12, 16).collect()}
    for p in (1, 2):
        mask = np.zeros((12, 16), bool)
        for q, x0, y0, x1, y1 in boxes:
            if q == p:
                mask[int(y0 * 12):int(np.ceil(y1 * 12)), int(x0 * 16):int(np.ceil(x1 * 16))] = True
        keep = [r for r in vec if r[0] == p and r[5] >= 2 and np.isfinite(r[3]) and not mask[r[1], r[2]]]
        dx, dy = np.array([r[3] for r in keep]), np.array([r[4] for r in keep])
        scale = np.hypot(16, 12) * 0.16
        res = np.hypot(dx - np.median(dx), dy - np.median(dy))
        assert got[p].global_magnitude == pytest.approx(np.hypot(np.median(dx), np.median(dy)) / scale)
        assert got[p].residual_median == pytest.approx(np.median(res) / scale) and got[p].residual_p90 == pytest.approx(np.percentile(res, 90) / scale)
        assert got[p].valid_ratio == pytest.approx(len(keep) / sum(r[0] == p for r in vec))


def test_pixel_spread_matches_index_rule(spark, table):
    n, cap = 997, 100
    px = table("shot_id int, row_i int, k int", [(1, i // 50, i) for i in range(n)] + [(2, 0, i) for i in range(30)])
    got = {}
    for r in C.spread_pixels(px, "shot_id", ["row_i", "k"], F.col("row_i"), cap).collect():
        got.setdefault(r.shot_id, set()).add(r.k)
    assert got[1] == set((np.arange(cap) * (n / cap)).astype(int)) and len(got[2]) == 30


def test_palette_rows_keep_the_contract(spark, table):
    rows = [(s, RNG.random() * 100, RNG.uniform(-60, 60), RNG.uniform(-60, 60)) for s in (1, 2) for _ in range(300)]
    out = C.palette(table("shot_id int, lstar double, a_star double, b_star double", rows).withColumn("n", F.lit(1).cast("bigint")))
    by = {}
    for r in out.orderBy("shot_id", "rank").collect():
        by.setdefault(r.shot_id, []).append(r)
    for sw in by.values():
        assert [r["rank"] for r in sw] == list(range(1, len(sw) + 1)) and len(sw) <= 5
        assert abs(sum(r.proportion for r in sw) - 1) < 1e-9 and sum(r.n for r in sw) == 300
        assert [(-r.n, r.hex) for r in sw] == sorted((-r.n, r.hex) for r in sw)


def test_cluster_finds_separate_groups(spark, table):
    spots = [(20.0, 0.0, 0.0), (60.0, 40.0, 0.0), (80.0, 0.0, -50.0)]
    rows = [(1, *(c + RNG.uniform(-0.5, 0.5) for c in spots[i % 3])) for i in range(300)]
    got = sorted((round(r.lstar / 20) * 20, r.n) for r in C.palette_centres(table("shot_id int, lstar double, a_star double, b_star double", rows).withColumn("n", F.lit(1).cast("bigint")), clusters=3).collect())
    assert got == [(20, 100), (60, 100), (80, 100)]


@pytest.mark.parametrize("rows", [
    [(1, i // 3, i) for i in range(200)], [(1, 7, i) for i in range(200)], [(1, None if i % 2 else 5, i) for i in range(120)],
    [(1, 10 ** 17 + i, i) for i in range(90)], [(1, 0 if i else 10 ** 9, i) for i in range(100)] + [(2, 3, 1), (3, None, 2)]])
def test_one_crowded_chunk_is_cut_and_gives_the_same(spark, table, monkeypatch, rows):
    """All rows of a key in one chunk: cut finer where counted as large, with the results of a plain sort."""
    monkeypatch.setattr(O, "CHUNK_ROWS", 10)
    monkeypatch.setattr(O, "SMALL_BYTES", 0)
    df = table("k int, t bigint, ord bigint, mark int", [(k, t, o, o if o % 9 == 4 else None) for k, t, o in rows])
    chunk, order = F.lit(0), ["t", "ord"]
    plain = {}
    for k, t, o in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        plain.setdefault(k, []).append((t, o))
    number = {(r.k, r.t, r.ord): (r.rn, r.n) for r in O.with_row_number(df, ["k"], order, chunk, "rn", "n").collect()}
    before = {(r.k, r.t, r.ord): r.prev and r.prev.ord for r in O.with_previous(df, ["k"], order, chunk, ["ord"]).collect()}
    after = {(r.k, r.t, r.ord): r.seen for r in O.with_next_marked(df, ["k"], order, chunk, "mark", "seen").collect()}
    for k, line in plain.items():
        for i, (t, o) in enumerate(line):
            assert number[k, t, o] == (i, len(line))
            assert before[k, t, o] == (line[i - 1][1] if i else None)
            assert after[k, t, o] == next((x for _, x in line[i:] if x % 9 == 4), None)
    if rows[0][1] == 0 or rows[-1][1] == 7:
        sizes = [r["count"] for r in O._chunked(df, ["k"], order, chunk).groupBy("k", "_chunk").count().collect()]
        assert max(sizes) <= 20 < len(rows)
