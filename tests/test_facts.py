"""Known facts about the operators, on tables small enough to read."""

import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from filmgrain.config import DEFAULT_CONFIG, Critic, Framing, Shots, Spatial, Tension, TensionWeights
from filmgrain.functions.geometry import framing_label, proximity
from filmgrain.functions.identity import stable_uuid
from filmgrain.functions.numeric import clip01, frame_duration_ms, round_decimal
from filmgrain.operators import colour as C, motion as M, report as R, sampling as P, shots as S, spatial as X, text as W, timeline as T
from filmgrain.operators.media import display_name


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- settings and identity -------------------------------------------------------

def test_config_hashes():
    assert DEFAULT_CONFIG.hash() == "66dced8dd50901cdfea31549d1395668fcca7bbc425288c3b705fe342d6304b7"
    assert replace(DEFAULT_CONFIG, critic=Critic(True)).hash().startswith("634e30fd")
    assert replace(DEFAULT_CONFIG, shots=Shots(min_shot_ms=400)).hash().startswith("8694a697")


def test_config_problems():
    bad = replace(DEFAULT_CONFIG, tension=Tension(TensionWeights(0.5, 0.5, 0.5)), spatial=Spatial(framing_rules=Framing(wide_height_max=0.1)))
    assert bad.problems() == ["tension_weights_sum", "framing_thresholds_order"]


def test_stable_uuid_is_rfc_4122(spark, table):
    rows = table("a string, n int", [(f"clip-{i}é", i) for i in range(50)])
    for r in rows.select("a", "n", stable_uuid(F.col("a"), "shot", F.col("n")).alias("id")).collect():
        assert r["id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r['a']}\0shot\0{r['n']}"))


@pytest.mark.parametrize("value,digits", [(0.575, 2), (2.675, 2), (0.125, 2), (0.165, 2), (1.005, 2), (33.35, 1), (0.5, 0), (12.5, 0), (7.0, 2)])
def test_round_decimal_matches_exact_rounding(spark, value, digits):
    assert one(spark, round_decimal(F.lit(value), digits)) == round(value, digits)


@pytest.mark.parametrize("num,den,ms", [(25, 1, 40), (1, 1, 1000), (30000, 1001, 33), (5000, 1, 1)])
def test_frame_duration(spark, num, den, ms):
    assert one(spark, frame_duration_ms(F.lit(num), F.lit(den))) == ms


@pytest.mark.parametrize("raw,name", [("a/b.mp4", "b.mp4"), ("a/b/", "b"), (".", "upload"), ("..", "upload"), ("", "upload"), ("x\ty\\z", "x_y_z"), ("q" * 600, "q" * 512), ("a/.", "a")])
def test_display_name(spark, raw, name):
    assert one(spark, display_name(F.lit(raw))) == name


# --- timeline ---------------------------------------------------------------------

def test_hop_starts(spark, table):
    clips = table("clip_id int, duration_ms bigint", [(1, 4200), (2, 4000), (3, 499), (4, 0)])
    got = {}
    for r in T.hop_starts(clips, 500).collect():
        got.setdefault(r.clip_id, []).append(r.at_ms)
    assert sorted(got[1]) == list(range(0, 4001, 500)) and max(got[2]) == 3500 and got[3] == [0] and 4 not in got
    assert T.hop_starts(clips, 0).count() == 0


def test_boundary_instant_belongs_to_later_shot(spark, table):
    shots = table("clip_id int, shot_index bigint, start_ms bigint, end_ms bigint", [(1, 0, 0, 2000), (1, 1, 2000, 4000)])
    points = table("clip_id int, at_ms bigint", [(1, 1999), (1, 2000), (1, 5000)])
    assert {r.at_ms: r.shot_index for r in S.assign_shots(points, shots).collect()} == {1999: 0, 2000: 1, 5000: 1}


def test_clip01_blanks_what_is_not_finite(spark):
    for x in (float("nan"), float("inf"), float("-inf")):
        assert one(spark, clip01(F.lit(x))) == 0.0
    assert one(spark, clip01(F.lit(None).cast("double"))) == 0.0 and one(spark, clip01(F.lit(1.5))) == 1.0


def test_constant_series_normalises_to_zero(spark, table):
    rows = table("clip_id int, at_ms bigint, v double", [(1, i, 0.7) for i in range(5)])
    assert {r.v_norm for r in T.robust_normalise(rows, ["v"]).collect()} == {0.0}


def test_weights_fall_back_to_cuts(spark):
    w = T.effective_weights(F.lit(False), F.lit(False), TensionWeights(0.0, 0.5, 0.5))
    r = spark.range(1).select(*[c.alias(k) for k, c in w.items()]).first()
    assert (r.weight_cut, r.weight_audio, r.weight_motion) == (1.0, 0.0, 0.0)
    assert r.weight_warnings == [T.AUDIO_MISSING, T.MOTION_MISSING]


def test_plateau_keeps_first_and_flat_zero_keeps_one(spark, table):
    rows = table("clip_id int, at_ms bigint, combined_proxy double",
                 [(1, 0, 0.2), (1, 500, 0.8), (1, 1000, 0.8), (1, 1500, 0.1)] + [(2, i * 500, 0.0) for i in range(4)])
    assert sorted((r.clip_id, r.at_ms) for r in T.peaks(rows).collect()) == [(1, 500), (2, 0)]


def test_thinning_keeps_both_ends(spark, table):
    rows = table("clip_id int, at_ms bigint", [(1, i * 500) for i in range(20)])
    want = sorted({round(i * 19 / 4) * 500 for i in range(5)})
    assert sorted(r.at_ms for r in T.thin(rows, 0, 10_000, 5).collect()) == want
    assert [r.at_ms for r in T.thin(rows, 0, 10_000, 1).collect()] == [0]
    assert T.thin(rows, 0, 10_000, 50).count() == 20


def test_motion_falls_back_to_nearest_then_zero(spark, table):
    points = table("clip_id int, at_ms bigint, shot_index bigint", [(1, 0, 0), (1, 500, 0), (1, 1000, 0), (1, 1500, 1)])
    pairs = table("clip_id int, shot_index bigint, at_ms bigint, ord bigint, global_magnitude double, residual_magnitude double",
                  [(1, 0, 100, 0, 1.0, 2.0), (1, 0, 300, 1, 3.0, 4.0), (1, 0, 1400, 3, 9.0, 9.0), (1, 0, 1400, 2, 8.0, 8.0)])
    got = {r.at_ms: (r.global_raw, r.residual_raw) for r in T.motion_at(points, pairs, 500).collect()}
    assert got == {0: (2.0, 3.0), 500: (3.0, 4.0), 1000: (8.5, 8.5), 1500: (0.0, 0.0)}


# --- sampling -----------------------------------------------------------------------

def test_single_colour_sample_is_the_middle(spark, table):
    shots = table("clip_id string, shot_index bigint, start_ms bigint, end_ms bigint, shot_id string", [("c", 0, 0, 4000, "s")])
    cfg = replace(DEFAULT_CONFIG, chromatic=replace(DEFAULT_CONFIG.chromatic, samples_per_shot=1))
    t = P.sample_targets(shots, F.lit(40).cast("bigint"), cfg).where("purpose_rank = 0").collect()
    assert [r.requested_ms for r in t] == [2000]


def test_plan_merges_purposes_in_order(spark, table):
    shots = table("clip_id string, shot_index bigint, start_ms bigint, end_ms bigint, shot_id string", [("c", 0, 0, 4000, "s")])
    plan = P.sampling_plan(P.sample_targets(shots, F.lit(40).cast("bigint"))).orderBy("ord").collect()
    assert [r.ord for r in plan] == list(range(len(plan)))
    assert [r.requested_ms for r in plan] == sorted({r.requested_ms for r in plan})
    assert {r.requested_ms: r.purposes for r in plan}[2000] == ["CHROMATIC", "EVIDENCE"]


# --- motion --------------------------------------------------------------------------

def test_repeated_instant_gives_one_pair(spark, table):
    f = table("clip_id int, shot_index int, ord bigint, sample_id string, decoded_ms bigint", [(1, 0, 0, "a", 1000), (1, 0, 1, "b", 1000), (1, 0, 2, "c", 1160)])
    (r,) = M.adjacent_pairs(f).collect()
    assert (r.sample_id_a, r.sample_id_b, r.dt_ms, r.at_ms) == ("b", "c", 160, 1080)


PAIRS = ("clip_id int, shot_index int, at_ms bigint, ord bigint, global_dx double, global_dy double, global_magnitude double, "
         "residual_median double, residual_p90 double, valid_ratio double, flagged boolean")


def test_flagged_pair_counts_only_in_valid_ratio(spark, table):
    p = table(PAIRS, [(1, 0, 0, 0, 1.0, 0.0, 0.1, 0.2, 0.3, 1.0, False), (1, 0, 9, 1, 1.0, 0.0, 9.0, 9.0, 9.0, 0.0, True)])
    shots = table("clip_id int, shot_index int, start_ms bigint, end_ms bigint", [(1, 0, 0, 10), (1, 1, 10, 20)])
    got = {r.shot_index: r for r in M.shot_motion(shots, p).collect()}
    assert (got[0].global_motion_magnitude, got[0].flow_valid_ratio, got[0].flagged_discontinuity) == (0.1, 0.5, True)
    assert got[1].global_motion_magnitude is None and got[1].flagged_discontinuity is False


@pytest.mark.parametrize("dx,want", [((1.0, 1.0), 1.0), ((1.0, 0.0), 0.0), ((1.0, -1.0), 0.0)])
def test_direction_consistency(spark, table, dx, want):
    p = table(PAIRS, [(1, 0, i, i, x, 0.0, 0.0, 0.0, 0.0, 1.0, False) for i, x in enumerate(dx)])
    assert M.direction_consistency(p).first().direction_consistency == want


# --- spatial ---------------------------------------------------------------------------

HITS = "shot_id int, sample_ord bigint, hit_ord bigint, class_name string, confidence double, x_min double, y_min double, x_max double, y_max double"


def test_tracker_survives_gaps_and_resets_per_shot(spark, table):
    box, far = (0.1, 0.1, 0.4, 0.4), (0.6, 0.6, 0.9, 0.9)
    rows = [(1, 0, 0, "person", 0.9, *box), (1, 1, 0, "person", 0.9, *far), (1, 3, 0, "person", 0.9, *box), (1, 3, 1, "cat", 0.9, *box),
            (1, 4, 0, "person", 0.1, *box), (2, 0, 0, "person", 0.9, *box)]
    got = sorted((r.shot_id, r.sample_ord, r.track_id) for r in X.track_subjects(table(HITS, rows)).collect())
    assert got == [(1, 0, "t0001"), (1, 1, "t0002"), (1, 3, "t0001"), (2, 0, "t0001")]


def test_coverage_beats_a_brief_large_box_and_ties_go_low(spark, table):
    obs = [(1, i, 0, "t0002", 0.8, 0.1, 0.1, 0.3, 0.3) for i in range(4)] + [(1, 0, 1, "t0001", 0.8, 0.0, 0.0, 1.0, 1.0)]
    obs += [(2, i, j, t, 0.8, 0.1, 0.1, 0.3, 0.3) for i in range(4) for j, t in enumerate(("t0001", "t0002"))]
    obs += [(3, 0, 0, "t0001", 0.8, 0.1, 0.1, 0.3, 0.3)]
    df = table("shot_id int, sample_ord bigint, hit_ord bigint, track_id string, confidence double, x_min double, y_min double, x_max double, y_max double", obs)
    counts = table("shot_id int, sample_count bigint", [(1, 4), (2, 4), (3, 4)])
    assert {r.shot_id: r.track_id for r in X.primary_tracks(df, counts).collect()} == {1: "t0002", 2: "t0001"}


@pytest.mark.parametrize("y0,y1,label", [
    (0.4, 0.5, "EXTREME_WIDE_ESTIMATE"), (0.3, 0.58, "WIDE_ESTIMATE"), (0.2, 0.7, "MEDIUM_ESTIMATE"), (0.1, 0.82, "CLOSE_UP_ESTIMATE"),
    (0.05, 0.97, "EXTREME_CLOSE_UP_ESTIMATE"), (0.0, 0.99, "EXTREME_CLOSE_UP_ESTIMATE"), (0.5, 0.88, "MEDIUM_ESTIMATE")])
def test_framing_calibration(spark, table, y0, y1, label):
    df = table("x_min double, y_min double, x_max double, y_max double", [(0.4, y0, 0.6, y1)])
    assert df.select(framing_label(Framing()).alias("x")).first().x == label


def test_split_votes_are_undetermined(spark, table):
    rows = [(1, "t", 0.9, 0.4, y0, 0.6, y1) for y0, y1 in ((0.3, 0.58), (0.1, 0.82)) for _ in range(3)]
    df = table("shot_id int, track_id string, confidence double, x_min double, y_min double, x_max double, y_max double", rows)
    assert X.framing_votes(df, ["shot_id", "track_id"]).first().framing == "UNDETERMINED"


def test_proximity_without_width_is_zero(spark):
    assert one(spark, proximity(F.lit(0.0), 0.0)) == 0.0 and one(spark, proximity(F.lit(0.0), 0.18)) == 1.0


def test_unknown_backend_leaves_shots_uncomputed(spark, table):
    shots = table("shot_id int", [(1,), (2,)])
    got = X.spatial_measurements(shots, table(HITS, []), table("shot_id int, sample_count bigint", []), Spatial())
    assert {(r.status, r.reason_code) for r in got.collect()} == {("NOT_COMPUTED", "detector_not_installed")}


def test_every_shot_gets_a_spatial_status(spark, table):
    shots, counts = table("shot_id int", [(1,), (2,), (3,)]), table("shot_id int, sample_count bigint", [(1, 2), (2, 2)])
    hits = table(HITS, [(1, i, 0, "person", 0.9, 0.2, 0.2, 0.5, 0.7) for i in range(2)])
    got = {r.shot_id: (r.status, r.reason_code, r.framing) for r in X.spatial_measurements(shots, hits, counts, Spatial(backend="fake")).collect()}
    assert got == {1: ("OK", None, "MEDIUM_ESTIMATE"), 2: ("NO_SUBJECT", "spatial_no_subject", None), 3: ("INSUFFICIENT_DATA", "spatial_no_decoded_samples", None)}


# --- colour -----------------------------------------------------------------------------

def frame(paint, height=20, width=20):
    return [(1, 0, y, x, *paint(y, x)) for y in range(height) for x in range(width)]


PX = "shot_id int, frame_ord int, row_i int, col_i int, r int, g int, b int"


def colour(table, paint, **kw):
    shots = table("shot_id int, requested_frames int", [(1, 1)])
    values, swatches = C.shot_colour(table(PX, frame(paint, **kw)), ["shot_id", "frame_ord"], shots)
    return values.first(), swatches.orderBy("rank").collect()


def test_white_is_high_key(spark, table):
    v, s = colour(table, lambda y, x: (255, 255, 255))
    assert v.status == "OK" and v.lighting_key == "HIGH_KEY_ESTIMATE" and len(s) == 1 and s[0].hex == "#FFFFFF"


def test_red_blue_mix_shares(spark, table):
    v, s = colour(table, lambda y, x: (255, 0, 0) if x < 16 else (0, 0, 255))
    assert [r.hex for r in s] == ["#FF0000", "#0000FF"] and abs(s[0].proportion - 0.8) < 1e-9 and abs(sum(r.proportion for r in s) - 1) < 1e-12


def test_letterbox_share(spark, table):
    v, s = colour(table, lambda y, x: (0, 160, 0) if 4 <= y < 16 else (0, 0, 0))
    assert v.usable_pixel_ratio == 0.6 and [r.hex for r in s] == ["#00A000"]


def test_all_black_is_insufficient(spark, table):
    v, s = colour(table, lambda y, x: (0, 0, 0))
    assert (v.status, v.reason_code, s) == ("INSUFFICIENT_DATA", "chromatic_letterbox_insufficient", [])


def test_close_colours_merge(spark, table):
    v, s = colour(table, lambda y, x: [(200, 30, 30), (201, 30, 30), (30, 30, 200)][x % 3])
    assert len(s) == 2


def test_refused_shot_has_neither_values_nor_swatches(spark, table):
    v, s = colour(table, lambda y, x: (200, 0, 0) if y == 9 and 6 <= x < 14 else (0, 0, 0))
    assert (v.status, v.reason_code, v.usable_pixel_ratio) == ("INSUFFICIENT_DATA", "chromatic_letterbox_insufficient", 0.02)
    assert (v.mean_lstar, v.p50_lstar, v.shadow_ratio, v.lighting_key, v.confidence, s) == (None, None, None, None, None, [])


def test_shots_without_pixels_keep_a_row(spark, table):
    shots = table("shot_id int, requested_frames int", [(1, 1), (2, 3), (3, 0)])
    values, swatches = C.shot_colour(table(PX, frame(lambda y, x: (9, 99, 200))), ["shot_id", "frame_ord"], shots)
    assert {r.shot_id: (r.status, r.reason_code) for r in values.collect()} == {
        1: ("OK", None), 2: ("FAILED", "chromatic_decode_failed"), 3: ("INSUFFICIENT_DATA", "chromatic_no_decoded_samples")}
    assert [r.shot_id for r in swatches.collect()] == [1]


def test_every_pixel_of_a_large_shot_counts(spark):
    """60,000 pixels, past any sample: one pixel in 1,000 differs, at the places a systematic sample would skip."""
    n, k = 60_000, F.col("id")
    odd = k % 1000 == 3
    px = spark.range(n).select(F.lit(1).alias("shot_id"), F.lit(0).alias("frame_ord"), (k / 300).cast("int").alias("row_i"), (k % 300).cast("int").alias("col_i"),
                               F.when(odd, 255).otherwise(90).alias("r"), F.when(odd, 255).otherwise(90).alias("g"), F.when(odd, 255).otherwise(90).alias("b"))
    values, swatches = C.shot_colour(px, ["shot_id", "frame_ord"], spark.createDataFrame([(1, 1)], "shot_id int, requested_frames int"))
    v = values.first()
    assert v.kept_pixels == n and abs(v.highlight_ratio - 60 / n) < 1e-12
    assert sum(r.n for r in swatches.collect()) == n - 60  # the odd ones are under the swatch floor
    tones = C.colour_counts(px).orderBy("n").collect()
    mean = sum(t.n * t.lstar for t in tones) / n
    assert abs(v.mean_lstar - mean) < 1e-9 and abs(v.stddev_lstar - (sum(t.n * (t.lstar - mean) ** 2 for t in tones) / n) ** 0.5) < 1e-6


def test_equal_hex_keeps_the_accumulated_heavier(spark, table):
    rows = [(1, "#000000", 0, 10, 1.0), (1, "#000000", 1, 8, 2.0), (1, "#000000", 2, 15, 3.0), (1, "#000000", 3, 40, 4.0)]
    df = table("shot_id int, hex string, ord int, n bigint, lstar double", rows).withColumns({"a_star": F.lit(0.0), "b_star": F.lit(0.0)})
    assert [(r.n, r.lstar) for r in C.merge_equal_hex(df).collect()] == [(73, 4.0)]
    assert [(r.n, r.lstar) for r in C.merge_equal_hex(df.where("ord < 3")).collect()] == [(33, 1.0)]


def test_thin_keeps_as_many_points_as_asked(spark):
    points = spark.range(2600).select(F.lit(1).alias("clip_id"), (F.col("id") * 500).alias("at_ms"))
    assert T.thin(points, 0, 10 ** 9, 2400).count() == 2400
    assert T.thin(points, 0, 10 ** 9, 5000).count() == 2600


def test_match_cuts_is_not_quadratic(spark):
    """A clip that is one island: 8,000 cuts on each side, 150 ms apart."""
    side = lambda shift: spark.range(8000).select(F.lit(1).alias("clip_id"), (F.col("id") * 150 + shift).alias("position_ms"), F.col("id").alias("ord"))
    assert S.match_cuts(side(0), side(10)).first().recall == 1.0


# --- reports and text -----------------------------------------------------------------------

@pytest.mark.parametrize("ms,text", [(0, "00:00.000"), (61_234, "01:01.234"), (3_600_000, "01:00:00.000"), (-1, None)])
def test_timecode(spark, ms, text):
    assert one(spark, R.timecode(F.lit(ms))) == text


@pytest.mark.parametrize("text,ok", [
    ("18 shots, ASL 3.42s, median 2.8s", True), ("Colours #1A2B3C lead", True), ("99 shots", False), ("#FFFFFF leads", False),
    ("the director", False), ("a Masterpiece", False), ("file.mp4", False), ("low-key 25", True)])
def test_audit(spark, text, ok):
    facts = {k: F.lit(x) for k, x in dict(shot_count=18, asl_seconds=3.42, median_seconds=2.8, low_key_ratio=0.25,
                                          chromatic_valid_ratio=1.0, spatial_valid_ratio=0.5, median_thirds=0.6).items()}
    palette = F.array(F.lit("#1A2B3C"))
    allowed = W.allowed_numbers(facts, palette, F.array(F.lit(1.5)))
    assert (one(spark, W.audit_text(F.lit(text), allowed, palette)[0]) == "ok") is ok


def test_redaction_folds_separators(spark):
    fields = F.create_map(*[F.lit(x) for kv in {"X-Api-Key": "a", "apiKey": "b", "FILEPATH": "c", "note": "C:/x", "plain": "d", "home": "/home/me"}.items() for x in kv])
    got = one(spark, W.redact(fields))
    assert got == {"X-Api-Key": "[redacted]", "apiKey": "[redacted]", "FILEPATH": "[redacted]", "note": "[redacted]", "plain": "d", "home": "[redacted]"}


def test_command_screen(spark, table):
    good = ('{"schema_version":"1.0","analysis_id":"6ba7b810-9dad-11d1-80b4-00c04fd430c8","stage_name":"a \\"path\\": b","input_artifact_ids":[],'
            '"configuration_hash":"' + "0" * 64 + '","pipeline_version":"0.1.0","requested_at":"2024-01-01T00:00:00Z","trace_id":"t"}')
    docs = {good: "ok", "[1]": "not_an_object", "{": "not_an_object", '{"a":{"b":[{"pickle":1}]}}': "forbidden_key", '{"a":["\\u002fUsers\\/x"]}': "host_path",
            '{"a":"C:\\\\x"}': "host_path", '{"a":"' + "x" * 9000 + '"}': "too_large", '{"a":1}': "schema_invalid"}
    df = table("doc string", [(d,) for d in docs])
    assert {r.doc: r.verdict for r in W.screen_commands(df).collect()} == docs
