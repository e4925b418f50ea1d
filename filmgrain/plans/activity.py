"""Queries over the activity timeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from filmgrain.config import TensionWeights
from filmgrain.functions.numeric import clip01, dbl, r6
from filmgrain.operators import timeline as T
from filmgrain.plans.registry import query
from filmgrain.plans.sqltext import add_views, r6 as q6
from filmgrain.schemas import TIMELINE, struct
from filmgrain.session import work_folder
from filmgrain.sources.tables import read_documents
from filmgrain.views import Views

HOP = 500


def _norm(c: str) -> str:
    x = f"({c} - p_{c}[1]) / (p_{c}[2] - p_{c}[1] + 1e-6::DOUBLE)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


_RAW = ("onset_raw", "flux_raw", "level_raw", "global_raw", "residual_raw")
add_views({
    "v_point_shots": """SELECT p.*, s.shot_index FROM v_points p JOIN v_shots s
        ON p.clip_id=s.clip_id AND p.at_ms >= s.start_ms AND p.at_ms < s.end_ms""",
    "v_cut_activity": """SELECT p.clip_id, p.at_ms, least(1.0::DOUBLE,
        coalesce(sum(exp(-0.5::DOUBLE*((p.at_ms-s.start_ms)/750.0::DOUBLE)*((p.at_ms-s.start_ms)/750.0::DOUBLE))), 0)/3.0::DOUBLE) cut_activity
        FROM v_points p LEFT JOIN v_shots s ON s.clip_id=p.clip_id AND s.start_ms > 0 GROUP BY 1, 2""",
    "v_inside": """SELECT p.clip_id, p.at_ms, avg(c.global_magnitude) g, avg(c.residual_magnitude) r FROM v_point_shots p
        JOIN v_calm c ON c.clip_id=p.clip_id AND c.shot_index=p.shot_index AND c.at_ms >= p.at_ms AND c.at_ms < p.at_ms+500
        GROUP BY 1, 2""",
    "v_nearest": """SELECT clip_id, at_ms, g, r FROM (SELECT p.clip_id, p.at_ms, c.global_magnitude g, c.residual_magnitude r,
        row_number() OVER (PARTITION BY p.clip_id, p.at_ms ORDER BY abs(c.at_ms-p.at_ms), c.at_ms, c.ord) k FROM v_point_shots p
        JOIN v_calm c ON c.clip_id=p.clip_id AND c.shot_index=p.shot_index) WHERE k = 1""",
    "v_motion_at": """SELECT p.clip_id, p.at_ms, p.shot_index, coalesce(i.g, n.g, 0) global_raw, coalesce(i.r, n.r, 0) residual_raw
        FROM v_point_shots p LEFT JOIN v_inside i ON i.clip_id=p.clip_id AND i.at_ms=p.at_ms
        LEFT JOIN v_nearest n ON n.clip_id=p.clip_id AND n.at_ms=p.at_ms""",
    "v_audio_at": """SELECT p.clip_id, p.at_ms, coalesce(a.onset, 0) onset_raw, coalesce(a.flux, 0) flux_raw,
        coalesce(pow(10.0::DOUBLE, a.rms_dbfs/20.0::DOUBLE), 0) level_raw
        FROM v_points p LEFT JOIN v_audio a ON a.clip_id=p.clip_id AND a.start_ms=p.at_ms""",
    "v_raw": """SELECT m.*, a.onset_raw, a.flux_raw, a.level_raw FROM v_motion_at m
        JOIN v_audio_at a ON a.clip_id=m.clip_id AND a.at_ms=m.at_ms""",
    "v_ends": "SELECT clip_id, " + ", ".join(f"quantile_cont({c}, [0.1, 0.9]) p_{c}" for c in _RAW) + " FROM v_raw GROUP BY 1",
    "v_normed": "SELECT r.clip_id, r.at_ms, r.shot_index, " + ", ".join(f"{_norm(c)} {c}_norm" for c in _RAW)
        + " FROM v_raw r JOIN v_ends e ON e.clip_id=r.clip_id",
    "v_weights": """SELECT clip_id, audio_available, motion_available, 0.35::DOUBLE/t weight_cut,
        CASE WHEN audio_available THEN 0.30::DOUBLE/t ELSE 0 END weight_audio,
        CASE WHEN motion_available THEN 0.35::DOUBLE/t ELSE 0 END weight_motion FROM (SELECT *, 0.35::DOUBLE
        + CASE WHEN audio_available THEN 0.30::DOUBLE ELSE 0 END + CASE WHEN motion_available THEN 0.35::DOUBLE ELSE 0 END t FROM v_clips)""",
    "v_acts": """SELECT n.clip_id, n.at_ms, n.shot_index, c.cut_activity,
        CASE WHEN w.audio_available THEN (onset_raw_norm+flux_raw_norm+level_raw_norm)/3 ELSE 0 END audio_activity,
        CASE WHEN w.motion_available THEN (global_raw_norm+residual_raw_norm)/2 ELSE 0 END motion_activity,
        w.weight_cut, w.weight_audio, w.weight_motion
        FROM v_normed n JOIN v_cut_activity c ON c.clip_id=n.clip_id AND c.at_ms=n.at_ms JOIN v_weights w ON w.clip_id=n.clip_id""",
    "v_timeline": """SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
        weight_cut*cut_activity + weight_audio*audio_activity + weight_motion*motion_activity)) combined_proxy FROM v_acts""",
    "v_simple": """SELECT user_id clip_id, CAST(floor((epoch(ts)-1704067200)/10) AS BIGINT)//500*500 at_ms,
        round(least(avg(value)/100, 1), 9) combined_proxy FROM events GROUP BY 1, 2""",
    "v_peaks": """SELECT clip_id, at_ms, combined_proxy FROM (
        SELECT *, (v >= l AND v >= r AND v > 0 AND NOT (has_l AND abs(l-v) <= 1e-9*greatest(abs(l), abs(v)))) pk FROM (
        SELECT *, combined_proxy v, coalesce(lag(combined_proxy) OVER w, -1) l, coalesce(lead(combined_proxy) OVER w, -1) r,
        lag(combined_proxy) OVER w IS NOT NULL has_l,
        row_number() OVER (PARTITION BY clip_id ORDER BY combined_proxy DESC, at_ms) best
        FROM v_simple WINDOW w AS (PARTITION BY clip_id ORDER BY at_ms)))
        QUALIFY pk OR (NOT bool_or(pk) OVER (PARTITION BY clip_id) AND best = 1)""",
})


def _timeline(v: Views):
    clips = v.clips().withColumns({
        "audio_reason": F.when(~F.col("audio_available"), F.lit(T.NO_AUDIO)),
        "extra_warnings": F.when(F.pmod("clip_id", F.lit(5)) == 0, F.array(F.lit("cut_like_flow_discontinuity"))).otherwise(F.array().cast("array<string>"))})
    return T.build_timeline(clips, v.shots_once(), v.calm_series(), v.audio())


def _simple(v: Views):
    """One value per clip and hop straight from the events, for the reading operators."""
    e = v.scores().withColumn("at_ms", F.floor(F.col("at_ms") / HOP).cast("bigint") * HOP)
    return e.groupBy("clip_id", "at_ms").agg(
        F.round(F.least(F.avg("score") / dbl(100), dbl(1)), 9).alias("combined_proxy"))


@query("wn12_hop_starts", "SELECT clip_id, at_ms FROM v_points")
def wn12(v):
    return T.hop_starts(v.clips(), HOP)


@query("jn03_cut_activity", f"SELECT clip_id, at_ms, {q6('cut_activity', 'cut_activity')} FROM v_cut_activity")
def jn03(v):
    out = T.cut_activity(T.hop_starts(v.clips(), HOP), v.shots())
    return out.select("clip_id", "at_ms", r6(F.col("cut_activity")).alias("cut_activity"))


# One pass over sorted cuts a clip in place of the recursive view, and nearest pairs by two as-of joins.
@query("jn04_motion_at_hop", f"""
WITH folded AS (SELECT c.clip_id, list_reduce([[0::BIGINT]] || coalesce(list_transform(ps, lambda x: [x]), []), lambda a, x: CASE WHEN x[1] - a[len(a)] >= 10000 THEN a || x ELSE a END) ks
  FROM v_clips c LEFT JOIN (SELECT clip_id, list(position_ms ORDER BY position_ms) ps FROM v_cuts GROUP BY 1) p ON p.clip_id=c.clip_id),
starts AS (SELECT clip_id, unnest(ks) start_ms, unnest(range(0, len(ks))) shot_index FROM (SELECT clip_id, CASE WHEN len(ks) > 1 AND 259200 - ks[len(ks)] < 10000 THEN ks[:len(ks)-1] ELSE ks END ks FROM folded)),
p AS (SELECT p.clip_id, p.at_ms, s.shot_index FROM v_points p ASOF JOIN starts s ON p.clip_id=s.clip_id AND p.at_ms >= s.start_ms),
c AS (SELECT f.clip_id, s.shot_index, f.at_ms, f.ord, f.global_magnitude g, f.residual_median r FROM v_flow_pairs f ASOF JOIN starts s ON f.clip_id=s.clip_id AND f.at_ms >= s.start_ms WHERE NOT f.flagged AND f.at_ms < 259200),
i AS (SELECT clip_id, shot_index, at_ms//500*500 at_ms, avg(g) g, avg(r) r FROM c GROUP BY ALL),
o AS (SELECT clip_id, shot_index, at_ms, arg_min(g, ord) g, arg_min(r, ord) r FROM c GROUP BY 1, 2, 3),
b AS (SELECT p.*, o.at_ms back, o.g bg, o.r br FROM p ASOF LEFT JOIN o ON o.clip_id=p.clip_id AND o.shot_index=p.shot_index AND p.at_ms >= o.at_ms),
n AS (SELECT b.*, o.at_ms ahead, o.g ag, o.r ar FROM b ASOF LEFT JOIN o ON o.clip_id=b.clip_id AND o.shot_index=b.shot_index AND b.at_ms <= o.at_ms),
m AS (SELECT *, back IS NOT NULL AND (ahead IS NULL OR at_ms - back <= ahead - at_ms) AS behind FROM n)
SELECT m.clip_id, m.at_ms, m.shot_index, {q6('coalesce(i.g, CASE WHEN behind THEN bg ELSE ag END, 0)', 'global_raw')}, {q6('coalesce(i.r, CASE WHEN behind THEN br ELSE ar END, 0)', 'residual_raw')}
FROM m LEFT JOIN i ON i.clip_id=m.clip_id AND i.shot_index=m.shot_index AND i.at_ms=m.at_ms""")
def jn04(v):
    out = T.align(T.hop_starts(v.clips(), HOP), HOP, shots=v.shots_once(), pairs=v.calm_series())
    return out.select("clip_id", "at_ms", "shot_index", r6(F.col("global_raw")).alias("global_raw"),
                      r6(F.col("residual_raw")).alias("residual_raw"))


@query("jn05_audio_at_hop",
       f"SELECT clip_id, at_ms, {q6('onset_raw', 'onset_raw')}, {q6('flux_raw', 'flux_raw')}, {q6('level_raw', 'level_raw')} FROM v_audio_at")
def jn05(v):
    out = T.audio_at(T.hop_starts(v.clips(), HOP), v.audio())
    return out.select("clip_id", "at_ms", *[r6(F.col(c)).alias(c) for c in _RAW[:3]])


@query("wn13_robust_normalise", f"""
WITH e AS (SELECT clip_id, quantile_cont(onset_raw, [0.1, 0.9]) p_onset_raw, quantile_cont(flux_raw, [0.1, 0.9]) p_flux_raw
  FROM v_audio_at GROUP BY 1)
SELECT a.clip_id, at_ms, {q6(_norm('onset_raw'), 'onset_raw_norm')}, {q6(_norm('flux_raw'), 'flux_raw_norm')}
FROM v_audio_at a JOIN e ON e.clip_id=a.clip_id""")
def wn13(v):
    out = T.robust_normalise(T.audio_at(T.hop_starts(v.clips(), HOP), v.audio()), ["onset_raw", "flux_raw"])
    return out.select("clip_id", "at_ms", r6(F.col("onset_raw_norm")).alias("onset_raw_norm"),
                      r6(F.col("flux_raw_norm")).alias("flux_raw_norm"))


@query("wn14_activities",
       f"SELECT clip_id, at_ms, {q6('audio_activity', 'audio_activity')}, {q6('motion_activity', 'motion_activity')} FROM v_acts")
def wn14(v):
    points = T.hop_starts(v.clips(), HOP, ("audio_available", "motion_available"))
    out = T.activities(T.align(points, HOP, shots=v.shots_once(), pairs=v.calm_series(), windows=v.audio()))
    return out.select("clip_id", "at_ms", r6(F.col("audio_activity")).alias("audio_activity"),
                      r6(F.col("motion_activity")).alias("motion_activity"))


_TL = ("cut_activity", "audio_activity", "motion_activity", "combined_proxy", "weight_cut", "weight_audio", "weight_motion")


@query("wn15_timeline", f"SELECT clip_id, at_ms, shot_index, {', '.join(q6(c, c) for c in _TL)} FROM v_timeline")
def wn15(v):
    return _timeline(v).select("clip_id", "at_ms", "shot_index", *[r6(F.col(c)).alias(c) for c in _TL])


@query("wn15_timeline_warnings", """
SELECT clip_id, array_to_string(CASE WHEN audio_available THEN [] ELSE ['no_audio_stream'] END || ['cut_like_flow_discontinuity'] ||
 CASE WHEN audio_available THEN [] ELSE ['audio_unavailable_weights_renormalized'] END ||
 CASE WHEN motion_available THEN [] ELSE ['motion_unavailable_weights_renormalized'] END, ',') warnings FROM v_clips""")
def wn15_warnings(v):
    w = T.effective_weights(F.col("audio_available"), F.col("motion_available"), TensionWeights())
    extra = F.array(F.lit("cut_like_flow_discontinuity"), F.lit("cut_like_flow_discontinuity"))
    reason = F.when(~F.col("audio_available"), F.lit(T.NO_AUDIO))
    return v.clips().select(
        "clip_id", F.array_join(T.merge_warnings(extra, w["weight_warnings"], reason), ",").alias("warnings"))


@query("wn16_peaks", "SELECT clip_id, at_ms, combined_proxy FROM v_peaks")
def wn16(v):
    return T.peaks(_simple(v))


@query("wn17_timeline_summary", f"""
SELECT s.clip_id, s.n point_count, p.n peak_count, p.first_peak, {q6('p.top', 'top_peak')}, 'w' warnings, 500 hop_ms, 1000 window_ms, 'tension-v1' method_version,
 0.35::DOUBLE weight_motion, 0.0::DOUBLE used_motion FROM
(SELECT clip_id, count(*) n FROM v_simple GROUP BY 1) s JOIN
(SELECT clip_id, count(*) n, min(at_ms) first_peak, max(combined_proxy) top FROM v_peaks GROUP BY 1) p USING (clip_id)""")
def wn17(v):
    zero = dbl(0)
    points = _simple(v).withColumns({c: zero for c in _TL if c != "combined_proxy"}).withColumn(
        "warnings", F.array(F.lit("w")))
    s = T.timeline_summary(points)
    return s.select("clip_id", "point_count", F.size("peaks").cast("bigint").alias("peak_count"),
                    F.col("peaks")[0]["at_ms"].alias("first_peak"),
                    r6(F.array_max(F.col("peaks.combined_proxy"))).alias("top_peak"), F.array_join("warnings", ",").alias("warnings"), "hop_ms", "window_ms", "method_version",
                    F.col("weights.motion").alias("weight_motion"), F.col("effective_weights.motion").alias("used_motion"))


@query("wn15_timeline_documents", f"""
SELECT CAST(t.clip_id AS VARCHAR) analysis_id, 500 hop_ms, 1000 window_ms, {q6('weight_audio', 'used_audio')}, t.at_ms, shot_index, {q6('combined_proxy', 'combined_proxy')}, {q6('a.rms_dbfs', 'rms_dbfs')}, {q6('a.onset', 'onset')}, {q6('a.flux', 'flux')},
 array_to_string(CASE WHEN audio_available THEN [] ELSE ['no_audio_stream'] END || CASE WHEN t.clip_id%5=0 THEN ['cut_like_flow_discontinuity'] ELSE [] END ||
 CASE WHEN audio_available THEN [] ELSE ['audio_unavailable_weights_renormalized'] END || CASE WHEN motion_available THEN [] ELSE ['motion_unavailable_weights_renormalized'] END, ',') warnings
FROM v_timeline t JOIN v_clips c ON c.clip_id=t.clip_id LEFT JOIN v_audio a ON a.clip_id=t.clip_id AND a.start_ms=t.at_ms""")
def wn15_documents(v):
    """Timelines written as documents, read back with the fixed schema and laid out in points."""
    docs = T.timeline_documents(_timeline(v), v.clips().select("clip_id", F.col("clip_id").alias("analysis_id")))
    path = f"{work_folder(v.spark)}/timelines-{uuid.uuid4().hex}"
    docs.select(F.col("document").alias("value")).write.text(path)
    read = read_documents(v.spark, path, struct(TIMELINE), strict=True)
    p = read.select("analysis_id", "hop_ms", "window_ms", F.col("effective_weights.audio_activity").alias("used_audio"), F.array_join("warnings", ",").alias("warnings"), F.explode("points").alias("p"))
    return p.select("analysis_id", "hop_ms", "window_ms", r6(F.col("used_audio")).alias("used_audio"), "p.at_ms", "p.shot_index", r6(F.col("p.tension.combined_proxy")).alias("combined_proxy"),
                    *[r6(F.col(f"p.audio.{c}")).alias(n) for c, n in (("rms_dbfs", "rms_dbfs"), ("onset_strength", "onset"), ("spectral_flux", "flux"))], "warnings")


@query("wn18_thin_timeline", """
WITH w AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY at_ms)-1 i, count(*) OVER (PARTITION BY clip_id)-1 AS last
  FROM v_simple WHERE at_ms >= 10000 AND at_ms < 250000),
k AS (SELECT clip_id, round_even(unnest(range(0, 20))*last/19.0::DOUBLE, 0) i FROM (SELECT DISTINCT clip_id, last FROM w))
SELECT w.clip_id, at_ms, combined_proxy FROM w LEFT JOIN (SELECT DISTINCT * FROM k) k ON k.clip_id=w.clip_id AND k.i=w.i
WHERE last < 20 OR k.i IS NOT NULL""")
def wn18(v):
    return T.thin(_simple(v), 10_000, 250_000, 20)


@query("prj34_time_range", "SELECT clip_id, at_ms, combined_proxy FROM v_simple WHERE at_ms >= 60000 AND at_ms < 90000")
def prj34(v):
    return T.time_range(_simple(v), 60_000, 90_000)


@query("prj14_clip01", """
SELECT event_id, CASE WHEN event_id%11=0 OR event_id%13=0 OR event_id%17=0 THEN 0.0::DOUBLE
  ELSE round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value/80-0.2::DOUBLE)), 6)+0.0 END clipped FROM events""")
def prj14(v):
    k = F.col("event_id")
    x = (F.when(F.pmod(k, F.lit(11)) == 0, dbl(float("inf"))).when(F.pmod(k, F.lit(13)) == 0, dbl(float("nan")))
         .when(F.pmod(k, F.lit(17)) == 0, F.lit(None)).otherwise(F.col("value") / 80 - dbl(0.2)))
    return v.table("events").select("event_id", r6(clip01(x)).alias("clipped"))


@query("prj15_effective_weights", f"""
SELECT event_id, {q6("CASE WHEN t<=0 THEN 1 ELSE c/t END", 'weight_cut')}, {q6("CASE WHEN t<=0 THEN 0 ELSE a/t END", 'weight_audio')},
 {q6("CASE WHEN t<=0 THEN 0 ELSE m/t END", 'weight_motion')},
 array_to_string(list_filter([CASE WHEN NOT aa THEN 'audio_unavailable_weights_renormalized' END,
   CASE WHEN NOT ma THEN 'motion_unavailable_weights_renormalized' END], lambda x: x IS NOT NULL), ',') warnings
FROM (SELECT *, c+a+m t FROM (SELECT event_id, aa, ma, 0.0::DOUBLE c, CASE WHEN aa THEN 0.4::DOUBLE ELSE 0 END a, CASE WHEN ma THEN 0.6::DOUBLE ELSE 0 END m
 FROM (SELECT event_id, event_id%3<>0 aa, event_id%4<>0 ma FROM events)))""")
def prj15(v):
    k = F.col("event_id")
    w = T.effective_weights(F.pmod(k, F.lit(3)) != 0, F.pmod(k, F.lit(4)) != 0, TensionWeights(0.0, 0.4, 0.6))
    return v.table("events").select("event_id", *[r6(w[c]).alias(c) for c in ("weight_cut", "weight_audio", "weight_motion")],
                                    F.array_join(w["weight_warnings"], ",").alias("warnings"))


@query("prj16_combine_tension", f"""
WITH e AS (SELECT event_id, value/100 c, value/300 a, 1.2::DOUBLE-value/100 m FROM events)
SELECT event_id, {q6('least(1,c)', 'cut_activity')}, {q6('least(1,a)', 'audio_activity')}, {q6('greatest(0,least(1,m))', 'motion_activity')},
 {q6('greatest(0,least(1, 0.35::DOUBLE*c+0.30::DOUBLE*a+0.35::DOUBLE*m))', 'combined_proxy')} FROM e""")
def prj16(v):
    e = v.table("events").select(
        "event_id", (F.col("value") / 100).alias("cut_activity"), (F.col("value") / 300).alias("audio_activity"),
        (dbl(1.2) - F.col("value") / 100).alias("motion_activity"),
        dbl(0.35).alias("weight_cut"), dbl(0.30).alias("weight_audio"), dbl(0.35).alias("weight_motion"))
    return e.withColumns(T.combine_tension()).select(
        "event_id", *[r6(F.col(c)).alias(c) for c in ("cut_activity", "audio_activity", "motion_activity", "combined_proxy")])


@query("set02_distinct_warnings", """
SELECT user_id, array_to_string(list(event_type ORDER BY f), ',') warnings FROM
(SELECT user_id, event_type, min(event_id) f FROM events GROUP BY 1, 2) GROUP BY 1""")
def set02(v):
    # Repeats fold to their first sighting before the list is built: at most one entry per text.
    first = v.table("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct("f", "event_type")))["event_type"]
    return first.groupBy("user_id").agg(F.array_join(F.array_distinct(ordered), ",").alias("warnings"))
