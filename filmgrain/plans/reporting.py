"""Queries over reports: assembly, availability, facts and the views readers use."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmgrain.functions.colour import hex_code
from filmgrain.functions.numeric import dbl, r6
from filmgrain.operators import quality as Q, report as R, timeline as T
from filmgrain.operators.shots import with_shot_ids
from filmgrain.plans.activity import _simple
from filmgrain.plans.picture import kept_colours
from filmgrain.operators.colour import lightness
from filmgrain.plans.registry import query
from filmgrain.plans.sqltext import add_views, exact_round as er, r6 as q6, uuid_sql
from filmgrain.views import Views

add_views({
    "v_report": f"""SELECT s.clip_id, s.shot_index, s.start_ms, s.end_ms, {uuid_sql('clip_id', "'shot'", 'shot_index')} shot_id,
      CASE WHEN clip_id%10<>3 AND (k%5=0 OR clip_id%9=0) THEN 'INSUFFICIENT_DATA' ELSE 'OK' END c_status,
      CASE k%3 WHEN 0 THEN 'LOW_KEY_ESTIMATE' WHEN 1 THEN 'HIGH_KEY_ESTIMATE' ELSE 'BALANCED_ESTIMATE' END lighting_key,
      CASE WHEN clip_id%8=0 THEN 'NOT_COMPUTED' WHEN k%7=0 AND clip_id%4<>1 THEN 'FAILED' WHEN k%7=1 THEN 'NO_SUBJECT' ELSE 'OK' END s_status, (k%100)/100.0::DOUBLE thirds,
      CASE WHEN k%6<>0 AND clip_id%5<>0 OR clip_id%7=2 THEN (k%50)/100.0::DOUBLE END global_motion, clip_id%3<>0 has_audio,
      CASE WHEN clip_id%3=0 THEN 'NO_AUDIO' WHEN clip_id%5=0 THEN 'FAILED' ELSE 'OK' END audio_status, clip_id%13 point_count, k
      FROM (SELECT *, clip_id*31+shot_index k FROM v_shots) s""",
    "v_swatches": """SELECT clip_id, shot_index, end_ms-start_ms length_ms, 1 "rank", 0.51::DOUBLE+(k%4)*0.1::DOUBLE proportion, printf('#%02X0000', (k%4)*64) hex FROM v_report WHERE c_status='OK'
      UNION ALL SELECT clip_id, shot_index, end_ms-start_ms, 2, 1-(0.51::DOUBLE+(k%4)*0.1::DOUBLE), printf('#00%02X00', (k%3)*80) FROM v_report WHERE c_status='OK'""",
    "v_availability": """SELECT clip_id, 'COMPLETE' shots, CASE WHEN bool_and(c_status='OK') THEN 'COMPLETE' WHEN bool_or(c_status='OK') THEN 'PARTIAL' ELSE 'UNAVAILABLE' END chromatic,
      CASE WHEN bool_and(s_status='NOT_COMPUTED') THEN 'UNAVAILABLE' WHEN bool_and(s_status IN ('OK','NO_SUBJECT')) THEN 'COMPLETE' WHEN bool_or(s_status IN ('OK','NO_SUBJECT')) THEN 'PARTIAL' ELSE 'UNAVAILABLE' END spatial,
      CASE WHEN bool_and(global_motion IS NOT NULL) THEN 'COMPLETE' WHEN bool_or(global_motion IS NOT NULL) THEN 'PARTIAL' ELSE 'UNAVAILABLE' END motion,
      CASE WHEN max(audio_status)='OK' THEN 'COMPLETE' ELSE 'UNAVAILABLE' END audio, CASE WHEN max(point_count) > 0 THEN 'COMPLETE' ELSE 'UNAVAILABLE' END tension, 'NOT_REQUESTED' critic
      FROM v_report GROUP BY 1""",
    "v_weighted": """SELECT * FROM (SELECT clip_id, hex, weight, row_number() OVER (PARTITION BY clip_id ORDER BY weight DESC, hex) "rank" FROM
      (SELECT clip_id, hex, sum(proportion*length_ms) weight FROM v_swatches GROUP BY 1, 2)) WHERE "rank" <= 3""",
    "v_first_peaks": f"""SELECT clip_id, at_ms, "rank", {er('at_ms/1000.0::DOUBLE', 1)} peak_seconds FROM (SELECT clip_id, at_ms, row_number() OVER (PARTITION BY clip_id ORDER BY at_ms) "rank" FROM v_peaks) WHERE "rank" <= 8""",
    "v_critic": f"""SELECT f.clip_id, shot_count, {er('m/1000', 2)} asl_seconds, {er('md/1000', 2)} median_seconds, CASE WHEN c=0 THEN 0 ELSE {er('low/c', 2)} END low_key_ratio,
      {er('c/shot_count', 2)} chromatic_valid_ratio, {er('s/shot_count', 2)} spatial_valid_ratio, {er('th', 2)} median_thirds, coalesce(p.palette, []) palette, coalesce(k.peaks, []) peak_seconds, audio_available
      FROM (SELECT clip_id, count(*) shot_count, avg(end_ms-start_ms) m, median(end_ms-start_ms) md, count(*) FILTER (c_status='OK' AND lighting_key='LOW_KEY_ESTIMATE') low, count(*) FILTER (c_status='OK') c,
      count(*) FILTER (s_status='OK') s, median(thirds) FILTER (s_status='OK') th, bool_or(has_audio) AND max(audio_status)='OK' audio_available FROM v_report GROUP BY 1) f
      LEFT JOIN (SELECT clip_id, list(hex ORDER BY "rank") palette FROM v_weighted GROUP BY 1) p ON p.clip_id=f.clip_id
      LEFT JOIN (SELECT clip_id, list(peak_seconds ORDER BY peak_seconds) peaks FROM v_first_peaks GROUP BY 1) k ON k.clip_id=f.clip_id""",
})


def shot_rows(v: Views):
    """Shots with colour, spatial and motion values set by clip and shot number."""
    c = F.col("clip_id")
    s = with_shot_ids(v.shots()).withColumn("k", c * 31 + F.col("shot_index"))

    def m(n, x="k"):
        return F.pmod(F.col(x), F.lit(n))

    def cm(n):
        return m(n, "clip_id")

    return s.withColumns({
        "c_status": F.when((cm(10) != 3) & ((m(5) == 0) | (cm(9) == 0)), "INSUFFICIENT_DATA").otherwise("OK"),
        "lighting_key": F.when(m(3) == 0, "LOW_KEY_ESTIMATE").when(m(3) == 1, "HIGH_KEY_ESTIMATE").otherwise("BALANCED_ESTIMATE"),
        "s_status": F.when(cm(8) == 0, "NOT_COMPUTED").when((m(7) == 0) & (cm(4) != 1), "FAILED").when(m(7) == 1, "NO_SUBJECT").otherwise("OK"),
        "thirds": m(100) / dbl(100),
        "global_motion": F.when((m(6) != 0) & (cm(5) != 0) | (cm(7) == 2), m(50) / dbl(100)),
        "has_audio": cm(3) != 0,
        "audio_status": F.when(cm(3) == 0, "NO_AUDIO").when(cm(5) == 0, "FAILED").otherwise("OK"),
        "point_count": cm(13),
    })


def _swatch_array():
    k = F.col("k")
    p = dbl(0.51) + F.pmod(k, F.lit(4)) * dbl(0.1)
    zero = F.lit(0)
    return F.array(
        F.struct(F.lit(1).alias("rank"), p.alias("proportion"), hex_code(F.pmod(k, F.lit(4)) * 64, zero, zero).alias("hex")),
        F.struct(F.lit(2).alias("rank"), (dbl(1) - p).alias("proportion"), hex_code(zero, F.pmod(k, F.lit(3)) * 80, zero).alias("hex")))


def swatches(v: Views):
    rows = shot_rows(v).where("c_status = 'OK'").select("clip_id", "shot_index", (F.col("end_ms") - F.col("start_ms")).alias("length_ms"), F.explode(_swatch_array()).alias("s"))
    return rows.select("clip_id", "shot_index", "length_ms", "s.*")


def nested(v: Views):
    """Reports assembled from the shot rows with full envelopes."""
    rows = shot_rows(v)
    method = R.provenance("demo", "v1", "0" * 64, "rev", F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"))
    none, no_ids = F.lit(None).cast("string"), F.array().cast("array<string>")
    key = ["clip_id", "shot_index"]
    colour = F.struct(_swatch_array().alias("palette"), "lighting_key", dbl(0.9).alias("usable_pixel_ratio"))
    space = F.struct(F.lit("MEDIUM_ESTIMATE").alias("framing"), "thirds")
    move = F.struct("global_motion", (F.col("global_motion") / 2).alias("residual_motion"))
    why = F.when(F.col("c_status") != "OK", "chromatic_no_usable_pixels")
    # Every fifth clip lost the spatial rows of its first shot.
    lost = (F.pmod("clip_id", F.lit(5)) == 0) & (F.col("shot_index") == 0)
    return R.assemble(
        rows.select(*key, "shot_id", "start_ms", "end_ms"),
        rows.select(*key, R.envelope(F.col("c_status"), colour, dbl(0.7), why, "chromatic_unavailable", no_ids, method).alias("measure")),
        rows.where(~lost).select(*key, R.envelope(F.col("s_status"), space, dbl(0.6), none, "spatial_unavailable", no_ids, method).alias("measure")),
        rows.select(*key, R.envelope(F.lit("OK"), move, F.lit(None).cast("double"), none, "", no_ids, method).alias("measure")))


@query("jn01_assemble_report", """
SELECT clip_id, count(*) shot_count, max(CASE WHEN clip_id%5=0 AND shot_index=0 THEN 1 ELSE 0 END)::BIGINT missing, array_to_string(list(start_ms ORDER BY shot_index), ',') starts,
 array_to_string(list(c_status ORDER BY shot_index), ',') statuses FROM v_report GROUP BY 1""")
def jn01(v):
    return nested(v).select("clip_id", "shot_count", "missing", F.array_join(F.transform("shots", lambda s: s["start_ms"].cast("string")), ",").alias("starts"),
                            F.array_join(F.transform("shots", lambda s: s["chromatic"]["status"]), ",").alias("statuses"))


@query("prj17_envelopes", """
SELECT clip_id, shot_index, c_status status, c_status='OK' has_value, CASE WHEN c_status='OK' THEN 0.7::DOUBLE END confidence,
 CASE WHEN c_status='OK' THEN NULL WHEN k%2=0 THEN 'chromatic_no_usable_pixels' ELSE 'chromatic_unavailable' END reason_code FROM v_report""")
def prj17(v):
    reason = F.when(F.pmod("k", F.lit(2)) == 0, "chromatic_no_usable_pixels").when(F.pmod("k", F.lit(4)) == 1, "")
    e = R.envelope(F.col("c_status"), F.struct("lighting_key"), dbl(0.7), reason, "chromatic_unavailable", F.array("shot_id"), F.lit("m"))
    return shot_rows(v).select("clip_id", "shot_index", e.alias("e")).select(
        "clip_id", "shot_index", F.col("e.status").alias("status"), F.col("e.value").isNotNull().alias("has_value"), F.col("e.confidence").alias("confidence"), F.col("e.reason_code").alias("reason_code"))


@query("prj18_provenance", """
SELECT o_orderkey, 'chromatic.kmeans' "method", 'v1' method_version, 42 random_seed, NULL model_name, 'cpu' device, epoch(o_orderdate)::BIGINT AS started FROM orders""")
def prj18(v):
    p = R.provenance("chromatic.kmeans", "v1", "0" * 64, "rev", F.col("o_orderdate"), F.col("o_orderdate"), seed=42)
    return v.table("orders").select("o_orderkey", p.alias("p")).select(
        "o_orderkey", "p.method", "p.method_version", "p.random_seed", "p.model_name", "p.device", F.unix_timestamp(F.col("p.started_at").cast("timestamp")).alias("started"))


@query("ag18_availability", "SELECT * FROM v_availability")
def ag18(v):
    return R.availability(shot_rows(v))


_FACTS = ("asl_seconds", "median_seconds", "low_key_ratio", "chromatic_valid_ratio", "spatial_valid_ratio", "median_thirds")


def _facts(v: Views):
    return R.critic_facts(shot_rows(v), swatches(v), T.peaks(_simple(v)))


@query("ag19_critic_facts", f"""
SELECT clip_id, shot_count, {', '.join(q6(c, c) for c in _FACTS)}, array_to_string(palette, ',') palette, len(peak_seconds) peaks, {q6('list_sum(peak_seconds)', 'peak_sum')}, audio_available FROM v_critic""")
def ag19(v):
    total = F.aggregate("peak_seconds", dbl(0), lambda a, x: a + x)
    return _facts(v).select("clip_id", "shot_count", *[r6(F.col(c)).alias(c) for c in _FACTS], F.array_join("palette", ",").alias("palette"),
                            F.size("peak_seconds").cast("bigint").alias("peaks"), r6(total).alias("peak_sum"), "audio_available")


@query("tk04_palette_and_peaks", f"""
SELECT clip_id, 'palette' kind, "rank", hex label, {q6('weight', 'amount')} FROM v_weighted UNION ALL SELECT clip_id, 'peak', "rank", CAST(at_ms AS VARCHAR), {q6('peak_seconds')} FROM v_first_peaks""")
def tk04(v):
    a = R.weighted_palette(swatches(v)).select("clip_id", F.lit("palette").alias("kind"), "rank", F.col("hex").alias("label"), r6(F.col("weight")).alias("amount"))
    b = R.first_peaks(T.peaks(_simple(v))).select("clip_id", F.lit("peak").alias("kind"), "rank", F.col("at_ms").cast("string").alias("label"), r6(F.col("peak_seconds")).alias("amount"))
    return a.unionByName(b)


@query("prj24_evidence_chips", """
WITH c AS (SELECT *, [shot_count || ' shots', 'ASL ' || asl_seconds || 's', 'median ' || median_seconds || 's', 'low-key estimate ' || low_key_ratio::DOUBLE, 'chromatic valid ' || chromatic_valid_ratio,
 'spatial valid ' || spatial_valid_ratio] || CASE WHEN median_thirds IS NULL THEN [] ELSE ['thirds proximity ' || median_thirds] END || palette || CASE WHEN audio_available THEN ['audio present'] ELSE [] END
 || list_transform(peak_seconds, lambda p: 'peak ' || p || 's') chips FROM v_critic)
SELECT clip_id, unnest(range(0, len(chips))) "position", unnest(chips) label, unnest(list_transform(chips, lambda c: CASE WHEN starts_with(c, 'low-key') OR starts_with(c, 'spatial') OR starts_with(c, 'thirds') THEN 'Estimated' ELSE 'Measured' END)) kind FROM c""")
def prj24(v):
    return R.evidence_chips(_facts(v))


@query("prj33_facts_identity", """
SELECT clip_id, sha256('{"composition":{"median_thirds_proximity":' || coalesce(median_thirds::VARCHAR, 'null') || ',"valid_shot_ratio":' || spatial_valid_ratio || '},"editing":{"asl_seconds":' || asl_seconds ||
 ',"median_seconds":' || median_seconds || ',"shot_count":' || shot_count || '},"lighting":{"low_key_ratio":' || low_key_ratio::DOUBLE || ',"valid_shot_ratio":' || chromatic_valid_ratio || '},"palette":[' ||
 array_to_string(list_transform(palette, lambda h: '"' || h || '"'), ',') || '],"schema_version":"1.0","tension_proxy":{"audio_available":' || CASE WHEN audio_available THEN 'true' ELSE 'false' END ||
 ',"peak_seconds":[' || array_to_string(list_transform(peak_seconds, lambda p: p::VARCHAR), ',') || ']}}') facts_sha FROM v_critic""")
def prj33_facts(v):
    return _facts(v).select("clip_id", F.sha2(R.facts_json(), 256).alias("facts_sha"))


@query("prj20_timecodes", """
WITH t AS (SELECT event_id, event_id*777-1000 ms FROM events)
SELECT event_id, CASE WHEN ms >= 0 THEN CASE WHEN ms >= 3600000 THEN lpad(CAST(ms//3600000 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(ms//60000%60 AS VARCHAR), 2, '0') || ':' ||
 lpad(CAST(ms//1000%60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(ms%1000 AS VARCHAR), 3, '0') END timecode, CASE WHEN ms >= 0 THEN ms//1000 END seek FROM t""")
def prj20(v):
    ms = F.col("event_id") * 777 - 1000
    return v.table("events").select("event_id", R.timecode(ms).alias("timecode"), R.seek_seconds(ms).alias("seek"))


@query("prj21_palette_bars", f'SELECT clip_id, shot_index, "rank", hex, {q6("proportion", "proportion")}, {q6(er("proportion*100", 4), "width_pct")} FROM v_swatches')
def prj21(v):
    return R.palette_bars(swatches(v)).select("clip_id", "shot_index", "rank", "hex", r6(F.col("proportion")).alias("proportion"), r6(F.col("width_pct")).alias("width_pct"))


@query("prj22_shot_bars", """
SELECT clip_id, shot_index, start_ms, end_ms, end_ms-start_ms duration_ms, 'shot ' || shot_index || ' · ' || lpad(CAST((end_ms-start_ms)//60000 AS VARCHAR), 2, '0') || ':' ||
 lpad(CAST((end_ms-start_ms)//1000%60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((end_ms-start_ms)%1000 AS VARCHAR), 3, '0') label FROM v_shots""")
def prj22(v):
    return R.shot_bars(v.shots()).select("clip_id", "shot_index", "start_ms", "end_ms", "duration_ms", "label")


@query("prj23_pillar_rows", """
SELECT clip_id, pillar, availability, CASE WHEN availability<>'COMPLETE' THEN 'Unavailable' WHEN pillar='spatial' THEN 'Estimated' WHEN pillar='critic' THEN 'Interpreted' ELSE 'Measured' END kind
FROM v_availability UNPIVOT (availability FOR pillar IN (shots, chromatic, spatial, motion, audio, tension, critic))""")
def prj23(v):
    return R.pillar_rows(R.availability(shot_rows(v)))


@query("prj25_lightness_markers", f"SELECT shot_id, {q6('p10_lstar', 'p10')}, {q6('p50_lstar', 'p50')}, {q6('p90_lstar', 'p90')}, {q6('mean_lstar', 'mean')} FROM v_light WHERE shot_id%3<>0")
def prj25(v):
    rows = lightness(kept_colours(v)).withColumn("status", F.when(F.pmod("shot_id", F.lit(3)) != 0, "OK").otherwise("FAILED"))
    return R.lightness_markers(rows).select("shot_id", *[r6(F.col(c)).alias(c) for c in ("p10", "p50", "p90", "mean")])


@query("prj26_subject_schematic", f"""
WITH s AS (SELECT shot_id, sample_ord, hit_ord, least(1, greatest(0.05::DOUBLE, sqrt(area))) w, least(1, greatest(0.05::DOUBLE, h)) hh FROM v_boxes)
SELECT shot_id, sample_ord, hit_ord, {q6('(1-w)/2', 'x')}, {q6('greatest(0, (1-hh)/2)', 'y')}, {q6('w', 'width')}, {q6('hh', 'height')} FROM s""")
def prj26(v):
    d = v.detections().withColumns({"subject_height_ratio_median": F.col("y_max") - F.col("y_min")})
    d = d.withColumn("subject_coverage_ratio_median", (F.col("x_max") - F.col("x_min")) * F.col("subject_height_ratio_median"))
    s = R.subject_schematic()
    return d.select("shot_id", "sample_ord", "hit_ord", *[r6(s[c]).alias(c) for c in ("x", "y", "width", "height")])


@query("prj27_tension_series", f"""
SELECT s.clip_id, s.n points, {q6('s.total', 'total')}, s.at_list, coalesce(b.starts, '') boundaries FROM (SELECT clip_id, count(*) n, sum(combined_proxy) total, array_to_string(list(at_ms ORDER BY at_ms), ',') at_list
 FROM v_simple GROUP BY 1) s LEFT JOIN (SELECT clip_id, array_to_string(list(start_ms ORDER BY start_ms), ',') starts FROM v_shots WHERE shot_index > 0 GROUP BY 1) b ON b.clip_id=s.clip_id""")
def prj27(v):
    zero = dbl(0)
    points = T.time_range(_simple(v), 0, 259_200).withColumns({c: zero for c in ("cut_activity", "audio_activity", "motion_activity")})
    s = R.tension_series(points, v.shots())
    text = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(n) for c, n in (("at_ms", "at_list"), ("shot_boundary_ms", "boundaries"))]
    return s.select("clip_id", F.size("at_ms").cast("bigint").alias("points"), r6(F.aggregate("combined_proxy", dbl(0), lambda a, x: a + x)).alias("total"), *text)


@query("prj28_flat_report", f"""
SELECT clip_id, shot_index, shot_id, start_ms, end_ms, CASE WHEN c_status='OK' THEN printf('#%02X0000', (k%4)*64) || ',' || printf('#00%02X00', (k%3)*80) ELSE '' END palette,
 CASE WHEN c_status='OK' THEN lighting_key END lighting_key, CASE WHEN c_status='OK' THEN 0.9::DOUBLE END usable_pixel_ratio,
 CASE WHEN s_status='OK' AND NOT (clip_id%5=0 AND shot_index=0) THEN 'MEDIUM_ESTIMATE' END framing, {q6("CASE WHEN s_status='OK' AND NOT (clip_id%5=0 AND shot_index=0) THEN thirds END", 'thirds_proximity')},
 {q6('global_motion', 'global_motion_magnitude')}, {q6('global_motion/2', 'residual_motion_magnitude')} FROM v_report""")
def prj28(v):
    f = R.flat_report(nested(v))
    return f.select("clip_id", "shot_index", "shot_id", "start_ms", "end_ms", F.array_join("palette", ",").alias("palette"), "lighting_key", "usable_pixel_ratio", "framing",
                    *[r6(F.col(c)).alias(c) for c in ("thirds_proximity", "global_motion_magnitude", "residual_motion_magnitude")])


@query("src04_read_reports", """
SELECT c.clip_id, CASE WHEN c.clip_id%6=5 THEN NULL ELSE 'clip-' || c.clip_id END document_id, CASE WHEN c.clip_id%6=5 THEN 0 ELSE n END shot_count,
 CASE c.clip_id%6 WHEN 5 THEN 'not_a_report' WHEN 4 THEN 'unknown_key' WHEN 3 THEN 'shot_count' ELSE CASE WHEN c.clip_id%4=0 THEN 'audio_without_stream' END END problem,
 c.clip_id%6 IN (0, 1, 2) AND c.clip_id%4<>0 "valid" FROM v_clips c JOIN (SELECT clip_id, count(*) n FROM v_shots GROUP BY 1) s ON s.clip_id=c.clip_id""")
def src04_reports(v):
    """Report documents, some broken, read back with the fixed schema."""
    c = F.col("clip_id")

    def m(n, r=0):
        return F.pmod(c, F.lit(n)) == r

    video = F.struct(F.concat(F.lit("v"), c).alias("video_id"), F.lit(259_200).alias("duration_ms"), (~m(4)).alias("has_audio"))
    summary = F.struct((F.col("shot_count") + F.when(m(6, 3), 1).otherwise(0)).alias("shot_count"))
    levels = F.struct(*[F.lit("COMPLETE").alias(p) for p in R.PILLAR_KIND])
    rows = nested(v)
    heads = rows.select("clip_id", F.concat(F.lit("clip-"), c).alias("analysis_id"), F.lit("2024-01-01T00:00:00Z").alias("generated_at"),
                        video.alias("video"), levels.alias("availability"), summary.alias("summary"))
    docs = R.report_documents(rows, heads).withColumn("clip_id", F.substring_index("analysis_id", "-", -1).cast("bigint"))
    doc = F.when(m(6, 4), F.concat(F.lit('{"host":1,'), F.substring(F.col("doc"), F.lit(2), F.length("doc")))).when(m(6, 5), F.substring(F.col("doc"), F.lit(1), F.length("doc") - 5)).otherwise(F.col("doc"))
    return R.report_verdicts(docs.select("clip_id", doc.alias("doc"))).select("clip_id", "document_id", F.col("shot_count").cast("bigint").alias("shot_count"), "problem", "valid")


@query("dq11_report", """
SELECT clip_id, 'shot_count' rule_id FROM v_clips WHERE clip_id%4=0 UNION ALL SELECT clip_id, 'audio_without_stream' FROM v_clips WHERE clip_id%6=0
UNION ALL SELECT clip_id, 'index_contiguous' FROM v_clips WHERE clip_id%5=0""")
def dq11(v):
    c = F.col("clip_id")

    def m(n):
        return F.pmod(c, F.lit(n))

    moved = F.transform("shots", lambda s: s.withField("shot_index", s["shot_index"] + F.when(m(5) == 0, 1).otherwise(0)))
    r = nested(v).select("clip_id", moved.alias("shots"), (F.size("shots") + F.when(m(4) == 0, 1).otherwise(0)).alias("summary_count"),
                         (m(3) != 0).alias("has_audio"), F.when(m(2) == 0, "COMPLETE").otherwise("UNAVAILABLE").alias("audio"))
    return Q.violations(r, ["clip_id"], Q.report())
