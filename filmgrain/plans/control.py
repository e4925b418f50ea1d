"""Queries over job history, metrics and contract rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmgrain.config import DEFAULT_CONFIG
from filmgrain.functions.colour import hex_code
from filmgrain.functions.geometry import centroid_x, centroid_y
from filmgrain.functions.numeric import dbl, r6
from filmgrain.operators import content as K, jobs as J, metrics as M, quality as Q
from filmgrain.operators.pillars import Pillars
from filmgrain.operators.shots import with_shot_ids
from filmgrain.plans.picture import _obs
from filmgrain.plans.registry import query
from filmgrain.plans.sqltext import add_views, r6 as q6
from filmgrain.views import Views


def _mod(c: str, n: int):
    return F.pmod(F.col(c), F.lit(n))


_CLOSED = ", ".join(f"'{x}'" for x in M.LABEL_VALUES["stage"])
add_views({
    "v_latest": "SELECT analysis_id, stage_name, max(attempt) attempt, arg_max(state, attempt) state FROM v_stage_runs GROUP BY 1, 2",
    "v_live": """SELECT analysis_id, stage_name, ord, CASE WHEN state='PENDING' AND ord%2=0 THEN 'RUNNING' ELSE state END state FROM v_stage_runs""",
    "v_avail": """SELECT c_custkey analysis_id, CASE c_custkey%4 WHEN 0 THEN 'PARTIAL' ELSE 'COMPLETE' END chromatic,
      CASE c_custkey%5 WHEN 0 THEN 'UNAVAILABLE' ELSE 'COMPLETE' END spatial, CASE c_custkey%7 WHEN 0 THEN 'PARTIAL' ELSE 'COMPLETE' END motion,
      CASE c_custkey%3 WHEN 0 THEN 'UNAVAILABLE' ELSE 'COMPLETE' END audio, 'COMPLETE' tension, 'NOT_REQUESTED' critic, c_custkey%2=0 has_audio,
      c_custkey%6=0 spatial_requested, c_acctbal >= 0 reported FROM customer""",
    "v_metric": """SELECT event_id, CASE event_id%6 WHEN 0 THEN 'stage_duration_ms' WHEN 1 THEN 'cache_hits_total' WHEN 2 THEN 'bogus' WHEN 3 THEN 'queue_wait_ms'
      WHEN 4 THEN 'stage_runs_total' ELSE 'stage_duration_ms' END name, CASE event_type WHEN 'view' THEN 'report' WHEN 'click' THEN 'sampling' ELSE event_type END st,
      CAST(floor(value) AS BIGINT)-20 val FROM events""",
    "v_log_prev": "SELECT *, lag(state) OVER (PARTITION BY analysis_id ORDER BY changed_at, ord) f FROM v_state_log",
})


def _runs(v: Views):
    return v.stage_runs()


@query("wn19_latest_attempts", "SELECT * FROM v_latest")
def wn19(v):
    return J.latest_attempts(_runs(v))


@query("wn22_next_attempts", "SELECT analysis_id, stage_name, max(attempt)+1 next_attempt FROM v_stage_runs GROUP BY 1, 2")
def wn22(v):
    return J.next_attempts(_runs(v))


@query("wn20_next_stage", """
WITH p AS (SELECT analysis_id, max(state) FILTER (stage_name='sampling') s, max(state) FILTER (stage_name='report') r, max(state) FILTER (stage_name='aggregate') a
 FROM v_latest GROUP BY 1)
SELECT analysis_id, CASE WHEN s IS NULL OR s<>'SUCCEEDED' THEN 'sampling' WHEN r IS NULL OR r<>'SUCCEEDED' THEN 'report' WHEN a IS NULL OR a<>'SUCCEEDED' THEN 'aggregate' END next_stage FROM p""")
def wn20(v):
    return J.next_stage(_runs(v))


@query("ag20_progress", f"""
SELECT analysis_id, {q6("0.4::DOUBLE*bool_or(stage_name='sampling' AND state='SUCCEEDED')::INT+0.5::DOUBLE*bool_or(stage_name='report' AND state='SUCCEEDED')::INT+0.1::DOUBLE*bool_or(stage_name='aggregate' AND state='SUCCEEDED')::INT", 'progress')}
FROM v_stage_runs GROUP BY 1""")
def ag20(v):
    return J.progress(_runs(v)).select("analysis_id", r6(F.col("progress")).alias("progress"))


def _availability(v: Views):
    k = "c_custkey"
    return v.table("customer").select(
        F.col(k).alias("analysis_id"), (F.col("c_acctbal") >= 0).alias("reported"), F.when(_mod(k, 4) == 0, "PARTIAL").otherwise("COMPLETE").alias("chromatic"),
        F.when(_mod(k, 5) == 0, "UNAVAILABLE").otherwise("COMPLETE").alias("spatial"), F.when(_mod(k, 7) == 0, "PARTIAL").otherwise("COMPLETE").alias("motion"),
        F.when(_mod(k, 3) == 0, "UNAVAILABLE").otherwise("COMPLETE").alias("audio"), F.lit("COMPLETE").alias("tension"), F.lit("NOT_REQUESTED").alias("critic"),
        (_mod(k, 2) == 0).alias("has_audio"), (_mod(k, 6) == 0).alias("spatial_requested"))


@query("ag21_analysis_outcome", """
WITH r AS (SELECT analysis_id, count(*) FILTER (stage_name IN ('sampling','report') AND state='SUCCEEDED') n FROM v_latest GROUP BY 1)
SELECT r.analysis_id, CASE WHEN n < 2 OR a.analysis_id IS NULL THEN 'FAILED' WHEN chromatic IN ('UNAVAILABLE','PARTIAL') OR (spatial_requested AND spatial<>'COMPLETE')
 OR motion IN ('UNAVAILABLE','PARTIAL') OR (has_audio AND audio<>'COMPLETE') OR tension='UNAVAILABLE' THEN 'PARTIAL' ELSE 'SUCCEEDED' END outcome
FROM r LEFT JOIN v_avail a ON a.analysis_id=r.analysis_id AND a.reported""")
def ag21(v):
    return J.outcomes(_runs(v), _availability(v).where("reported").drop("reported"))


def _live(v: Views):
    pending = (F.col("state") == "PENDING") & (_mod("ord", 2) == 0)
    return _runs(v).withColumn("state", F.when(pending, "RUNNING").otherwise(F.col("state")))


@query("ag22_status_view", f"""
WITH j AS (SELECT *, CASE analysis_id%3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'QUEUED' END state FROM v_avail),
d AS (SELECT analysis_id, stage_name, bool_or(state='SUCCEEDED') done, min(ord) FILTER (state='RUNNING') since FROM v_live GROUP BY 1, 2),
l AS (SELECT analysis_id, array_to_string(list_filter([CASE WHEN bool_or(stage_name='sampling' AND done) THEN 'sampling' END, CASE WHEN bool_or(stage_name='report' AND done) THEN 'report' END,
 CASE WHEN bool_or(stage_name='aggregate' AND done) THEN 'aggregate' END], lambda x: x IS NOT NULL), ',') completed,
 coalesce(array_to_string(list(stage_name ORDER BY since) FILTER (since IS NOT NULL), ','), '') active,
 0.4::DOUBLE*bool_or(stage_name='sampling' AND done)::INT+0.5::DOUBLE*bool_or(stage_name='report' AND done)::INT+0.1::DOUBLE*bool_or(stage_name='aggregate' AND done)::INT p FROM d GROUP BY 1)
SELECT j.analysis_id, state, {q6("CASE WHEN state='FAILED' THEN 0.25 ELSE coalesce(p, 0) END", 'progress')}, coalesce(completed, '') completed_stages, coalesce(active, '') active_stages,
 array_to_string(list_filter([CASE WHEN chromatic<>'COMPLETE' THEN 'chromatic' END, CASE WHEN spatial<>'COMPLETE' THEN 'spatial' END, CASE WHEN motion<>'COMPLETE' THEN 'motion' END,
 CASE WHEN audio<>'COMPLETE' THEN 'audio' END, 'critic'], lambda x: x IS NOT NULL), ',') unavailable_stages, CASE WHEN state='FAILED' THEN 'SHOT_FAILED' END error_code
FROM j LEFT JOIN l ON l.analysis_id=j.analysis_id""")
def ag22(v):
    k = "analysis_id"
    jobs = _availability(v).withColumns({
        "state": F.when(_mod(k, 3) == 0, "FAILED").when(_mod(k, 3) == 1, "RUNNING").otherwise("QUEUED"),
        "progress": dbl(0.25), "failure_code": F.lit("SHOT_FAILED")})
    out = J.status_view(jobs, _live(v))
    return out.select(k, "state", r6(F.col("progress")).alias("progress"), *[F.array_join(c, ",").alias(c) for c in ("completed_stages", "active_stages", "unavailable_stages")], "error_code")


def _analyses(v: Views):
    return v.table("orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("analysis_key"), F.col("o_orderdate").alias("created_at"),
        F.when(_mod("o_orderkey", 5) == 0, "QUEUED").when(_mod("o_orderkey", 5) == 1, "RUNNING").when(_mod("o_orderkey", 5) == 2, "CANCEL_REQUESTED").otherwise("SUCCEEDED").alias("state"))


@query("ag23_quota", """
WITH n AS (SELECT count(*) n FROM orders WHERE o_orderkey%5 < 3)
SELECT c_custkey, n in_flight, CASE WHEN c_custkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey%2=0) THEN 'REUSED' WHEN n < 5 THEN 'ACCEPTED' ELSE 'RESOURCE_LIMIT' END verdict FROM customer, n""")
def ag23(v):
    asked = v.table("customer").select("c_custkey", F.sha2(F.when(_mod("c_custkey", 2) == 0, F.col("c_custkey").cast("string")).otherwise("new"), 256).alias("analysis_key"))
    return J.quota(asked, _analyses(v), 5).select("c_custkey", "in_flight", "verdict")


_FREE = """SELECT o_orderkey analysis_id, o_orderdate created_at FROM orders o WHERE o_orderkey%5=0 OR (o_orderkey%5 IN (1,2) AND NOT EXISTS
 (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l_shipdate >= TIMESTAMP '1998-06-01' AND l_linestatus='O'))"""


def _claimable(v: Views):
    leases = v.table("lineitem").select(
        F.col("l_orderkey").alias("analysis_id"), F.when(F.col("l_linestatus") == "O", "LEASED").otherwise("PENDING").alias("state"), F.col("l_shipdate").alias("lease_expires_at"))
    return J.claimable(_analyses(v), leases, F.lit("1998-06-01").cast("timestamp_ntz"))


@query("jn12_claimable", _FREE)
def jn12(v):
    return _claimable(v).select("analysis_id", "created_at")


@query("tk02_oldest_claimable", f"SELECT * FROM ({_FREE}) ORDER BY created_at, analysis_id LIMIT 20")
def tk02(v):
    return J.oldest(_claimable(v).select("analysis_id", "created_at"), 20, "created_at", "analysis_id")


@query("tk01_stage_history", "SELECT analysis_id, stage_name, attempt, state FROM v_stage_runs ORDER BY 1, 2, 3")
def tk01(v):
    return _runs(v).select("analysis_id", "stage_name", "attempt", "state").orderBy("analysis_id", "stage_name", "attempt")


@query("jn14_illegal_moves", """
SELECT analysis_id, ord, f from_state, state, f='SUCCEEDED' from_terminal FROM v_log_prev WHERE f IS NOT NULL
 AND concat(f, '>', state) NOT IN ('QUEUED>RUNNING', 'RUNNING>SUCCEEDED')""")
def jn14(v):
    return J.illegal_moves(v.state_log()).select("analysis_id", "ord", "from_state", "state", "from_terminal")


@query("ag27_stage_rollup", """
SELECT stage_name, state, error_class, count(*) runs, sum(d)::BIGINT duration_ms, max(d) longest_ms, grouping_id(stage_name, state, error_class) "level"
FROM (SELECT *, CASE WHEN state='SUCCEEDED' THEN 'none' WHEN ord%3=0 THEN 'SHOT' ELSE 'other' END error_class, ord%1000 d FROM v_stage_runs) GROUP BY ROLLUP (stage_name, state, error_class)""")
def ag27(v):
    code = F.when(F.col("state") == "SUCCEEDED", F.lit(None)).when(_mod("ord", 3) == 0, "SHOT_FAILED").otherwise("WHO_KNOWS")
    return J.stage_rollup(_runs(v).withColumns({"error_class": M.error_class(code), "duration_ms": _mod("ord", 1000)}))


@query("prj19_error_classes", """
SELECT event_id, CASE event_id%5 WHEN 0 THEN 'MEDIA' WHEN 1 THEN 'RESOURCE' WHEN 2 THEN 'other' WHEN 3 THEN 'none' ELSE 'CANCELED' END error_class,
 CASE event_id%5 WHEN 0 THEN 'terminal' WHEN 1 THEN 'degrade_or_retry' WHEN 4 THEN 'terminal_canceled' END retry_class FROM events""")
def prj19(v):
    m = _mod("event_id", 5)
    code = (F.when(m == 0, F.concat(F.lit("MEDIA_"), F.col("event_type"))).when(m == 1, "RESOURCE_DISK").when(m == 2, F.col("event_type"))
            .when(m == 4, "CANCELED_BY_USER"))
    return v.table("events").select("event_id", M.error_class(code).alias("error_class"), M.retry_class(code).alias("retry_class"))


def _metric_events(v: Views):
    m = _mod("event_id", 6)
    st = F.when(F.col("event_type") == "view", "report").when(F.col("event_type") == "click", "sampling").otherwise(F.col("event_type"))
    stage = F.create_map(F.lit("stage"), st)
    labels = (F.when(m == 3, F.create_map(F.lit("queue"), F.lit("local"), F.lit("stage"), st))
              .when(m == 4, stage).otherwise(stage))
    return v.table("events").select(
        "event_id", "ts", F.when(m == 0, "stage_duration_ms").when(m == 1, "cache_hits_total").when(m == 2, "bogus").when(m == 3, "queue_wait_ms")
        .when(m == 4, "stage_runs_total").otherwise("stage_duration_ms").alias("name"), labels.alias("labels"),
        F.when(m == 1, "counter").otherwise("histogram").alias("kind"), (F.floor("value") - 20).cast("bigint").alias("value"))


_SERIES = f"'stage=' || CASE WHEN st IN ({_CLOSED}) THEN st ELSE 'other' END"


@query("ag24_metrics_rollup", f"""
SELECT name, {_SERIES} series, sum(CASE WHEN name='cache_hits_total' THEN val END)::BIGINT counter_total, count(*) FILTER (name<>'cache_hits_total') samples,
 sum(CASE WHEN name<>'cache_hits_total' THEN greatest(val, 0) END)::BIGINT sample_sum, max(CASE WHEN name<>'cache_hits_total' THEN greatest(val, 0) END) sample_max
FROM v_metric WHERE event_id%6 IN (0, 1, 5) GROUP BY 1, 2""")
def ag24(v):
    return M.metrics_rollup(_metric_events(v))


@query("ag24_refused_metrics", """
SELECT event_id, CASE event_id%6 WHEN 2 THEN 'unknown_metric' WHEN 3 THEN 'unexpected_labels' ELSE 'missing_labels' END problem FROM events WHERE event_id%6 IN (2, 3, 4)""")
def ag24_refused(v):
    return M.refused_metrics(_metric_events(v)).select("event_id", "problem")


@query("set04_label_difference", """
SELECT event_id, CASE event_id%6 WHEN 2 THEN 'stage' WHEN 3 THEN 'stage' ELSE '' END extra, CASE event_id%6 WHEN 4 THEN 'error_class,state' ELSE '' END missing FROM events""")
def set04(v):
    return _metric_events(v).withColumns(M.label_difference()).select("event_id", F.array_join("extra", ",").alias("extra"), F.array_join("missing", ",").alias("missing"))


@query("ag26_queue_wait", """
WITH w AS (SELECT l_returnflag q, greatest(0, epoch_ms(l_shipdate)-epoch_ms(TIMESTAMP '1998-01-01')) w FROM lineitem)
SELECT 'queue_wait_ms' name, q "label", count(*) samples, sum(w)::BIGINT sum_ms, max(w) max_ms FROM w GROUP BY 2 UNION ALL
SELECT 'span_duration_ms', 'queue_wait', count(*), sum(w)::BIGINT, max(w) FROM w""")
def ag26(v):
    df = v.table("lineitem").select(F.col("l_returnflag").alias("queue"), F.col("l_shipdate").cast("timestamp").alias("started_at"), F.lit("1998-01-01").cast("timestamp").alias("requested_at"))
    return M.queue_wait(df)


@query("ag25_realtime_factor", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity<=3 THEN 0 ELSE CAST(floor(l_extendedprice*1000/(l_quantity*100-300)) AS BIGINT) END rtf_milli FROM lineitem""")
def ag25(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.realtime_factor(F.col("l_extendedprice"), F.col("l_quantity") * 100 - 300).alias("rtf_milli"))


@query("ag25_benchmark_verdicts", """
WITH r AS (SELECT o_custkey report_id, CAST(o_orderkey//2 AS VARCHAR) clip, o_orderkey//2 clip_ord, o_orderkey%2 pass_no, CASE WHEN o_orderkey%37=0 THEN 'fail' ELSE 'pass' END g,
 CASE WHEN o_orderkey%41=0 THEN -1 ELSE 5 END rtf, CASE WHEN o_custkey%10=0 THEN 'x' ELSE 'h' END hash FROM orders),
c AS (SELECT DISTINCT report_id, clip FROM r WHERE pass_no=0),
b AS (SELECT report_id, arg_min(CASE WHEN g<>'pass' THEN 'golden_not_passed:' || clip ELSE 'negative_factor:' || clip END, clip_ord*2+pass_no) p
 FROM r JOIN c USING (report_id, clip) WHERE g<>'pass' OR rtf < 0 GROUP BY 1)
SELECT r.report_id, CASE WHEN max(hash)<>'h' THEN 'other_configuration' WHEN NOT bool_or(pass_no=0) THEN 'nothing_ran'
 ELSE coalesce(any_value(p), 'ok') END reason, CASE WHEN max(hash)<>'h' OR NOT bool_or(pass_no=0) OR any_value(p) IS NOT NULL THEN false ELSE true END "valid"
FROM r LEFT JOIN b ON b.report_id=r.report_id GROUP BY 1""")
def ag25_verdicts(v):
    o = v.table("orders")
    half = F.floor(F.col("o_orderkey") / 2)
    runs = o.select(
        F.col("o_custkey").alias("report_id"), half.cast("string").alias("clip"), half.alias("clip_ord"), _mod("o_orderkey", 2).alias("pass_no"),
        F.when(_mod("o_orderkey", 37) == 0, "fail").otherwise("pass").alias("golden_status"), F.when(_mod("o_orderkey", 41) == 0, -1).otherwise(5).alias("rtf_milli"),
        F.when(_mod("o_custkey", 10) == 0, "x").otherwise("h").alias("configuration_hash"))
    return M.benchmark_verdicts(runs, "h").select("report_id", "reason", "valid")


@query("udf01_pillar_backends", """
SELECT s_suppkey shot_id, 'fake' backend, 'OK' status, NULL reason_code, round(s_acctbal, 6) score FROM supplier UNION ALL
SELECT s_suppkey, 'laser', 'NOT_COMPUTED', 'detector_not_installed', NULL FROM supplier""")
def udf01(v):
    from pyspark.sql.types import DoubleType, StructField, StructType
    pillars = Pillars("shot_id", StructType([StructField("score", DoubleType())]), "detector_not_installed")
    pillars.register("fake", lambda df: df.withColumns({"status": F.lit("OK"), "reason_code": F.lit(None).cast("string"), "score": F.col("s_acctbal")}))
    shots = v.table("supplier").withColumnRenamed("s_suppkey", "shot_id")
    known, unknown = (shots.transform(pillars(b)).withColumn("backend", F.lit(b)) for b in ("fake", "laser"))
    return known.unionByName(unknown)


# --- contract rules --------------------------------------------------------------

@query("dq01_document_keys", """
SELECT event_id, 'unknown_key' rule_id FROM events WHERE event_id%10=0 UNION ALL SELECT event_id, 'schema_version' FROM events WHERE event_id%4=0""")
def dq01(v):
    doc = F.concat(F.lit('{"schema_version":"'), F.when(_mod("event_id", 4) == 0, "0.9").otherwise("1.0"), F.lit('","k":'), F.col("event_id").cast("string"),
                   F.when(_mod("event_id", 10) == 0, ',"path":1').otherwise(""), F.lit("}"))
    return Q.violations(v.table("events").withColumn("doc", doc), ["event_id"], Q.document_keys(F.col("doc"), ["schema_version", "k"]))


@query("dq02_intervals", """
SELECT clip_id, shot_index, 'end_after_start' rule_id FROM v_shots WHERE shot_index%5=0 AND shot_index%3<>2 UNION ALL SELECT clip_id, shot_index, 'start_not_negative' FROM v_shots WHERE shot_index%3=2""")
def dq02(v):
    s = v.shots().withColumns({"end_ms": F.when(_mod("shot_index", 5) == 0, F.col("start_ms")).otherwise(F.col("end_ms")),
                               "start_ms": F.when(_mod("shot_index", 3) == 2, F.col("start_ms") - 1_000_000).otherwise(F.col("start_ms"))})
    return Q.violations(s, ["clip_id", "shot_index"], Q.interval())


@query("dq03_shot_set", """
SELECT clip_id, 'index_contiguous' rule_id FROM v_clips WHERE clip_id%7=0 UNION ALL SELECT clip_id, 'edges_touch' FROM (SELECT clip_id FROM v_shots GROUP BY 1 HAVING max(shot_index) >= 3) WHERE clip_id%3=0
UNION ALL SELECT clip_id, 'unique_shot_id' FROM (SELECT clip_id FROM v_shots GROUP BY 1 HAVING max(shot_index) >= 1) WHERE clip_id%11=0""")
def dq03(v):
    c = "clip_id"
    s = with_shot_ids(v.shots())
    s = s.withColumns({
        "shot_id": F.when(_mod(c, 11) == 0, F.lit("same")).otherwise(F.col("shot_id")),
        "shot_index": F.col("shot_index") + F.when(_mod(c, 7) == 0, 1).otherwise(0),
        "start_ms": F.col("start_ms") + F.when((_mod(c, 3) == 0) & (F.col("shot_index") == 3), 1).otherwise(0)})
    return Q.shot_set(s)


@query("dq04_envelope", """
WITH e AS (SELECT event_id, CASE WHEN event_id%3=0 THEN 'OK' ELSE 'FAILED' END s, event_id%2=0 hv, CASE WHEN event_id%5=0 THEN 'why' WHEN event_id%5=1 THEN '' END rc FROM events)
SELECT event_id, 'ok_needs_value' rule_id FROM e WHERE s='OK' AND NOT hv UNION ALL SELECT event_id, 'ok_without_reason' FROM e WHERE s='OK' AND rc IS NOT NULL
UNION ALL SELECT event_id, 'absent_without_value' FROM e WHERE s<>'OK' AND hv UNION ALL SELECT event_id, 'absent_needs_reason' FROM e WHERE s<>'OK' AND coalesce(rc, '')=''""")
def dq04(v):
    e = v.table("events").select(
        "event_id", F.when(_mod("event_id", 3) == 0, "OK").otherwise("FAILED").alias("status"), (_mod("event_id", 2) == 0).alias("has_value"),
        F.when(_mod("event_id", 5) == 0, "why").when(_mod("event_id", 5) == 1, "").alias("reason_code"))
    return Q.violations(e, ["event_id"], Q.envelope())


@query("dq05_palette", """
SELECT s_suppkey, 'ranks_contiguous' rule_id FROM supplier WHERE s_suppkey%3=0 UNION ALL SELECT s_suppkey, 'proportions_sum' FROM supplier WHERE s_suppkey%4=0
UNION ALL SELECT s_suppkey, 'display_order' FROM supplier WHERE s_suppkey%5=0 UNION ALL SELECT s_suppkey, 'hex_matches' FROM supplier WHERE s_suppkey%7=0""")
def dq05(v):
    k = "s_suppkey"

    def swatch(rank, prop, r):
        code = hex_code(F.lit(r), F.lit(0), F.lit(0))
        code = F.when(_mod(k, 7) == 0, F.lower(F.concat(code, F.lit("F")))).otherwise(code)
        return F.struct(rank.alias("rank"), prop.alias("proportion"), code.alias("hex"), F.lit(r).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))

    big = F.when(_mod(k, 4) == 0, dbl(0.65)).otherwise(dbl(0.6))
    a = swatch(F.lit(1), F.when(_mod(k, 5) == 0, dbl(0.4)).otherwise(big), 200)
    b = swatch(F.when(_mod(k, 3) == 0, 3).otherwise(2), F.when(_mod(k, 5) == 0, big).otherwise(dbl(0.4)), 10)
    return Q.violations(v.table("supplier").withColumn("palette", F.array(a, b)), [k], Q.palette(F.col("palette")))


@query("dq06_lightness", "SELECT l_orderkey, l_linenumber, l_partkey, 'percentiles_ordered' rule_id FROM lineitem WHERE NOT (l_discount <= l_tax*1.5::DOUBLE AND l_tax*1.5::DOUBLE <= l_quantity/300)")
def dq06(v):
    li = v.table("lineitem").withColumns({"p10_lstar": F.col("l_discount"), "p50_lstar": F.col("l_tax") * dbl(1.5), "p90_lstar": F.col("l_quantity") / 300})
    return Q.violations(li, ["l_orderkey", "l_linenumber", "l_partkey"], Q.lightness())


@query("dq07_boxes", """
SELECT shot_id, sample_ord, hit_ord, 'box_extent' rule_id FROM v_obs WHERE sample_ord%5=0 UNION ALL
SELECT shot_id, sample_ord, hit_ord, 'centroid_inside' FROM v_obs WHERE sample_ord%5=0 OR sample_ord%3=0""")
def dq07(v):
    o = _obs(v).withColumns({"centroid_x": centroid_x(), "centroid_y": centroid_y()})
    o = o.withColumns({"x_max": F.when(_mod("sample_ord", 5) == 0, F.col("x_min")).otherwise(F.col("x_max")),
                       "centroid_y": F.when(_mod("sample_ord", 3) == 0, dbl(1.5)).otherwise(F.col("centroid_y"))})
    return Q.violations(o, ["shot_id", "sample_ord", "hit_ord"], Q.box())


@query("dq08_timeline_increasing", """
SELECT DISTINCT clip_id, 'at_ms_increasing' rule_id FROM (SELECT clip_id, at_ms, lag(at_ms) OVER (PARTITION BY clip_id ORDER BY frame_index) p FROM (SELECT clip_id, frame_index, at_ms - CASE WHEN frame_index%400=0 THEN 20000 ELSE 0 END at_ms FROM v_scores)) WHERE at_ms <= p""")
def dq08(v):
    late = F.when(_mod("frame_index", 400) == 0, 20_000).otherwise(0)
    return Q.increasing(v.scores().select("clip_id", F.col("frame_index").alias("ord"), (F.col("at_ms") - late).alias("at_ms")))


@query("dq09_sample_rows", """
WITH s AS (SELECT event_id, CASE WHEN event_id%2=0 THEN 'DECODED' ELSE 'UNAVAILABLE' END st, event_id%3<>0 d, event_id%5<>0 im, event_id%7=0 why FROM events)
SELECT event_id, 'decoded_complete' rule_id FROM s WHERE st='DECODED' AND NOT (d AND im) UNION ALL SELECT event_id, 'decoded_without_reason' FROM s WHERE st='DECODED' AND why
UNION ALL SELECT event_id, 'unavailable_without_pixels' FROM s WHERE st<>'DECODED' AND (d OR im) UNION ALL SELECT event_id, 'unavailable_needs_reason' FROM s WHERE st<>'DECODED' AND NOT why""")
def dq09(v):
    s = v.table("events").select(
        "event_id", F.when(_mod("event_id", 2) == 0, "DECODED").otherwise("UNAVAILABLE").alias("status"), F.when(_mod("event_id", 3) != 0, 5).alias("decoded_ms"),
        F.when(_mod("event_id", 5) != 0, "sha").alias("image_sha"), F.when(_mod("event_id", 7) == 0, "why").alias("unavailable_reason"))
    return Q.violations(s, ["event_id"], Q.samples())


@query("dq09_sample_order", """
SELECT DISTINCT o_custkey clip_id, 'results_follow_plan' rule_id FROM orders WHERE o_orderkey%97=0 UNION ALL
SELECT o_custkey, 'unique_sample_id' FROM (SELECT o_custkey, o_orderkey//4 s, count(*) n FROM orders GROUP BY 1, 2) WHERE n > 1 GROUP BY 1""")
def dq09_order(v):
    plan = v.table("orders").select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("ord"), F.floor(F.col("o_orderkey") / 4).alias("sample_id"))
    results = plan.withColumn("sample_id", F.when(_mod("ord", 97) == 0, F.col("sample_id") + 1).otherwise(F.col("sample_id")))
    return Q.sample_order(plan, results)


@query("dq10_video", """
SELECT p_partkey, 'right_angle' rule_id FROM part WHERE p_size%4=1 UNION ALL SELECT p_partkey, 'codec_with_audio' FROM part WHERE p_partkey%2=0 AND p_partkey%3=0
UNION ALL SELECT p_partkey, 'no_codec_without_audio' FROM part WHERE p_partkey%2=1 AND p_partkey%3<>0""")
def dq10(v):
    p = v.table("part").select("p_partkey", F.when(F.pmod("p_size", F.lit(4)) == 1, 45).otherwise(90).alias("rotation"), (_mod("p_partkey", 2) == 0).alias("has_audio"),
                               F.when(_mod("p_partkey", 3) != 0, "aac").alias("audio_codec"))
    return Q.violations(p, ["p_partkey"], Q.video())


@query("dq12_critiques", """
WITH c AS (SELECT conv_id, turn, CASE WHEN turn%2=0 THEN 'OK' ELSE 'FAILED' END st, CASE WHEN conv_id%3=0 THEN NULL ELSE repeat(text, 3) END txt, string_split(text, '. ') ss FROM conversations)
SELECT conv_id, turn, 'ok_needs_text' rule_id FROM c WHERE st='OK' AND txt IS NULL UNION ALL SELECT conv_id, turn, 'absent_without_text' FROM c WHERE st<>'OK' AND txt IS NOT NULL
UNION ALL SELECT conv_id, turn, 'text_length' FROM c WHERE length(txt) > 1200 UNION ALL SELECT conv_id, turn, 'sentence_count' FROM c WHERE len(ss) > 3 OR len(ss) < 1
UNION ALL SELECT conv_id, turn, 'sentence_length' FROM c WHERE len(list_filter(ss, lambda s: length(s) < 1 OR length(s) > 200)) > 0""")
def dq12(v):
    c = v.table("conversations").select(
        "conv_id", "turn", F.when(_mod("turn", 2) == 0, "OK").otherwise("FAILED").alias("status"), F.when(_mod("conv_id", 3) != 0, F.repeat("text", 3)).alias("text"),
        F.split("text", r"\. ").alias("ss"))
    return Q.violations(c, ["conv_id", "turn"], Q.critique(F.col("ss")))


@query("dq13_config_rules", """
SELECT l_orderkey, l_linenumber, l_partkey, 'weights_sum' rule_id FROM lineitem WHERE abs(l_discount+l_tax+0.9::DOUBLE-1) > 1e-9 UNION ALL
SELECT l_orderkey, l_linenumber, l_partkey, 'thresholds_increase' FROM lineitem WHERE l_discount >= l_tax OR l_tax >= 0.05::DOUBLE""")
def dq13(v):
    if DEFAULT_CONFIG.problems():
        raise ValueError("default settings break their own rules")
    li = v.table("lineitem").withColumns({"w": dbl(0.9), "top": dbl(0.05)})
    return Q.violations(li, ["l_orderkey", "l_linenumber", "l_partkey"], Q.weights(["l_discount", "l_tax", "w"]) | Q.rising(["l_discount", "l_tax", "top"]))


@query("dq14_job_keys", """
SELECT analysis_id k, 'one_success' rule_id FROM v_stage_runs WHERE state='SUCCEEDED' GROUP BY analysis_id, stage_name HAVING count(*) > 1 UNION ALL
SELECT c_custkey, 'order_known' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT ord, 'attempt_positive' FROM v_stage_runs WHERE attempt < 3 UNION ALL SELECT ord, 'state_known' FROM v_stage_runs WHERE state='PENDING'""")
def dq14(v):
    runs = _runs(v)
    twice = Q.unique(runs.where("state = 'SUCCEEDED'"), ["analysis_id", "stage_name"], "one_success").select(F.col("analysis_id").alias("k"), "rule_id")
    child = v.table("customer").withColumnRenamed("c_custkey", "k")
    parent = v.table("orders").withColumnRenamed("o_custkey", "k")
    rows = Q.violations(runs.withColumn("k", F.col("ord")), ["k"], {"attempt_positive": F.col("attempt") - 2 < 1, "state_known": ~F.col("state").isin("SUCCEEDED", "FAILED_RETRYABLE")})
    return twice.unionByName(Q.missing_parent(child, parent, "k", "order_known")).unionByName(rows)


@query("dq15_provenance", "SELECT l_orderkey, l_linenumber, l_partkey, 'completed_after_start' rule_id FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def dq15(v):
    li = v.table("lineitem").withColumns({"completed_at": F.col("l_shipdate"), "started_at": F.lit("1996-01-01").cast("timestamp_ntz")})
    return Q.violations(li, ["l_orderkey", "l_linenumber", "l_partkey"], Q.provenance())
