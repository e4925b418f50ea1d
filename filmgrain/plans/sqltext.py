"""SQL wording of the views in ``filmgrain.views`` and small SQL expression builders."""

from __future__ import annotations

import re

AT = "CAST(floor((epoch(ts)-1704067200)/10) AS BIGINT)"

VIEWS = {
    "v_clips": """SELECT DISTINCT user_id clip_id, CAST(259200 AS BIGINT) duration_ms,
        user_id%3<>0 audio_available, user_id%4<>0 motion_available FROM events""",
    "v_bounds": f"SELECT user_id clip_id, {AT} position_ms, event_id ord FROM events WHERE event_type='signup'",
    "v_cuts": """SELECT clip_id, position_ms, min(ord) first_ord, max(ord) last_ord FROM v_bounds
        WHERE position_ms > 0 AND position_ms < 259200 GROUP BY 1, 2""",
    "v_kept(clip_id, s)": """SELECT clip_id, CAST(0 AS BIGINT) FROM v_clips UNION ALL
        SELECT k.clip_id, min(c.position_ms) FROM v_kept k JOIN v_cuts c
        ON c.clip_id = k.clip_id AND c.position_ms >= k.s + 10000 GROUP BY k.clip_id""",
    "v_tail": """SELECT clip_id, s, max(s) OVER (PARTITION BY clip_id) mx,
        count(*) OVER (PARTITION BY clip_id) n FROM v_kept""",
    "v_shots": """SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY s) - 1 shot_index, s start_ms,
        coalesce(lead(s) OVER (PARTITION BY clip_id ORDER BY s), 259200) end_ms
        FROM v_tail WHERE NOT (s = mx AND n > 1 AND 259200 - s < 10000)""",
    "v_scores": f"SELECT user_id clip_id, {AT} at_ms, event_id frame_index, value score FROM events",
    "v_flow_pairs": f"""SELECT user_id clip_id, {AT} at_ms, event_id ord, value/100 global_magnitude,
        value/250 residual_median, value/200 residual_p90, CAST(event_id%7 AS DOUBLE)-3 global_dx,
        CAST(event_id%5 AS DOUBLE)-2 global_dy, (event_id%100)/100.0 valid_ratio, value>200 flagged
        FROM events WHERE event_type='click'""",
    "v_shot_pairs": """SELECT p.*, s.shot_index FROM v_flow_pairs p JOIN v_shots s ON p.clip_id=s.clip_id
        AND p.at_ms >= s.start_ms AND p.at_ms < s.end_ms""",
    "v_calm": """SELECT clip_id, shot_index, at_ms, ord, global_magnitude, residual_median residual_magnitude
        FROM v_shot_pairs WHERE NOT flagged""",
    "v_audio": f"""SELECT clip_id, start_ms, avg(value)/10-60 rms_dbfs, avg(value)/50 onset, max(value)/80 flux
        FROM (SELECT user_id clip_id, {AT}-{AT}%500 start_ms, value FROM events WHERE event_type='view')
        GROUP BY 1, 2""",
    "v_frames": f"""SELECT user_id clip_id, {AT} at_ms, event_id frame_index FROM events
        WHERE event_type IN ('purchase','error')""",
    "v_points": """SELECT clip_id, CAST(unnest(range(0, 259200, 500)) AS BIGINT) at_ms, audio_available,
        motion_available FROM v_clips""",
    "v_pixels": """SELECT l_suppkey shot_id, l_linenumber frame_ord, l_orderkey%24 row_i, l_partkey%32 col_i,
        CASE WHEN l_orderkey%24 IN (0,1,22,23) THEN 0 ELSE (l_partkey*37)%256 END r,
        CASE WHEN l_orderkey%24 IN (0,1,22,23) THEN 0 ELSE (l_orderkey*13)%256 END g,
        CASE WHEN l_orderkey%24 IN (0,1,22,23) THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT)%256 END b,
        l_orderkey k1, l_partkey k2 FROM lineitem""",
    "v_linear": "SELECT *, " + ", ".join(
        f"CASE WHEN {c}/255.0::DOUBLE <= 0.04045 THEN {c}/255.0::DOUBLE/12.92::DOUBLE "
        f"ELSE pow(({c}/255.0::DOUBLE+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END l{c}" for c in "rgb"
    ) + " FROM v_pixels",
    "v_xyz": """SELECT *, (0.412453::DOUBLE*lr+0.357580::DOUBLE*lg+0.180423::DOUBLE*lb)/0.950456::DOUBLE x,
        0.212671::DOUBLE*lr+0.715160::DOUBLE*lg+0.072169::DOUBLE*lb y,
        (0.019334::DOUBLE*lr+0.119193::DOUBLE*lg+0.950227::DOUBLE*lb)/1.088754::DOUBLE z FROM v_linear""",
    "v_bent": "SELECT *, " + ", ".join(
        f"CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787::DOUBLE*{c}+16.0::DOUBLE/116.0::DOUBLE END f{c}"
        for c in "xyz"
    ) + " FROM v_xyz",
    "v_lab": """SELECT shot_id, frame_ord, row_i, col_i, r, g, b, k1, k2,
        CASE WHEN y > 0.008856 THEN 116*cbrt(y)-16 ELSE 903.3::DOUBLE*y END lstar,
        500*(fx-fy) a_star, 200*(fy-fz) b_star FROM v_bent""",
    "v_vectors": """SELECT l_suppkey shot_id, l_suppkey*10+l_linenumber pair_id, l_orderkey%24 row_i,
        l_partkey%32 col_i, (l_quantity-25)/10 dx, (l_discount-0.05::DOUBLE)*100 dy, l_tax*100 gradient FROM lineitem""",
    "v_emb": """SELECT vec_id v, label, CAST(embedding[1] AS DOUBLE) e0, CAST(embedding[2] AS DOUBLE) e1,
        CAST(embedding[3] AS DOUBLE) e2, CAST(embedding[4] AS DOUBLE) e3, CAST(embedding[5] AS DOUBLE) e4
        FROM embeddings""",
    "v_detections": """SELECT label*100000+v//240 shot_id, (v%240)//4 sample_ord, v%4 hit_ord,
        CASE WHEN v%5=0 THEN 'bicycle' ELSE 'person' END class_name,
        least(0.3::DOUBLE+2*abs(e4), 1.0::DOUBLE) confidence,
        least(abs(e0),0.45::DOUBLE) x_min, least(abs(e0),0.45::DOUBLE)+0.1::DOUBLE+least(abs(e1),0.4::DOUBLE) x_max,
        least(abs(e2),0.45::DOUBLE) y_min, least(abs(e2),0.45::DOUBLE)+0.1::DOUBLE+least(abs(e3),0.4::DOUBLE) y_max
        FROM v_emb""",
    "v_stage_runs": """SELECT o_custkey analysis_id,
        CASE o_orderkey%3 WHEN 0 THEN 'sampling' WHEN 1 THEN 'report' ELSE 'aggregate' END stage_name,
        row_number() OVER (PARTITION BY o_custkey, o_orderkey%3 ORDER BY o_orderdate, o_orderkey) attempt,
        CASE o_orderstatus WHEN 'O' THEN 'SUCCEEDED' WHEN 'F' THEN 'FAILED_RETRYABLE' ELSE 'PENDING' END state,
        o_orderkey ord, o_orderdate changed_at FROM orders""",
    "v_state_log": """SELECT o_custkey analysis_id, o_orderdate changed_at, o_orderkey ord,
        CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'F' THEN 'RUNNING' ELSE 'SUCCEEDED' END state FROM orders""",
    "v_content": "SELECT doc_id, sha256(text) sha FROM documents",
}


def add_views(views: dict[str, str]) -> None:
    VIEWS.update(views)


# Views that several others read; worked out once instead of at every mention.
SHARED = {"v_shots", "v_calm", "v_point_shots"}


def with_views(body: str, *names: str) -> str:
    """``body`` behind the named views and whatever those need, in definition order."""
    plain = {n.split("(")[0]: n for n in VIEWS}
    need: set[str] = set()
    todo = [*names, *re.findall(r"\bv_\w+", body)]
    while todo:
        n = todo.pop()
        if n in plain and n not in need:
            need.add(n)
            todo += re.findall(r"\bv_\w+", VIEWS[plain[n]])
    ctes = [f"{full} AS {'MATERIALIZED ' if short in SHARED else ''}({VIEWS[full]})" for short, full in plain.items() if short in need]
    head = body.lstrip()
    extra = ""
    if head.upper().startswith("WITH "):
        head = head[5:]
        extra = ", " if ctes else ""
        return f"WITH RECURSIVE {', '.join(ctes)}{extra}{head}"
    return (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + head


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0" + (f" AS {name}" if name else "")


def exact_round(x: str, digits: int) -> str:
    """SQL wording of ``round_decimal``."""
    m = f"{10 ** digits}.0::DOUBLE"
    p = f"(({x})*{m})"
    wide = f"(134217729.0::DOUBLE*({x}))"
    high = f"({wide}-({wide}-({x})))"
    err = f"(({high}*{m}-{p})+(({x})-{high})*{m})"
    return (f"(CASE WHEN {p}-floor({p})=0.5 AND {err}<>0 THEN floor({p})+CASE WHEN {err} > 0 THEN 1 ELSE 0 END "
            f"ELSE round_even({p}, 0) END/{m})")


def uuid_sql(*parts: str) -> str:
    """Name-based identifier (RFC 4122 version 5) in SQL."""
    blob = " || from_hex('00') || ".join(f"encode(CAST({p} AS VARCHAR))" for p in parts)
    h = f"sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || {blob})"
    variant = f"translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return (f"concat(substr({h},1,8),'-',substr({h},9,4),'-5',substr({h},14,3),'-',"
            f"{variant},substr({h},18,3),'-',substr({h},21,12))")
