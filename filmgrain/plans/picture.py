"""Queries over pixels, palettes, detections and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmgrain.config import Chromatic, Spatial
from filmgrain.functions.colour import hex_code, is_marker_colour, lab_to_rgb
from filmgrain.functions.geometry import (
    box_area, box_height, centre_proximity, centroid_x, centroid_y, framing_label, iou, thirds_proximity, truncated,
)
from filmgrain.functions.numeric import dbl, r6
from filmgrain.operators import colour as C, spatial as X
from filmgrain.operators.quantiles import Pick, grouped_quantiles
from filmgrain.plans.registry import query
from filmgrain.plans.sqltext import add_views, r6 as q6
from filmgrain.views import Views

SHOT = ["shot_id"]
ORDER = ["frame_ord", "row_i", "col_i", "k1", "k2", "r", "g", "b"]
CAP = 200


def _chunk():
    return F.col("frame_ord") * 64 + F.col("row_i")


def _d2(x: float, y: float) -> str:
    return f"sqrt((cx-{x!r}::DOUBLE)*(cx-{x!r}::DOUBLE)+(cy-{y!r}::DOUBLE)*(cy-{y!r}::DOUBLE))"


_NEAR = "least(" + ", ".join(_d2(i / 3.0, j / 3.0) for j in (1, 2) for i in (1, 2)) + ")"
_LABEL = """CASE WHEN y_min <= 0.02::DOUBLE AND y_max >= 0.98::DOUBLE THEN 'EXTREME_CLOSE_UP_ESTIMATE' WHEN h < 0.18::DOUBLE THEN 'EXTREME_WIDE_ESTIMATE'
 WHEN h < 0.38::DOUBLE THEN 'WIDE_ESTIMATE' WHEN h < 0.62::DOUBLE THEN 'MEDIUM_ESTIMATE' WHEN h < 0.85::DOUBLE THEN 'CLOSE_UP_ESTIMATE'
 ELSE 'EXTREME_CLOSE_UP_ESTIMATE' END"""
add_views({
    "v_lines": "SELECT shot_id, row_i, avg(CASE WHEN lstar <= 8 THEN 1 ELSE 0 END) share FROM v_lab GROUP BY 1, 2",
    "v_rows": "SELECT shot_id, min(row_i) FILTER (share < 0.92) top, max(row_i) FILTER (share < 0.92) bottom FROM v_lines GROUP BY 1",
    "v_columns": """SELECT p.shot_id, col_i, avg(CASE WHEN lstar <= 8 THEN 1 ELSE 0 END) share FROM v_lab p JOIN v_rows r
      ON r.shot_id=p.shot_id AND p.row_i BETWEEN r.top AND r.bottom GROUP BY 1, 2""",
    "v_picture": """SELECT r.*, c.l "left", c.h "right" FROM v_rows r LEFT JOIN (SELECT shot_id, min(col_i) FILTER (share < 0.92) l,
      max(col_i) FILTER (share < 0.92) h FROM v_columns GROUP BY 1) c ON c.shot_id=r.shot_id""",
    "v_cropped": """SELECT p.* FROM v_lab p JOIN v_picture b ON b.shot_id=p.shot_id WHERE p.row_i BETWEEN b.top AND b.bottom
      AND p.col_i BETWEEN b."left" AND b."right" """,
    "v_usable": """SELECT p.shot_id, count(*) total, count(*) FILTER (p.row_i BETWEEN b.top AND b.bottom AND p.col_i BETWEEN b."left" AND b."right") kept
      FROM v_lab p LEFT JOIN v_picture b ON b.shot_id=p.shot_id GROUP BY 1""",
    "v_ranked_px": """SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY frame_ord, row_i, col_i, k1, k2, r, g, b)-1 pos,
      count(*) OVER (PARTITION BY shot_id) n FROM v_cropped""",
    **{k: q for name, cap in (("v_thin", CAP),) for k, q in {
        f"{name}_steps": f"SELECT shot_id, n, floor(unnest(range(0, {cap}))*(n/{cap}.0::DOUBLE)) pos FROM (SELECT DISTINCT shot_id, n FROM v_ranked_px WHERE n > {cap})",
        name: f"SELECT p.* FROM v_ranked_px p WHERE n <= {cap} OR EXISTS (SELECT 1 FROM {name}_steps s WHERE s.shot_id=p.shot_id AND s.pos=p.pos)",
    }.items()},
    "v_light": """SELECT shot_id, avg(l) mean_lstar, stddev_pop(l) stddev_lstar, quantile_cont(l, 0.1) p10_lstar, quantile_cont(l, 0.5) p50_lstar,
      quantile_cont(l, 0.9) p90_lstar, avg(CASE WHEN l < 20 THEN 1 ELSE 0 END) shadow_ratio, avg(CASE WHEN l > 80 THEN 1 ELSE 0 END) highlight_ratio
      FROM (SELECT shot_id, greatest(0, least(100, lstar)) l FROM v_cropped) GROUP BY 1""",
    "v_tones": """SELECT shot_id*10+frame_ord shot_id, quantile_cont(l*f, 0.1) p10_lstar, quantile_cont(l*f, 0.5) p50_lstar, quantile_cont(l*f, 0.9) p90_lstar,
      avg(CASE WHEN l*f < 20 THEN 1 ELSE 0 END) shadow_ratio FROM (SELECT shot_id, frame_ord, greatest(0, least(100, lstar)) l,
      CASE frame_ord%3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE ELSE 1.5::DOUBLE END f FROM v_lab) GROUP BY 1""",
    "v_keyed": """SELECT *, CASE WHEN p50_lstar < 40 AND (p90_lstar-p10_lstar > 45 OR shadow_ratio > 0.4) THEN 'LOW_KEY_ESTIMATE'
      WHEN p50_lstar > 65 AND shadow_ratio < 0.1 AND p90_lstar-p10_lstar < 45 THEN 'HIGH_KEY_ESTIMATE' ELSE 'BALANCED_ESTIMATE' END k FROM v_tones""",
    "v_centres": """SELECT shot_id, frame_ord%5 c, avg(lstar) lstar, avg(a_star) a_star, avg(b_star) b_star, count(*) n FROM v_lab GROUP BY 1, 2""",
    "v_hex": """SELECT shot_id, h hex, n, w FROM (SELECT shot_id, '#' || h h, count(*) n, min(x) w FROM (SELECT shot_id,
      printf('%02X%02X%02X', r//96*96, g//96*96, b//128*128) h, lstar x FROM v_lab) GROUP BY 1, 2)""",
    "v_boxes": """SELECT *, (x_min+x_max)/2 cx, (y_min+y_max)/2 cy, y_max-y_min h, (x_max-x_min)*(y_max-y_min) area FROM v_detections""",
    "v_obs": "SELECT *, concat('t000', hit_ord+1) track_id FROM v_boxes WHERE class_name='person' AND confidence >= 0.35",
    "v_samples": "SELECT shot_id, count(DISTINCT sample_ord) sample_count FROM v_detections GROUP BY 1",
    "v_cov": """SELECT o.shot_id, o.track_id, count(DISTINCT o.sample_ord)/any_value(s.sample_count) coverage FROM v_obs o JOIN v_samples s
      ON s.shot_id=o.shot_id GROUP BY 1, 2""",
    "v_scored": """SELECT o.shot_id, o.track_id, any_value(c.coverage) coverage, 0.45::DOUBLE*any_value(c.coverage)+0.35::DOUBLE*median(area)+0.20::DOUBLE*median(confidence) score
      FROM v_obs o JOIN v_cov c ON c.shot_id=o.shot_id AND c.track_id=o.track_id GROUP BY 1, 2 HAVING any_value(c.coverage) >= 0.2""",
    "v_primary": "SELECT shot_id, track_id, coverage, score FROM (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY score DESC, track_id) k FROM v_scored) WHERE k=1",
    "v_labelled": f"SELECT *, {_LABEL} label FROM v_obs",
    "v_votes": """SELECT shot_id, track_id, label, count(*) n, CASE label WHEN 'EXTREME_WIDE_ESTIMATE' THEN 1 WHEN 'WIDE_ESTIMATE' THEN 2
      WHEN 'MEDIUM_ESTIMATE' THEN 3 WHEN 'CLOSE_UP_ESTIMATE' THEN 4 ELSE 5 END o FROM v_labelled GROUP BY ALL""",
    "v_framing": """SELECT shot_id, track_id, CASE WHEN 1-wins/votes > 0.4 THEN 'UNDETERMINED' ELSE label END framing, wins, votes FROM (
      SELECT *, max(n) OVER w wins, sum(n) OVER w votes, row_number() OVER (PARTITION BY shot_id, track_id ORDER BY n DESC, o) k FROM v_votes
      WINDOW w AS (PARTITION BY shot_id, track_id)) WHERE k=1""",
    "v_heights": "SELECT shot_id, track_id, median(confidence) det, list_sort(list(h)) hs FROM v_obs GROUP BY 1, 2",
    "v_fconf": """SELECT f.shot_id, f.track_id, framing, greatest(0, least(1, CASE WHEN framing='UNDETERMINED' THEN 0.25::DOUBLE*det+0.35::DOUBLE*coverage
      ELSE 0.35::DOUBLE*det+0.30::DOUBLE*coverage+0.20::DOUBLE*wins/votes+0.15::DOUBLE*least(1, list_min(list_transform([0.0,0.18,0.38,0.62,0.85,1.0]::DOUBLE[],
      lambda b: abs(hs[len(hs)//2+1]-b)))/0.08::DOUBLE) END)) framing_confidence FROM v_framing f JOIN v_heights h ON h.shot_id=f.shot_id AND h.track_id=f.track_id
      JOIN v_cov c ON c.shot_id=f.shot_id AND c.track_id=f.track_id""",
})
_CFG = Spatial()


def with_floor():
    """Track floor lowered to 0.2 so both outcomes occur on the driver tables."""
    from dataclasses import replace
    return replace(_CFG, framing_rules=replace(_CFG.framing_rules, min_track_coverage=0.2))


@query("prj07_lab_colour", f"SELECT k1, k2, frame_ord, shot_id, {q6('lstar', 'lstar')}, {q6('a_star', 'a_star')}, {q6('b_star', 'b_star')} FROM v_lab")
def prj07(v):
    out = C.with_lab(v.pixels())
    return out.select("k1", "k2", "frame_ord", "shot_id", *[r6(F.col(c)).alias(c) for c in ("lstar", "a_star", "b_star")])


@query("prj07_lab_round_trip", "SELECT k1, k2, shot_id, frame_ord, printf('#%02X%02X%02X', r, g, b) hex FROM v_pixels")
def prj07_back(v):
    px = C.with_lab(v.pixels()).drop("r", "g", "b")
    rgb = lab_to_rgb(F.col("lstar"), F.col("a_star"), F.col("b_star"))
    return px.withColumns(rgb).select("k1", "k2", "shot_id", "frame_ord", hex_code(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


_HUE = """CASE WHEN sp=0 THEN 0 WHEN mx=r THEN 60.0::DOUBLE*(g-b)/sp WHEN mx=g THEN 120+60.0::DOUBLE*(b-r)/sp ELSE 240+60.0::DOUBLE*(r-g)/sp END"""
add_views({
    "v_marked": f"""SELECT * FROM (SELECT *, round_even(CASE WHEN t < 0 THEN t+360 ELSE t END/2, 0) hue, CASE WHEN mx=0 THEN 0 ELSE round_even(255.0::DOUBLE*sp/mx, 0) END sat
      FROM (SELECT *, {_HUE} t FROM (SELECT *, greatest(r,g,b) mx, greatest(r,g,b)-least(r,g,b) sp FROM v_pixels)))
      WHERE hue BETWEEN 130 AND 170 AND sat >= 80 AND mx >= 80""",
})


@query("prj08_marker_pixels", "SELECT k1, k2, frame_ord, shot_id, r, g, b FROM v_marked")
def prj08(v):
    px = v.pixels()
    return px.where(is_marker_colour(F.col("r"), F.col("g"), F.col("b"))).select("k1", "k2", "frame_ord", "shot_id", "r", "g", "b")


@query("ag04_blob_boxes", f"""
SELECT shot_id, frame_ord, {q6('min(col_i)/32', 'x_min')}, {q6('min(row_i)/24', 'y_min')}, {q6('(max(col_i)+1)/32', 'x_max')},
 {q6('(max(row_i)+1)/24', 'y_max')}, 0.9::DOUBLE confidence FROM v_marked GROUP BY 1, 2 HAVING count(*) >= 8""")
def ag04(v):
    out = X.blob_boxes(v.pixels(), ["shot_id", "frame_ord"], 24, 32)
    return out.select("shot_id", "frame_ord", *[r6(F.col(c)).alias(c) for c in X.BOX], "confidence")


@query("wn08_letterbox_bounds", 'SELECT shot_id, top, bottom, "left", "right" FROM v_picture')
def wn08(v):
    return C.picture_bounds(v.pixels(), SHOT).select("shot_id", "top", "bottom", "left", "right")


@query("wn09_spread_pixels", "SELECT shot_id, frame_ord, row_i, col_i, k1, k2 FROM v_thin")
def wn09(v):
    px = v.pixels()
    kept = C.crop(px, C.picture_bounds(px, SHOT), SHOT)
    return C.spread_pixels(kept, "shot_id", ORDER, _chunk(), CAP).select("shot_id", "frame_ord", "row_i", "col_i", "k1", "k2")


def kept_colours(v: Views):
    """Counted colours of all pixels inside the picture of each shot."""
    return C.framed_colours(C.framed_columns(v.pixels(), SHOT))


_L = ("mean_lstar", "stddev_lstar", "p10_lstar", "p50_lstar", "p90_lstar", "shadow_ratio", "highlight_ratio")


@query("ag02_lightness", f"SELECT shot_id, {', '.join(q6(c, c) for c in _L)} FROM v_light")
def ag02(v):
    return C.lightness(kept_colours(v)).select("shot_id", *[r6(F.col(c)).alias(c) for c in _L])


@query("ag03_colour_status", f"""
SELECT shot_id, {q6('u', 'usable_pixel_ratio')}, CASE WHEN shot_id%11=0 THEN 'INSUFFICIENT_DATA' WHEN shot_id%7=0 THEN 'FAILED' WHEN u < 0.834 OR kept=0 THEN 'INSUFFICIENT_DATA'
 WHEN shot_id%5=0 THEN 'FAILED' ELSE 'OK' END status, CASE WHEN shot_id%11=0 THEN 'chromatic_no_decoded_samples' WHEN shot_id%7=0 THEN 'chromatic_decode_failed'
 WHEN u < 0.834 THEN 'chromatic_letterbox_insufficient' WHEN kept=0 THEN 'chromatic_no_usable_pixels' WHEN shot_id%5=0 THEN 'chromatic_cluster_failed' END reason_code
FROM (SELECT *, kept/total u FROM v_usable)""")
def ag03(v):
    s = F.col("shot_id")
    df = C.usable_pixels(C.picture_bounds(v.pixels(), SHOT)).withColumns({
        "requested_frames": F.when(F.pmod(s, F.lit(11)) == 0, 0).otherwise(3),
        "decoded_frames": F.when(F.pmod(s, F.lit(7)) == 0, 0).otherwise(3),
        "swatches": F.when(F.pmod(s, F.lit(5)) == 0, 0).otherwise(2),
    }).withColumns(C.colour_status(Chromatic(min_usable_pixel_ratio=0.834)))
    return df.select("shot_id", r6(F.col("usable_pixel_ratio")).alias("usable_pixel_ratio"), "status", "reason_code")


def _tones(v: Views):
    """Lightness of single frames, dimmed or lifted by frame so every key label occurs."""
    f = F.pmod("frame_ord", F.lit(3))
    gain = F.when(f == 0, dbl(1)).when(f == 1, dbl(0.6)).otherwise(dbl(1.5))
    px = C.with_lab(v.pixels()).withColumns({
        "lstar": F.greatest(dbl(0), F.least(dbl(100), F.col("lstar"))) * gain, "shot_id": F.col("shot_id") * 10 + F.col("frame_ord")})
    picks = [Pick("p10_lstar", q=0.1), Pick("p50_lstar"), Pick("p90_lstar", q=0.9)]
    dark = px.groupBy("shot_id").agg(F.avg((F.col("lstar") < 20).cast("int")).alias("shadow_ratio"))
    return grouped_quantiles(px, ["shot_id"], "lstar", picks).join(dark, "shot_id")


@query("prj12_lighting_key", "SELECT shot_id, k lighting_key FROM v_keyed")
def prj12(v):
    return _tones(v).select("shot_id", C.lighting_key().alias("lighting_key"))


@query("prj13_lighting_confidence", f"""
SELECT shot_id, {q6('''greatest(0, least(1, CASE k WHEN 'LOW_KEY_ESTIMATE' THEN 0.45::DOUBLE+0.4::DOUBLE*(40-p50_lstar)/40
 +CASE WHEN p90_lstar-p10_lstar > 45 THEN 0.15::DOUBLE ELSE 0 END+CASE WHEN shadow_ratio > 0.4 THEN 0.15::DOUBLE ELSE 0 END
 WHEN 'HIGH_KEY_ESTIMATE' THEN 0.5::DOUBLE+0.4::DOUBLE*(p50_lstar-65)/35 ELSE 0.35::DOUBLE+least(abs(p50_lstar-40), abs(p50_lstar-65))/80 END))''', 'confidence')} FROM v_keyed""")
def prj13(v):
    return _tones(v).select("shot_id", r6(C.lighting_confidence(C.lighting_key())).alias("confidence"))


_DS = "list_transform(cs, lambda c: (l-c.l)*(l-c.l)+(a-c.a)*(a-c.a)+(b-c.b)*(b-c.b))"


add_views({
    "v_colours": "SELECT shot_id, round(lstar, 3) l, round(a_star, 3) a, round(b_star, 3) b, count(*) n FROM v_cropped GROUP BY ALL",
    "v_indexed": "SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY l, a, b) i, count(*) OVER (PARTITION BY shot_id) distinct_n FROM v_colours",
    "v_seeds(shot_id, k, cs)": f"""SELECT shot_id, least(5, distinct_n), [{{'l': l, 'a': a, 'b': b}}] FROM (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY n DESC, i) w FROM v_indexed) WHERE w=1
      UNION ALL SELECT shot_id, k, list_append(cs, p) FROM (SELECT s.shot_id, s.k, s.cs, arg_max({{'l': l, 'a': a, 'b': b}}, list_min({_DS})) p FROM v_seeds s JOIN v_indexed o ON o.shot_id=s.shot_id
      WHERE len(s.cs) < s.k GROUP BY 1, 2, 3)""",
    "v_moves(shot_id, it, k, cs, moved)": f"""SELECT shot_id, 0, k, cs, true FROM v_seeds WHERE len(cs)=k UNION ALL
      SELECT shot_id, it+1, k, ns, ns<>cs FROM (SELECT shot_id, it, k, cs, list_transform(range(1, k+1), lambda j: coalesce(list_filter(g, lambda x: x.j=j)[1].c, cs[j])) ns FROM (
      SELECT shot_id, it, k, cs, list({{'j': j, 'c': {{'l': ml, 'a': ma, 'b': mb}}}}) g FROM (
      SELECT shot_id, it, k, cs, j, sum(n*l)/sum(n) ml, sum(n*a)/sum(n) ma, sum(n*b)/sum(n) mb FROM (
      SELECT m.shot_id, m.it, m.k, m.cs, o.n, o.l, o.a, o.b, list_position({_DS}, list_min({_DS})) j FROM v_moves m JOIN v_indexed o ON o.shot_id=m.shot_id WHERE m.moved) GROUP BY 1, 2, 3, 4, 5)
      GROUP BY 1, 2, 3, 4))""",
    "v_settled": "SELECT shot_id, arg_max(cs, it) cs FROM v_moves GROUP BY 1",
    "v_found": f"""SELECT shot_id, any_value(cs[j].l) lstar, any_value(cs[j].a) a_star, any_value(cs[j].b) b_star, sum(n)::BIGINT n FROM (
      SELECT f.shot_id, f.cs, o.n, list_position({_DS}, list_min({_DS})) j FROM v_settled f JOIN v_indexed o ON o.shot_id=f.shot_id) GROUP BY shot_id, j""",
})


@query("ag14_palette_centres", f"""
SELECT shot_id, {q6('lstar+1e-9', 'lstar')}, {q6('a_star+1e-9', 'a_star')}, {q6('b_star+1e-9', 'b_star')}, n FROM v_found""")
def ag14(v):
    # Means of three-place values often end in an exact half; both sides lean up by 1e-9.
    return C.palette_centres(kept_colours(v)).select("shot_id", *[r6(F.col(c) + dbl(1e-9)).alias(c) for c in ("lstar", "a_star", "b_star")], "n")


def _centres(v: Views):
    """Mean colours of five groups of frames, standing in for cluster centres."""
    px = C.with_lab(v.pixels()).withColumn("part", F.pmod("frame_ord", F.lit(5)))
    return px.groupBy("shot_id", "part").agg(
        *[F.avg(c).alias(c) for c in ("lstar", "a_star", "b_star")], F.count(F.lit(1)).alias("n")).drop("part")


def _fold_sql(source: str, limit: float, name: str) -> dict[str, str]:
    """Views that fold centres, heaviest first, into the first one nearer than ``limit``."""
    near = f"list_transform(st, lambda x: sqrt((x.l-lstar)*(x.l-lstar)+(x.a-a_star)*(x.a-a_star)+(x.b-b_star)*(x.b-b_star)) < {limit})"
    return {
        f"{name}_in": f"SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY n DESC, lstar, a_star, b_star) k FROM {source}",
        f"{name}_fold(shot_id, k, st)": f"""SELECT shot_id, CAST(1 AS BIGINT), [{{'l': lstar, 'a': a_star, 'b': b_star, 'n': n}}] FROM {name}_in WHERE k=1
          UNION ALL SELECT shot_id, k, CASE WHEN p IS NULL OR p=0 THEN list_append(st, c) ELSE list_concat(st[:p-1], [{{'l': (st[p].l*st[p].n+c.l*c.n)/(st[p].n+c.n),
          'a': (st[p].a*st[p].n+c.a*c.n)/(st[p].n+c.n), 'b': (st[p].b*st[p].n+c.b*c.n)/(st[p].n+c.n), 'n': st[p].n+c.n}}], st[p+1:]) END
          FROM (SELECT f.shot_id, o.k, st, {{'l': lstar, 'a': a_star, 'b': b_star, 'n': n}} c, list_position({near}, true) p
          FROM {name}_fold f JOIN {name}_in o ON o.shot_id=f.shot_id AND o.k=f.k+1)""",
        name: f"SELECT shot_id, m.l lstar, m.a a_star, m.b b_star, CAST(m.n AS BIGINT) n FROM (SELECT shot_id, unnest(st) m FROM (SELECT shot_id, arg_max(st, k) st FROM {name}_fold GROUP BY 1))",
    }


def _cube(f: str) -> str:
    return f"CASE WHEN {f} > cbrt(0.008856::DOUBLE) THEN {f}*{f}*{f} ELSE ({f}-16.0::DOUBLE/116)/7.787::DOUBLE END"


def _byte(c: str) -> str:
    c = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {c}))"
    return f"CAST(round_even(255*(CASE WHEN {c} <= 0.0031308 THEN {c}*12.92::DOUBLE ELSE 1.055::DOUBLE*pow({c}, 1.0::DOUBLE/2.4::DOUBLE)-0.055::DOUBLE END), 0) AS INT)"


add_views({
    **_fold_sql("v_centres", 8, "v_blended"),
    **_fold_sql("v_found", 3, "v_palette"),
    "v_fy": "SELECT *, CASE WHEN lstar > 903.3::DOUBLE*0.008856::DOUBLE THEN (lstar+16)/116 ELSE 7.787::DOUBLE*lstar/903.3::DOUBLE+16.0::DOUBLE/116 END fy FROM v_palette",
    "v_xyz_back": f"""SELECT shot_id, lstar, n, ({_cube('(fy+a_star/500)')})*0.950456::DOUBLE x, CASE WHEN lstar > 903.3::DOUBLE*0.008856::DOUBLE THEN fy*fy*fy ELSE lstar/903.3::DOUBLE END y,
      ({_cube('(fy-b_star/200)')})*1.088754::DOUBLE z FROM v_fy""",
    "v_swatch_hex": f"""SELECT shot_id, n, printf('#%02X%02X%02X', {_byte('(3.240479::DOUBLE*x-1.537150::DOUBLE*y-0.498535::DOUBLE*z)')},
      {_byte('(-0.969256::DOUBLE*x+1.875991::DOUBLE*y+0.041556::DOUBLE*z)')}, {_byte('(0.055648::DOUBLE*x-0.204043::DOUBLE*y+1.057311::DOUBLE*z)')}) hex FROM v_xyz_back""",
    "v_hex_once": "SELECT shot_id, hex, sum(n)::BIGINT n FROM v_swatch_hex GROUP BY 1, 2",
})


def rank_sql(source: str, share: str) -> str:
    return f"""
WITH t AS (SELECT *, sum(n) OVER (PARTITION BY shot_id) total, row_number() OVER (PARTITION BY shot_id ORDER BY n DESC, hex) k FROM {source}),
kept AS (SELECT shot_id, hex, n FROM t WHERE n >= greatest(1, floor({share}::DOUBLE*total)) OR k=1),
s AS (SELECT *, row_number() OVER o rk, count(*) OVER (PARTITION BY shot_id) nk, n/sum(n) OVER (PARTITION BY shot_id) p FROM kept
 WINDOW o AS (PARTITION BY shot_id ORDER BY n DESC, hex))
SELECT shot_id, hex, n, rk AS "rank", {q6('CASE WHEN rk=nk THEN 1-coalesce(sum(p) OVER (PARTITION BY shot_id ORDER BY n DESC, hex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE p END', 'proportion')} FROM s"""


@query("ag15_merge_centres", f"SELECT shot_id, {q6('lstar', 'lstar')}, {q6('a_star', 'a_star')}, {q6('b_star', 'b_star')}, n FROM v_blended")
def ag15(v):
    out = C.merge_centres(_centres(v), "shot_id", 8.0)
    return out.select("shot_id", *[r6(F.col(c)).alias(c) for c in ("lstar", "a_star", "b_star")], "n")


def _hexes(v: Views):
    """Pixels snapped to a coarse colour grid: a handful of swatches per shot."""
    px = C.with_lab(v.pixels())
    snap = {c: F.floor(F.col(c) / w).cast("int") * w for c, w in (("r", 96), ("g", 96), ("b", 128))}
    return px.withColumns(snap).withColumn("hex", hex_code(F.col("r"), F.col("g"), F.col("b")))


@query("ag16_merge_equal_hex", f"""
SELECT shot_id, hex, m.n n, {q6('m.l', 'lstar')} FROM (SELECT shot_id, h hex, list_reduce(list({{'n': n, 'l': l}} ORDER BY frame_ord),
 lambda x, y: {{'n': x.n+y.n, 'l': CASE WHEN x.n >= y.n THEN x.l ELSE y.l END}}) m FROM (SELECT shot_id, frame_ord, '#' || printf('%02X%02X%02X', r//96*96, g//96*96, b//128*128) h,
 count(*)::BIGINT n, round(min(lstar), 6) l FROM v_lab GROUP BY 1, 2, 3) GROUP BY 1, 2)""")
def ag16(v):
    drafts = _hexes(v).groupBy("shot_id", "frame_ord", "hex").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("lstar"), 6).alias("lstar"))
    out = C.merge_equal_hex(drafts.withColumns({"a_star": dbl(0), "b_star": dbl(0)}), order="frame_ord")
    return out.select("shot_id", "hex", "n", r6(F.col("lstar")).alias("lstar"))


@query("ag17_rank_swatches", rank_sql("v_hex", "0.07"))
def ag17(v):
    sw = _hexes(v).groupBy("shot_id", "hex").agg(F.count(F.lit(1)).alias("n"))
    return C.rank_swatches(sw, "shot_id", 0.07).select("shot_id", "hex", "n", F.col("rank").cast("bigint").alias("rank"), r6(F.col("proportion")).alias("proportion"))


# Shots of the colour queries: one a part, so some have no pixels; every eleventh asked for none.
add_views({
    "v_colour_shots": """SELECT *, coalesce(kept/nullif(total, 0), 0) u, CASE WHEN p_partkey%11=0 THEN 'chromatic_no_decoded_samples' WHEN total IS NULL THEN 'chromatic_decode_failed'
      WHEN coalesce(kept/nullif(total, 0), 0) < 0.834 THEN 'chromatic_letterbox_insufficient' WHEN kept=0 THEN 'chromatic_no_usable_pixels' END why
      FROM (SELECT p_partkey FROM part) LEFT JOIN v_usable ON shot_id=p_partkey""",
    "v_hex_good": "SELECT h.* FROM v_hex_once h JOIN v_colour_shots s ON s.p_partkey=h.shot_id WHERE why IS NULL",
})


def _colour(v: Views):
    k = F.col("p_partkey")
    shots = v.table("part").select(k.alias("shot_id"), F.when(F.pmod(k, F.lit(11)) == 0, 0).otherwise(3).alias("requested_frames"))
    return C.shot_colour(v.pixels(), SHOT, shots, Chromatic(min_usable_pixel_ratio=0.834))


@query("shot_colour_values", f"""
SELECT s.p_partkey shot_id, {q6('u', 'usable_pixel_ratio')}, CASE WHEN why IS NULL THEN 'OK' WHEN why='chromatic_decode_failed' THEN 'FAILED' ELSE 'INSUFFICIENT_DATA' END status, why reason_code,
 {', '.join(q6(f'CASE WHEN why IS NULL THEN {c} END', c) for c in _L)} FROM v_colour_shots s LEFT JOIN v_light l ON l.shot_id=s.p_partkey""")
def shot_colour_values(v):
    values, _ = _colour(v)
    return values.select("shot_id", r6(F.col("usable_pixel_ratio")).alias("usable_pixel_ratio"), "status", "reason_code", *[r6(F.col(c)).alias(c) for c in _L])


@query("shot_palette", rank_sql("v_hex_good", "0.02"))
def shot_palette(v):
    """Whole colour chain per shot: crop, count, cluster, merge and rank."""
    _, sw = _colour(v)
    return sw.select("shot_id", F.col("rank").cast("bigint").alias("rank"), "hex", "n", r6(F.col("proportion")).alias("proportion"))


# --- detections ---------------------------------------------------------------

_GEO = ("cx", "cy", "area", "height")


@query("prj09_box_geometry", f"""
SELECT a.shot_id, a.sample_ord, a.hit_ord, {q6('a.cx', 'cx')}, {q6('a.cy', 'cy')}, {q6('a.area', 'area')}, {q6('a.h', 'height')},
 (a.y_min <= 0.1::DOUBLE AND a.y_max >= 1.0-0.5::DOUBLE) truncated,
 {q6('greatest(0, least(a.x_max, 0.6::DOUBLE)-greatest(a.x_min, 0.2::DOUBLE))*greatest(0, least(a.y_max, 0.6::DOUBLE)-greatest(a.y_min, 0.2::DOUBLE))/(a.area+0.16::DOUBLE-greatest(0, least(a.x_max, 0.6::DOUBLE)-greatest(a.x_min, 0.2::DOUBLE))*greatest(0, least(a.y_max, 0.6::DOUBLE)-greatest(a.y_min, 0.2::DOUBLE)))', 'iou')}
FROM v_boxes a""")
def prj09(v):
    d = v.detections().withColumns({
        "p": F.struct(*X.BOX), "q": F.struct(dbl(0.2).alias("x_min"), dbl(0.2).alias("y_min"), dbl(0.6).alias("x_max"), dbl(0.6).alias("y_max"))})
    trunc = (F.col("y_min") <= dbl(0.1)) & (F.col("y_max") >= dbl(0.5))
    return d.select("shot_id", "sample_ord", "hit_ord", r6(centroid_x()).alias("cx"), r6(centroid_y()).alias("cy"), r6(box_area()).alias("area"),
                    r6(box_height()).alias("height"), trunc.alias("truncated"), r6(iou("p", "q")).alias("iou"))


@query("prj10_proximity", f"""
SELECT shot_id, sample_ord, hit_ord, {q6(f'exp(-({_NEAR}/0.18::DOUBLE)*({_NEAR}/0.18::DOUBLE))', 'thirds')},
 {q6(f'exp(-({_d2(0.5, 0.5)}/0.18::DOUBLE)*({_d2(0.5, 0.5)}/0.18::DOUBLE))', 'centre')} FROM v_boxes""")
def prj10(v):
    return v.detections().select("shot_id", "sample_ord", "hit_ord", r6(thirds_proximity(centroid_x(), centroid_y(), 0.18)).alias("thirds"),
                                 r6(centre_proximity(centroid_x(), centroid_y(), 0.18)).alias("centre"))


@query("prj11_framing_label", f"SELECT shot_id, sample_ord, hit_ord, {_LABEL} framing FROM v_boxes")
def prj11(v):
    return v.detections().select("shot_id", "sample_ord", "hit_ord", framing_label(_CFG.framing_rules).alias("framing"))


def _obs(v: Views):
    d = v.detections().where((F.col("class_name") == "person") & (F.col("confidence") >= _CFG.person_confidence))
    return d.withColumn("track_id", F.concat(F.lit("t000"), (F.col("hit_ord") + 1).cast("string")))


def _counts(v: Views):
    return v.detections().groupBy("shot_id").agg(F.countDistinct("sample_ord").alias("sample_count"))


@query("ag07_track_coverage", f"SELECT shot_id, track_id, {q6('coverage', 'coverage')} FROM v_cov")
def ag07(v):
    return X.track_coverage(_obs(v), _counts(v)).select("shot_id", "track_id", r6(F.col("coverage")).alias("coverage"))


@query("ag08_primary_track", f"SELECT shot_id, track_id, {q6('coverage', 'coverage')}, {q6('score', 'score')} FROM v_primary")
def ag08(v):
    return X.primary_tracks(_obs(v), _counts(v), with_floor()).select("shot_id", "track_id", r6(F.col("coverage")).alias("coverage"), r6(F.col("score")).alias("score"))


@query("tk05_rank_one_track", "SELECT shot_id, track_id FROM v_primary")
def tk05(v):
    return X.primary_tracks(_obs(v), _counts(v), with_floor()).select("shot_id", "track_id")


_V = ("subject_coverage_ratio_median", "subject_height_ratio_median", "thirds_proximity_score", "thirds_proximity_p10", "center_proximity_score")


VALUES = f"""
WITH t AS (SELECT o.*, exp(-({_NEAR}/0.18::DOUBLE)*({_NEAR}/0.18::DOUBLE)) th, exp(-({_d2(0.5, 0.5)}/0.18::DOUBLE)*({_d2(0.5, 0.5)}/0.18::DOUBLE)) ce
 FROM v_obs o JOIN v_primary p ON p.shot_id=o.shot_id AND p.track_id=o.track_id),
m AS (SELECT shot_id, track_id, median(area) a, median(h) h, median(th) t, list_sort(list(th)) ts, median(ce) c FROM t GROUP BY 1, 2)
SELECT m.shot_id, m.track_id primary_track_id, {q6('a', _V[0])}, {q6('h', _V[1])}, {q6('t', _V[2])}, {q6('ts[CAST(floor(0.1::DOUBLE*(len(ts)-1)) AS BIGINT)+1]', _V[3])}, {q6('c', _V[4])},
 f.framing, {q6('f.framing_confidence', 'framing_confidence')} FROM m JOIN v_fconf f ON f.shot_id=m.shot_id AND f.track_id=m.track_id"""


@query("ag09_spatial_values", VALUES)
def ag09(v):
    obs, cfg = _obs(v), with_floor()
    out = X.spatial_values(obs, _counts(v), cfg)
    return out.select("shot_id", "primary_track_id", *[r6(F.col(c)).alias(c) for c in _V], "framing", r6(F.col("framing_confidence")).alias("framing_confidence"))


@query("ag10_framing_vote", "SELECT shot_id, track_id, framing, wins, CAST(votes AS BIGINT) votes FROM v_framing")
def ag10(v):
    return X.framing_votes(_obs(v), ["shot_id", "track_id"]).select("shot_id", "track_id", "framing", "wins", "votes")


@query("ag11_framing_confidence", f"SELECT shot_id, track_id, framing, {q6('framing_confidence', 'framing_confidence')} FROM v_fconf")
def ag11(v):
    obs = _obs(v)
    out = X.framing_confidence(obs, X.track_coverage(obs, _counts(v)), ["shot_id", "track_id"])
    return out.select("shot_id", "track_id", "framing", r6(F.col("framing_confidence")).alias("framing_confidence"))


_IW = "greatest(0, least(boxes[t].x1, hs[i].x1)-greatest(boxes[t].x0, hs[i].x0))*greatest(0, least(boxes[t].y1, hs[i].y1)-greatest(boxes[t].y0, hs[i].y0))"
_IOU = (f"({_IW})/((boxes[t].x1-boxes[t].x0)*(boxes[t].y1-boxes[t].y0)+(hs[i].x1-hs[i].x0)*(hs[i].y1-hs[i].y0)-{_IW})")


TRACKS = f"""
WITH b AS (SELECT shot_id, sample_ord, list({{'h': hit_ord, 'x0': x_min, 'y0': y_min, 'x1': x_max, 'y1': y_max}} ORDER BY hit_ord) hs FROM v_boxes
  WHERE class_name='person' AND confidence >= 0.35 GROUP BY 1, 2),
h AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY sample_ord) k FROM b),
r(shot_id, k, boxes, got) AS (
 SELECT DISTINCT shot_id, CAST(0 AS BIGINT), []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[], []::STRUCT(h BIGINT, t BIGINT)[] FROM h UNION ALL
 SELECT shot_id, k, list_transform(range(1, len(boxes)+1), lambda t: CASE WHEN len(list_filter(ch, lambda g: g.t=t)) > 0 THEN
   {{'x0': hs[list_filter(ch, lambda g: g.t=t)[1].i].x0, 'y0': hs[list_filter(ch, lambda g: g.t=t)[1].i].y0, 'x1': hs[list_filter(ch, lambda g: g.t=t)[1].i].x1, 'y1': hs[list_filter(ch, lambda g: g.t=t)[1].i].y1}}
   ELSE boxes[t] END) || list_transform(free, lambda i: {{'x0': hs[i].x0, 'y0': hs[i].y0, 'x1': hs[i].x1, 'y1': hs[i].y1}}),
  list_transform(ch, lambda g: {{'h': hs[g.i].h, 't': g.t}}) || list_transform(free, lambda i: {{'h': hs[i].h, 't': len(boxes)+list_position(free, i)}})
 FROM (SELECT *, list_filter(range(1, len(hs)+1), lambda i: len(list_filter(ch, lambda g: g.i=i)) = 0) free FROM (
  SELECT *, list_reduce(list_transform(list_sort(list_filter(flatten(list_transform(range(1, len(boxes)+1), lambda t: list_transform(range(1, len(hs)+1), lambda i: {{'s': -({_IOU}), 't': t, 'i': i}}))),
    lambda p: p.s <= -0.3::DOUBLE)), lambda p: {{'t': p.t, 'i': p.i, 'got': []::STRUCT(t BIGINT, i BIGINT)[]}}),
   lambda acc, x: CASE WHEN len(list_filter(acc.got, lambda g: g.t=x.t OR g.i=x.i)) > 0 THEN acc ELSE {{'t': x.t, 'i': x.i, 'got': list_append(acc.got, {{'t': x.t, 'i': x.i}})}} END,
   {{'t': 0::BIGINT, 'i': 0::BIGINT, 'got': []::STRUCT(t BIGINT, i BIGINT)[]}}).got ch
  FROM (SELECT r.shot_id, h.k, r.boxes, h.hs FROM r JOIN h ON h.shot_id=r.shot_id AND h.k=r.k+1)))),
u AS (SELECT shot_id, k, unnest(got) g FROM r)
SELECT u.shot_id, h.sample_ord, u.g.h hit_ord, 't' || lpad(CAST(u.g.t AS VARCHAR), 4, '0') track_id, {q6('d.cx', 'centroid_x')}, {q6('d.cy', 'centroid_y')} FROM u JOIN h ON h.shot_id=u.shot_id AND h.k=u.k
JOIN v_boxes d ON d.shot_id=u.shot_id AND d.sample_ord=h.sample_ord AND d.hit_ord=u.g.h"""


@query("wn21_track_subjects", TRACKS)
def wn21(v):
    out = X.track_subjects(v.detections())
    return out.select("shot_id", "sample_ord", "hit_ord", "track_id", r6(F.col("centroid_x")).alias("centroid_x"), r6(F.col("centroid_y")).alias("centroid_y"))
