"""Queries over cuts, shots and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmgrain.config import Shots
from filmgrain.functions.numeric import r6
from filmgrain.operators import shots as S
from filmgrain.plans import sqltext as Q
from filmgrain.plans.registry import query
from filmgrain.views import MERGE, Views


@query("wn01_score_changes", f"""
WITH w AS (SELECT *, sum(score) OVER k s, count(*) OVER k n FROM v_scores
  WINDOW k AS (PARTITION BY clip_id ORDER BY at_ms, frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT *, CASE WHEN n > 1 THEN (s-score)/(n-1) END mean FROM w),
r AS (SELECT *, CASE WHEN mean > 0 THEN score/mean END ratio FROM m)
SELECT clip_id, at_ms, frame_index, score, {Q.r6('ratio', 'ratio')} FROM r
WHERE (ratio IS NULL OR ratio >= 3.0) AND score >= 15.0""")
def wn01(v: Views):
    out = S.score_changes(v.scores())
    return out.select("clip_id", "at_ms", "frame_index", "score", r6(F.col("ratio")).alias("ratio"))


@query("wn01_score_changes_content", "SELECT clip_id, at_ms, frame_index, score FROM v_scores WHERE score >= 100.0")
def wn01_content(v: Views):
    rules = Shots(detector="content", threshold=100.0)
    return S.score_changes(v.scores(), rules).select("clip_id", "at_ms", "frame_index", "score")


@query("wn02_internal_cuts", "SELECT clip_id, position_ms, first_ord FROM v_cuts")
def wn02(v: Views):
    return v.cuts().select("clip_id", "position_ms", "first_ord")


@query("wn03_raw_intervals", """
WITH e AS (SELECT clip_id, 0 p FROM v_clips UNION ALL SELECT clip_id, position_ms FROM v_cuts)
SELECT clip_id, row_number() OVER w - 1 shot_index, CAST(p AS BIGINT) start_ms,
  CAST(coalesce(lead(p) OVER w, 259200) AS BIGINT) end_ms FROM e WINDOW w AS (PARTITION BY clip_id ORDER BY p)""")
def wn03(v: Views):
    return S.raw_intervals(v.cuts(), v.clips())


@query("wn04_merge_short_shots", "SELECT clip_id, start_ms, end_ms FROM v_shots")
def wn04(v: Views):
    return v.shots().select("clip_id", "start_ms", "end_ms")


@query("wn05_shot_set",
       f"SELECT clip_id, shot_index, start_ms, end_ms, {Q.uuid_sql('clip_id', chr(39) + 'shot' + chr(39), 'shot_index')} shot_id FROM v_shots")
def wn05(v: Views):
    return S.with_shot_ids(v.shots()).select("clip_id", "shot_index", "start_ms", "end_ms", "shot_id")


_BID = Q.uuid_sql("s.clip_id", "'boundary'", "{p}")


@query("jn11_shot_boundaries", f"""
SELECT s.clip_id, s.shot_index, s.start_ms, s.end_ms,
  CASE WHEN i.last_ord IS NOT NULL THEN {_BID.format(p='s.start_ms')} END incoming_boundary_id,
  CASE WHEN o.last_ord IS NOT NULL THEN {_BID.format(p='s.end_ms')} END outgoing_boundary_id,
  i.last_ord incoming_ord, o.last_ord outgoing_ord
FROM v_shots s LEFT JOIN v_cuts i ON i.clip_id=s.clip_id AND i.position_ms=s.start_ms
LEFT JOIN v_cuts o ON o.clip_id=s.clip_id AND o.position_ms=s.end_ms""")
def jn11(v: Views):
    cuts = v.cuts()
    out = S.attach_boundaries(S.merge_short_shots(cuts, v.clips(), MERGE), cuts)
    return out.select("clip_id", "shot_index", "start_ms", "end_ms", "incoming_boundary_id",
                      "outgoing_boundary_id", "incoming_ord", "outgoing_ord")


@query("ag01_editing_summary", f"""
SELECT clip_id, count(*) shot_count, {Q.r6('avg(end_ms-start_ms)', 'average_shot_length_ms')},
  {Q.r6('quantile_cont(CAST(end_ms-start_ms AS DOUBLE), 0.5)', 'median_shot_length_ms')},
  {Q.r6('60000.0::DOUBLE*count(*)/259200', 'shots_per_minute')} FROM v_shots GROUP BY clip_id""")
def ag01(v: Views):
    s = S.editing_summary(v.shots())
    return s.select("clip_id", "shot_count", *[
        r6(F.col(c)).alias(c) for c in ("average_shot_length_ms", "median_shot_length_ms", "shots_per_minute")])


@query("jn02_point_to_shot", """
SELECT f.clip_id, f.frame_index, f.at_ms, coalesce(s.shot_index, l.last) shot_index
FROM (SELECT clip_id, frame_index, at_ms + at_ms//2 at_ms FROM v_frames) f
LEFT JOIN v_shots s ON f.clip_id=s.clip_id AND f.at_ms >= s.start_ms AND f.at_ms < s.end_ms
JOIN (SELECT clip_id, max(shot_index) AS last FROM v_shots GROUP BY 1) l ON l.clip_id=f.clip_id""")
def jn02(v: Views):
    # Stretched instants, so a third of them lie past the end and take the last shot.
    f = v.frames().withColumn("at_ms", F.col("at_ms") + F.floor(F.col("at_ms") / 2).cast("bigint"))
    return S.assign_shots(f, v.shots()).select("clip_id", "frame_index", "at_ms", "shot_index")


@query("jn13_match_cuts", f"""
WITH p AS (SELECT DISTINCT clip_id, position_ms pos FROM v_cuts),
e AS (SELECT DISTINCT clip_id, position_ms + (position_ms%7)*90 - 250 pos FROM v_cuts),
el AS (SELECT clip_id, list(pos ORDER BY pos) es FROM e GROUP BY 1),
pl AS (SELECT clip_id, list(pos ORDER BY pos) ps FROM p GROUP BY 1),
g(clip_id, es, ps, hits, i, np) AS (
 SELECT clip_id, es, ps, CAST(0 AS BIGINT), CAST(1 AS BIGINT), len(ps) FROM el JOIN pl USING (clip_id)
 UNION ALL
 SELECT clip_id, es, CASE WHEN best IS NULL THEN ps ELSE list_filter(ps, lambda x: x <> best) END,
   hits + CASE WHEN best IS NULL THEN 0 ELSE 1 END, i+1, np
 FROM (SELECT *, list_sort(list_filter(list_transform(ps, lambda x: {{'d': abs(x-es[i]), 'x': x}}), lambda s: s.d <= 400))[1].x best
   FROM g WHERE i <= len(es)))
SELECT clip_id, CAST(np AS BIGINT) predicted, CAST(len(es) AS BIGINT) expected, hits matched,
 {Q.r6('hits/np', '"precision"')}, {Q.r6('hits/len(es)', 'recall')} FROM g WHERE i = len(es)+1""")
def jn13(v: Views):
    cuts = v.cuts().select("clip_id", "position_ms", F.lit(0).alias("ord"))
    moved = cuts.withColumn("position_ms", F.col("position_ms") + F.pmod("position_ms", F.lit(7)) * 90 - 250)
    out = S.match_cuts(cuts, moved.distinct(), 400)
    return out.select("clip_id", "predicted", "expected", "matched",
                      r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))
