"""Sampling plans worked out shot by shot: same rows as the general operators, and no request is moved between tasks."""

import random

import pytest
from pyspark.sql import functions as F

from filmgrain.operators import measured as D, sampling as P, shots as S
from filmgrain.plans import catalogue

def _frame():
    return F.lit(40).cast("bigint")


def _shots(table):
    rng, rows = random.Random(3), []
    for clip in (1, 2, 3):
        ends = sorted({0, 30, 31, 90_000, *(rng.randint(0, 90_000) for _ in range(7))})
        rows += [(clip, i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
    return S.with_shot_ids(table("clip_id bigint, shot_index bigint, start_ms bigint, end_ms bigint", rows))


def _frames(table):
    rng = random.Random(4)
    rows = [(clip, rng.randint(-10, 95_000 - 30_000 * (clip == 2)), i) for clip in (1, 2) for i in range(300)]
    return table("clip_id bigint, at_ms bigint, frame_index bigint", rows + [(c, t, 999 - i) for i, (c, t, _) in enumerate(rows[:50])])


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_plan_and_outcomes_are_those_of_the_general_operators(spark, table):
    shots, frames = _shots(table), _frames(table)
    plan = P.sampling_plan(P.sample_targets(shots, _frame())).cache()
    planned = P.with_next_frames(P.planned_shots(P.with_shot_frames(shots, frames), _frame()))
    assert _rows(P.plan_requests(planned)) == _rows(plan)
    outcomes = P.match_frames(plan, frames)
    made = P.plan_outcomes(planned)
    assert _rows(made.select(outcomes.columns)) == _rows(outcomes)
    assert {r.unavailable_reason for r in made.collect()} == {None, P.OUTSIDE, P.MISSING}
    fifth = F.pmod("ord", F.lit(5)) == 0
    held = P.match_frames(plan.where(~fifth), frames)
    assert _rows(P.plan_manifest(made, fifth)) == _rows(P.sampling_manifest(plan, held))
    best = ["clip_id", "shot_index", "representative_sample_id"]
    assert _rows(P.with_representatives(planned).select(best)) == _rows(P.representatives(shots, plan).select(best))


def test_evidence_of_the_plan_is_that_of_the_manifest(spark, table):
    """Instants in place of ids, and the same ids once they are named."""
    shots = _shots(table)
    planned = P.with_next_frames(P.planned_shots(P.with_shot_frames(shots, _frames(table)), _frame()))
    want = D.shot_evidence(shots, P.plan_manifest(P.plan_outcomes(planned)))
    made = D.planned_evidence(planned)
    assert {t for c, t in made.dtypes if c.endswith("_ids")} == {"array<bigint>"}
    names = {c: F.transform(c, lambda t: D.sample_name(F.col("clip_id"), F.col("shot_index"), t)) for c in made.columns if c.endswith("_ids")}
    assert _rows(made.withColumns(names)) == _rows(want)


def test_overlapping_shots_fail(spark, table):
    shots = table("clip_id bigint, shot_index bigint, start_ms bigint, end_ms bigint, shot_id string", [(1, 0, 0, 500, "a"), (1, 1, 400, 900, "b")])
    with pytest.raises(Exception, match="shots overlap in clip 1"):
        P.plan_requests(P.planned_shots(shots, _frame())).collect()


def test_left_over_ids_are_counted_on_both_sides(spark, table):
    schema = "clip_id int, sample_id string"
    ids, results = table(schema, [(1, "a"), (1, "a"), (1, "b"), (1, "c")]), table(schema, [(1, "a"), (1, "b"), (1, "b"), (1, "b"), (2, "c")])
    got = P.unmatched_ids(ids, results)
    assert _rows(got) == _rows(ids.exceptAll(results).withColumn("side", F.lit("missing")).unionByName(results.exceptAll(ids).withColumn("side", F.lit("extra"))))


@pytest.mark.parametrize("name", ["jn09_sampling_manifest", "prj29_samples_for_purpose", "set05_plan_result_ids", "jn06_frame_at_or_after", "wn07_sampling_plan"])
def test_no_request_is_moved(spark, name):
    text = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = text.split("Generate posexplode")[0]
    assert above != text and "Exchange" not in above and "Join" not in above


def test_representatives_need_no_join(spark):
    text = catalogue.QUERIES["jn10_representative_sample"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange") == 1
