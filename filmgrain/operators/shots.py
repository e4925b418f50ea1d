"""From frame scores and detected boundaries to shot sets and editing summaries.

``internal_cuts`` keeps one row per clip and millisecond. An accepted clip is at most
``limits.max_duration_ms`` long, so from there on a clip has a known bound however
many raw rows it came from, and windows over a clip are safe.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmgrain.config import Shots
from filmgrain.functions.identity import stable_uuid
from filmgrain.functions.numeric import dbl, int_div
from filmgrain.operators.ordered import clip_window, join_one, with_neighbour_mean

CHUNK_MS = 16_384


def score_changes(scores: DataFrame, rules: Shots = Shots(), reach: int = 2) -> DataFrame:
    """Frames whose change score marks a transition.

    ``content`` compares the score with the threshold. ``adaptive`` compares it with the
    mean of its neighbours and also asks for the minimum content value.
    """
    if rules.detector != "adaptive":
        return scores.where(F.col("score") >= rules.threshold).withColumn("ratio", F.lit(None).cast("double"))
    df = with_neighbour_mean(
        scores, ["clip_id"], ["at_ms", "frame_index"], int_div(F.col("at_ms"), CHUNK_MS), "score", reach, "_mean"
    )
    df = df.withColumn("ratio", F.when(F.col("_mean") > 0, F.col("score") / F.col("_mean")))
    strong = F.col("ratio").isNull() | (F.col("ratio") >= rules.threshold)
    return df.where(strong & (F.col("score") >= rules.min_content_val)).drop("_mean")


def internal_cuts(boundaries: DataFrame, durations: DataFrame) -> DataFrame:
    """Distinct positions strictly inside the clip; the first boundary of a position is
    kept as ``first_ord`` and the last as ``last_ord``."""
    spots = boundaries.groupBy("clip_id", "position_ms").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))
    return spots.join(durations.select("clip_id", "duration_ms"), "clip_id").where(
        (F.col("position_ms") > 0) & (F.col("position_ms") < F.col("duration_ms"))
    ).select("clip_id", "position_ms", "duration_ms", "first_ord", "last_ord")


def _with_edges(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    zero = durations.select("clip_id", F.lit(0).cast("bigint").alias("position_ms"), "duration_ms")
    return zero.unionByName(cuts.select("clip_id", "position_ms", "duration_ms"))


def _intervals(starts: DataFrame) -> DataFrame:
    w = clip_window().orderBy("position_ms")
    return starts.select(
        "clip_id",
        (F.row_number().over(w) - 1).cast("bigint").alias("shot_index"),
        F.col("position_ms").alias("start_ms"),
        F.coalesce(F.lead("position_ms").over(w), F.col("duration_ms")).alias("end_ms"),
        "duration_ms",
    )


def raw_intervals(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """Half-open cover of every clip by its distinct cuts, nothing merged."""
    return _intervals(_with_edges(cuts, durations)).drop("duration_ms")


def _fold(positions: Column, min_shot_ms: int) -> Column:
    """Greedy pass: a position survives when it is far enough after the last survivor."""
    start = F.slice(positions, 1, 1)
    rest = F.slice(positions, 2, F.greatest(F.size(positions) - 1, F.lit(0)))

    def step(kept: Column, p: Column) -> Column:
        return F.when(p - F.element_at(kept, -1) >= min_shot_ms, F.concat(kept, F.array(p))).otherwise(kept)

    return F.aggregate(rest, start, step)


def merge_short_shots(cuts: DataFrame, durations: DataFrame, min_shot_ms: int) -> DataFrame:
    """Shots after merging those shorter than ``min_shot_ms`` into the next one, and a
    short last one into the one before. A lone interval always stays.

    An edge whose gap to the edge before is long enough always survives, so edges split
    into independent runs there and the fold sees one run at a time.
    """
    w = clip_window().orderBy("position_ms")
    edges = _with_edges(cuts, durations)
    gap = F.col("position_ms") - F.lag("position_ms").over(w)
    edges = edges.withColumn("_anchor", F.when(gap.isNull() | (gap >= min_shot_ms), F.col("position_ms")))
    run = F.last("_anchor", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.withColumn("_run", run)
    runs = edges.groupBy("clip_id", "_run").agg(
        F.max("duration_ms").alias("duration_ms"),
        F.array_sort(F.collect_list("position_ms")).alias("_positions"),
    )
    kept = runs.select("clip_id", "duration_ms", F.explode(_fold(F.col("_positions"), min_shot_ms)).alias("position_ms"))
    last = F.max("position_ms").over(clip_window())
    short_tail = (
        (F.col("position_ms") == last) & (F.col("position_ms") > 0)
        & (F.col("duration_ms") - F.col("position_ms") < min_shot_ms)
    )
    kept = kept.withColumn("_drop", short_tail).where(~F.col("_drop"))
    return _intervals(kept)


def with_shot_ids(shots: DataFrame) -> DataFrame:
    return shots.withColumn("shot_id", stable_uuid(F.col("clip_id"), "shot", F.col("shot_index")))


def attach_boundaries(shots: DataFrame, cuts: DataFrame) -> DataFrame:
    """Incoming and outgoing boundary of each shot; clip ends have none.

    Where a position was reported more than once the last report is the one shown.
    """
    known = cuts.select(
        "clip_id", "position_ms", "last_ord",
        stable_uuid(F.col("clip_id"), "boundary", F.col("position_ms")).alias("boundary_id"),
    )

    def side(name: str, edge: str) -> DataFrame:
        return known.select(
            "clip_id",
            F.col("position_ms").alias(edge),
            F.col("boundary_id").alias(f"{name}_boundary_id"),
            F.col("last_ord").alias(f"{name}_ord"),
        )

    return shots.join(side("incoming", "start_ms"), ["clip_id", "start_ms"], "left").join(
        side("outgoing", "end_ms"), ["clip_id", "end_ms"], "left"
    )


def editing_summary(shots: DataFrame) -> DataFrame:
    """Shot count, mean, exact median and cuts rate per clip.

    Shots of a clip are bounded by its length over the shortest shot, so Spark's own
    ``percentile`` fits.
    """
    length = F.col("end_ms") - F.col("start_ms")
    return shots.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("shot_count"),
        F.avg(length).alias("average_shot_length_ms"),
        F.percentile(length, F.lit(0.5)).alias("median_shot_length_ms"),
        (dbl(60_000) * F.count(F.lit(1)) / F.max("end_ms")).alias("shots_per_minute"),
    )


def assign_shots(points: DataFrame, shots: DataFrame, at: str = "at_ms", bin_ms: int = 8_192,
                 fallback: bool = True) -> DataFrame:
    """Shot index of every point; a cut instant belongs to the later shot.

    Shots are listed once per time bin they touch, so points meet only the few shots of
    their own bin and a busy clip is spread over its bins. Points past the end take the
    last shot when ``fallback`` is set.
    """
    listed = shots.select(
        "clip_id", "shot_index", "start_ms", "end_ms",
        F.explode(F.sequence(int_div(F.col("start_ms"), bin_ms), int_div(F.col("end_ms") - 1, bin_ms))).alias("_bin"),
    )
    p = points.withColumn("_bin", int_div(F.col(at), bin_ms))
    inside = (
        (p.clip_id == listed.clip_id) & (p._bin == listed._bin)
        & (p[at] >= listed.start_ms) & (p[at] < listed.end_ms)
    )
    out = p.join(listed, inside, "left").select(*[p[c] for c in points.columns], listed.shot_index)
    if not fallback:
        return out
    last = shots.groupBy("clip_id").agg(F.max("shot_index").alias("_last"))
    return join_one(out, last, ["clip_id"], "left").withColumn("shot_index", F.coalesce("shot_index", "_last")).drop("_last")


def _match_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy one-to-one matching of one small island of positions."""
    free = pdf.loc[~pdf["is_expected"], ["ord", "position_ms"]].sort_values(["ord", "position_ms"])
    earlier = {p: i for i, p in reversed(list(enumerate(free["position_ms"])))}
    free = sorted(free["position_ms"])
    tolerance = int(pdf["tolerance_ms"].iloc[0])
    hits = 0
    for target in pdf.loc[pdf["is_expected"]].sort_values(["ord", "position_ms"])["position_ms"]:
        # Only the neighbours on either side can be nearest; of two as near the earlier listed one is.
        at = bisect_left(free, target)
        near = min((i for i in (at - 1, at) if 0 <= i < len(free)), key=lambda i: (abs(free[i] - target), earlier[free[i]]), default=None)
        if near is not None and abs(free[near] - target) <= tolerance:
            free.pop(near)
            hits += 1
    return pd.DataFrame({"clip_id": [pdf["clip_id"].iloc[0]], "hits": [hits]})


def match_cuts(predicted: DataFrame, expected: DataFrame, tolerance_ms: int = 200) -> DataFrame:
    """Precision and recall of predicted cut positions per clip.

    Both sides hold distinct positions (as ``internal_cuts`` gives them), so a clip is
    bounded. Two positions further apart than the tolerance can never meet, so a clip is
    cut into islands at every wider gap. An island with one position on either side and
    at least one on the other has exactly one match (its neighbour in the island is near
    enough), so only islands with two or more on both sides go to Python.
    """
    both = predicted.select("clip_id", "position_ms", "ord", F.lit(False).alias("is_expected")).unionByName(
        expected.select("clip_id", "position_ms", "ord", F.lit(True).alias("is_expected"))
    )
    w = clip_window().orderBy("position_ms", "is_expected")
    gap = F.col("position_ms") - F.lag("position_ms").over(w)
    both = both.withColumn("_open", F.when(gap.isNull() | (gap > tolerance_ms), F.col("position_ms")))
    both = both.withColumn("island", F.last("_open", ignorenulls=True).over(w))
    island = Window.partitionBy("clip_id", "island")
    mixed = both.withColumns({"_e": F.count_if("is_expected").over(island), "_all": F.count(F.lit(1)).over(island)})
    todo = mixed.where("_e > 1 and _all - _e > 1").select(
        "clip_id", "island", "position_ms", "ord", "is_expected", F.lit(tolerance_ms).alias("tolerance_ms"))
    # One row of each plain island: its expected position, or its only prediction.
    plain = mixed.where("(_e = 1 and _all > 1 and is_expected) or (_e > 1 and _all - _e = 1 and not is_expected)")
    clip_type = predicted.schema["clip_id"].dataType.simpleString()
    walked = todo.groupBy("clip_id", "island").applyInPandas(_match_group, f"clip_id {clip_type}, hits bigint")
    hits = walked.unionByName(plain.select("clip_id", F.lit(1).cast("bigint").alias("hits"))).groupBy("clip_id").agg(
        F.sum("hits").alias("hits"))
    sides = both.groupBy("clip_id").agg(
        F.count_if("is_expected").alias("expected"), F.count_if(~F.col("is_expected")).alias("predicted")
    )
    got = F.coalesce("hits", F.lit(0)).cast("bigint")
    return sides.join(hits, "clip_id", "left").select(
        "clip_id", "predicted", "expected", got.alias("matched"),
        F.when(F.col("predicted") == 0, dbl(1)).otherwise(got / F.col("predicted")).alias("precision"),
        F.when(F.col("expected") == 0, dbl(1)).otherwise(got / F.col("expected")).alias("recall"),
    )
