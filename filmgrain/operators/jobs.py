"""Job history: attempts, progress, outcomes, transitions, claims and quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmgrain.functions.numeric import dbl
from filmgrain.operators.ordered import with_previous

# Pipeline order with progress weights, and the two state machines.
STAGES = {"sampling": 0.40, "report": 0.50, "aggregate": 0.10}
REQUIRED = ("sampling", "report")
PILLARS = ("chromatic", "spatial", "motion", "audio", "tension", "critic")
ANALYSIS_MOVES = {
    "QUEUED": ("RUNNING", "CANCELED"),
    "RUNNING": ("SUCCEEDED", "PARTIAL", "FAILED", "CANCEL_REQUESTED"),
    "CANCEL_REQUESTED": ("CANCELED", "FAILED"),
    "CANCELED": (), "SUCCEEDED": (), "PARTIAL": (), "FAILED": (),
}
STAGE_MOVES = {
    "PENDING": ("LEASED", "SKIPPED", "CANCELED"),
    "LEASED": ("RUNNING", "CANCELED", "PENDING"),
    "RUNNING": ("SUCCEEDED", "FAILED_RETRYABLE", "FAILED_TERMINAL", "CANCELED"),
    "SUCCEEDED": (), "SKIPPED": (), "FAILED_RETRYABLE": (), "FAILED_TERMINAL": (), "CANCELED": (),
}
IN_FLIGHT = ("QUEUED", "RUNNING", "CANCEL_REQUESTED")
DONE = ("SUCCEEDED", "SKIPPED")


def latest_attempts(runs: DataFrame) -> DataFrame:
    """Newest attempt of each stage: a plain aggregate, so nothing is sorted per analysis."""
    return runs.groupBy("analysis_id", "stage_name").agg(
        F.max("attempt").alias("attempt"), F.max_by("state", "attempt").alias("state"))


def next_attempts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("analysis_id", "stage_name").agg((F.max("attempt") + 1).alias("next_attempt"))


def _state_of(stage: str) -> Column:
    return F.max(F.when(F.col("stage_name") == stage, F.col("state")))


def next_stage(runs: DataFrame) -> DataFrame:
    """First stage in order that is missing, pending or may be retried; null while a stage
    is in flight, has failed for good, or all are done."""
    now = latest_attempts(runs).groupBy("analysis_id").agg(*[_state_of(s).alias(s) for s in STAGES])
    pick: Column | None = None
    for stage in reversed(STAGES):
        state = F.col(stage)
        go = state.isNull() | state.isin("PENDING", "FAILED_RETRYABLE")
        pick = F.when(go, stage).when(state.isin(*DONE), pick if pick is not None else F.lit(None))
    return now.select("analysis_id", pick.alias("next_stage"))


def _weights_done(done: Column) -> Column:
    total = sum((F.max(F.when((F.col("stage_name") == s) & done, dbl(w)).otherwise(dbl(0))) for s, w in STAGES.items()), dbl(0))
    return F.greatest(dbl(0), F.least(dbl(1), total)).alias("progress")


def progress(runs: DataFrame) -> DataFrame:
    """Sum of the weights of stages with any finished attempt."""
    return runs.groupBy("analysis_id").agg(_weights_done(F.col("state").isin(*DONE)))


def optional_failed() -> Column:
    """Whether an optional pillar fell short, from availability columns and the request."""
    def short(c: str) -> Column:
        return F.col(c).isin("UNAVAILABLE", "PARTIAL")

    return (
        short("chromatic") | (F.col("spatial_requested") & (F.col("spatial") != "COMPLETE")) | short("motion")
        | (F.col("has_audio") & (F.col("audio") != "COMPLETE")) | (F.col("tension") == "UNAVAILABLE")
    )


def outcomes(runs: DataFrame, availability: DataFrame) -> DataFrame:
    """FAILED, PARTIAL or SUCCEEDED per analysis from its newest required attempts and
    report availability (a missing report row means FAILED)."""
    ready = latest_attempts(runs).where(F.col("stage_name").isin(*REQUIRED) & (F.col("state") == "SUCCEEDED"))
    ready = ready.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_ready"))
    df = runs.select("analysis_id").distinct().join(ready, "analysis_id", "left").join(availability, "analysis_id", "left")
    failed = (F.coalesce("_ready", F.lit(0)) < len(REQUIRED)) | F.col("chromatic").isNull()
    return df.select("analysis_id", F.when(failed, "FAILED").when(optional_failed(), "PARTIAL").otherwise("SUCCEEDED").alias("outcome"))


def unavailable_pillars() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(p) != "COMPLETE", F.lit(p)) for p in PILLARS]))


def is_terminal(state: Column) -> Column:
    return state.isin(*[s for s, to in ANALYSIS_MOVES.items() if not to])


def status_view(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Completed stages in pipeline order, active ones in first-seen order, progress and a
    safe error. ``jobs``: state, progress, failure_code and the availability columns."""
    per = runs.groupBy("analysis_id", "stage_name").agg(
        F.max(F.col("state").isin(*DONE)).alias("done"),
        F.min(F.when(F.col("state").isin("LEASED", "RUNNING"), F.col("ord"))).alias("since"))
    done = F.array_compact(F.array(*[
        F.max(F.when((F.col("stage_name") == s) & F.col("done"), F.lit(s))) for s in STAGES]))
    # Stage names come from a closed set, so these lists hold a few entries.
    active = F.array_sort(F.collect_list(F.when(F.col("since").isNotNull(), F.struct("since", "stage_name"))))
    lists = per.groupBy("analysis_id").agg(done.alias("completed_stages"), active["stage_name"].alias("active_stages"),
        _weights_done(F.col("done")))
    over = is_terminal(F.col("state"))
    df = jobs.withColumnRenamed("progress", "_stored").join(lists, "analysis_id", "left")
    none = F.array().cast("array<string>")
    return df.select(
        "analysis_id", "state",
        F.when(over, F.col("_stored")).otherwise(F.coalesce("progress", dbl(0))).alias("progress"),
        F.coalesce("completed_stages", none).alias("completed_stages"),
        F.coalesce("active_stages", none).alias("active_stages"),
        unavailable_pillars().alias("unavailable_stages"),
        F.when(over, F.col("failure_code")).alias("error_code"),
    )


def quota(requests: DataFrame, analyses: DataFrame, limit: int) -> DataFrame:
    """Verdict per requested key: known keys are reused, others need a free slot."""
    busy = analyses.where(F.col("state").isin(*IN_FLIGHT)).agg(F.count(F.lit(1)).alias("n"))
    known = analyses.select("analysis_key").distinct().withColumn("_known", F.lit(True))
    df = requests.join(known, "analysis_key", "left").withColumn("in_flight", busy.scalar())
    verdict = F.when(F.col("_known"), "REUSED").when(F.col("in_flight") < limit, "ACCEPTED").otherwise("RESOURCE_LIMIT")
    return df.withColumn("verdict", verdict).drop("_known")


def claimable(analyses: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Queued analyses, and running ones that hold no live lease."""
    live = runs.where(F.col("state").isin("LEASED", "RUNNING") & (F.col("lease_expires_at") >= now))
    free = analyses.where(F.col("state").isin("RUNNING", "CANCEL_REQUESTED")).join(
        live.select("analysis_id").distinct(), "analysis_id", "left_anti")
    return analyses.where(F.col("state") == "QUEUED").unionByName(free.select(*analyses.columns))


def oldest(df: DataFrame, n: int, *by: str) -> DataFrame:
    """First ``n`` rows by the given columns (a top-k, never a full sort)."""
    return df.orderBy(*by).limit(n)


def illegal_moves(log: DataFrame, moves: dict[str, tuple[str, ...]] = ANALYSIS_MOVES) -> DataFrame:
    """State changes the machine does not allow, with whether the old state was final."""
    df = with_previous(log, ["analysis_id"], ["changed_at", "ord"], F.date_trunc("month", "changed_at"), ["state"])
    legal = [f"{a}>{b}" for a, to in moves.items() for b in to]
    final = [a for a, to in moves.items() if not to]
    return df.where(F.col("prev").isNotNull()).withColumn("from_state", F.col("prev.state")).drop("prev").where(
        ~F.concat_ws(">", "from_state", "state").isin(*legal)
    ).withColumn("from_terminal", F.col("from_state").isin(*final))


def stage_rollup(runs: DataFrame) -> DataFrame:
    """Run counts and durations by stage, outcome and error class with subtotals."""
    grouped = runs.rollup("stage_name", "state", "error_class").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_ms").alias("duration_ms"), F.max("duration_ms").alias("longest_ms"),
        F.grouping_id().alias("level"))
    return grouped
