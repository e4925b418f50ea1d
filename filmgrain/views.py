"""Driver tables reshaped into operator inputs (see FIXTURES.md).

A user of ``events`` stands for a clip and ten seconds of event time for one tick of its
clock; suppliers stand for shots of pixels and flow vectors, orders for job history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmgrain.functions.identity import sha256_text
from filmgrain.functions.numeric import dbl, to_epoch_tick
from filmgrain.operators import shots as S
from filmgrain.operators.ordered import with_row_number
from filmgrain.session import stored

DURATION = 259_200
MERGE = 10_000


class Views:
    """Lazy views over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._shots: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- clips, cuts, shots -------------------------------------------------
    def _events(self, *types: str) -> DataFrame:
        e = self.table("events").select(
            F.col("user_id").alias("clip_id"),
            to_epoch_tick(F.col("ts"), "2024-01-01 00:00:00", 10).alias("at_ms"),
            "event_id", "event_type", "value",
        )
        return e.where(F.col("event_type").isin(*types)) if types else e

    def clips(self) -> DataFrame:
        return (
            self.table("events").select(F.col("user_id").alias("clip_id")).distinct()
            .withColumn("duration_ms", F.lit(DURATION).cast("bigint"))
            .withColumn("audio_available", F.pmod("clip_id", F.lit(3)) != 0)
            .withColumn("motion_available", F.pmod("clip_id", F.lit(4)) != 0)
        )

    def boundaries(self) -> DataFrame:
        return self._events("signup").select(
            "clip_id", F.col("at_ms").alias("position_ms"), F.col("event_id").alias("ord")
        )

    def cuts(self) -> DataFrame:
        return S.internal_cuts(self.boundaries(), self.clips())

    def shots(self, min_shot_ms: int = MERGE) -> DataFrame:
        return S.merge_short_shots(self.cuts(), self.clips(), min_shot_ms)

    def shots_once(self) -> DataFrame:
        """``shots()`` worked out once and stored, for plans in which several branches read them."""
        if self._shots is None:
            self._shots = stored(self.shots())
        return self._shots

    def scores(self) -> DataFrame:
        return self._events().select(
            "clip_id", "at_ms", F.col("event_id").alias("frame_index"), F.col("value").alias("score")
        )

    # --- motion, audio, frames ---------------------------------------------
    def flow_pairs(self) -> DataFrame:
        v = F.col("value")
        return self._events("click").select(
            "clip_id", "at_ms", F.col("event_id").alias("ord"),
            (v / dbl(100)).alias("global_magnitude"),
            (v / dbl(250)).alias("residual_median"),
            (v / dbl(200)).alias("residual_p90"),
            (F.pmod("event_id", F.lit(7)) - 3).cast("double").alias("global_dx"),
            (F.pmod("event_id", F.lit(5)) - 2).cast("double").alias("global_dy"),
            (F.pmod("event_id", F.lit(100)) / dbl(100)).alias("valid_ratio"),
            (v > 200).alias("flagged"),
        )

    def shot_pairs(self) -> DataFrame:
        return S.assign_shots(self.flow_pairs(), self.shots_once(), fallback=False)

    def calm_series(self) -> DataFrame:
        return self.shot_pairs().where(~F.col("flagged")).select(
            "clip_id", "shot_index", "at_ms", "ord", "global_magnitude",
            F.col("residual_median").alias("residual_magnitude"),
        )

    def audio(self) -> DataFrame:
        e = self._events("view").withColumn("start_ms", F.col("at_ms") - F.pmod("at_ms", F.lit(500)))
        return e.groupBy("clip_id", "start_ms").agg(
            (F.avg("value") / dbl(10) - dbl(60)).alias("rms_dbfs"),
            (F.avg("value") / dbl(50)).alias("onset"),
            (F.max("value") / dbl(80)).alias("flux"),
        )

    def frames(self) -> DataFrame:
        return self._events("purchase", "error").select("clip_id", "at_ms", F.col("event_id").alias("frame_index"))

    # --- pixels, vectors, detections ---------------------------------------
    def pixels(self) -> DataFrame:
        li = self.table("lineitem")
        row = F.pmod("l_orderkey", F.lit(24))
        bar = row.isin(0, 1, 22, 23)

        def channel(x):
            return F.when(bar, F.lit(0).cast("bigint")).otherwise(F.pmod(x.cast("bigint"), F.lit(256)))

        return li.select(
            F.col("l_suppkey").alias("shot_id"), F.col("l_linenumber").alias("frame_ord"),
            row.alias("row_i"), F.pmod("l_partkey", F.lit(32)).alias("col_i"),
            channel(F.col("l_partkey") * 37).alias("r"), channel(F.col("l_orderkey") * 13).alias("g"),
            channel(F.floor("l_extendedprice")).alias("b"),
            F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"),
        )

    def vectors(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("shot_id"),
            (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("pair_id"),
            F.pmod("l_orderkey", F.lit(24)).alias("row_i"), F.pmod("l_partkey", F.lit(32)).alias("col_i"),
            ((F.col("l_quantity") - 25) / dbl(10)).alias("dx"),
            ((F.col("l_discount") - dbl(0.05)) * dbl(100)).alias("dy"),
            (F.col("l_tax") * dbl(100)).alias("gradient"),
        )

    def detections(self) -> DataFrame:
        """A shot is 240 consecutive vectors of one label: 60 sampled frames, the plan's
        own ceiling, with up to four hits each."""
        def e(k):
            return F.col("embedding")[k].cast("double")

        x0, y0 = F.least(F.abs(e(0)), dbl(0.45)), F.least(F.abs(e(2)), dbl(0.45))
        v = F.col("vec_id")
        return self.table("embeddings").select(
            (F.col("label") * 100_000 + F.floor(v / 240)).cast("bigint").alias("shot_id"),
            F.floor(F.pmod(v, F.lit(240)) / 4).cast("bigint").alias("sample_ord"),
            F.pmod(v, F.lit(4)).alias("hit_ord"),
            F.when(F.pmod(v, F.lit(5)) == 0, "bicycle").otherwise("person").alias("class_name"),
            F.least(dbl(0.3) + dbl(2) * F.abs(e(4)), dbl(1)).alias("confidence"),
            x0.alias("x_min"), (x0 + dbl(0.1) + F.least(F.abs(e(1)), dbl(0.4))).alias("x_max"),
            y0.alias("y_min"), (y0 + dbl(0.1) + F.least(F.abs(e(3)), dbl(0.4))).alias("y_max"),
        )

    # --- jobs, text, metrics -----------------------------------------------
    def stage_runs(self) -> DataFrame:
        o = self.table("orders").select(
            F.col("o_custkey").alias("analysis_id"),
            F.pmod("o_orderkey", F.lit(3)).alias("stage_no"),
            "o_orderdate", "o_orderkey", "o_orderstatus",
        )
        o = with_row_number(o, ["analysis_id", "stage_no"], ["o_orderdate", "o_orderkey"],
                            F.date_trunc("month", "o_orderdate"), "rn")
        return o.select(
            "analysis_id",
            F.when(F.col("stage_no") == 0, "sampling").when(F.col("stage_no") == 1, "report")
            .otherwise("aggregate").alias("stage_name"),
            (F.col("rn") + 1).cast("bigint").alias("attempt"),
            F.when(F.col("o_orderstatus") == "O", "SUCCEEDED").when(F.col("o_orderstatus") == "F", "FAILED_RETRYABLE")
            .otherwise("PENDING").alias("state"),
            F.col("o_orderkey").alias("ord"), F.col("o_orderdate").alias("changed_at"),
        )

    def state_log(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_custkey").alias("analysis_id"), F.col("o_orderdate").alias("changed_at"),
            F.col("o_orderkey").alias("ord"),
            F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "F", "RUNNING")
            .otherwise("SUCCEEDED").alias("state"),
        )

    def content(self) -> DataFrame:
        return self.table("documents").select("doc_id", sha256_text(F.col("text")).alias("sha"))
