"""Streaming twins run to the end of the stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from filmgrain.functions.identity import sha256_text
from filmgrain.functions.numeric import dbl, r6
from filmgrain.plans.registry import query
from filmgrain.plans.sqltext import r6 as q6
from filmgrain.streaming import twins as S
from filmgrain.views import Views


def _stream(v: Views, table: str):
    return S.stream_table(v.spark, f"{v.folder}/{table}.parquet")


@query("st01_hourly_rollup", """
SELECT epoch(date_trunc('hour', ts))::BIGINT hour_s, event_type series, sum(CASE WHEN event_id%2=0 THEN CAST(floor(value) AS BIGINT)-20 END)::BIGINT counter_total, count(*) FILTER (event_id%2=1) samples,
 sum(CASE WHEN event_id%2=1 THEN greatest(CAST(floor(value) AS BIGINT)-20, 0) END)::BIGINT sample_sum, max(CASE WHEN event_id%2=1 THEN greatest(CAST(floor(value) AS BIGINT)-20, 0) END) sample_max
FROM events GROUP BY 1, 2""")
def st01(v):
    e = _stream(v, "events").select("ts", F.col("event_type").alias("series"), F.when(F.pmod("event_id", F.lit(2)) == 0, "counter").otherwise("histogram").alias("kind"),
                                    (F.floor("value") - 20).cast("bigint").alias("value"))
    e, close = S.with_closing(e)
    out = S.run_to_end(S.hourly_rollup(e), "append", close)
    return out.select(F.unix_timestamp("hour").alias("hour_s"), "series", "counter_total", "samples", "sample_sum", "sample_max")


@query("st02_sliding_levels", f"""
WITH w AS (SELECT user_id clip_id, value/100 x, unnest([epoch(ts)::BIGINT//43200*43200, epoch(ts)::BIGINT//43200*43200-43200]) start_s FROM (SELECT user_id, value, date_trunc('second', ts) ts FROM events))
SELECT clip_id, start_s, {q6('sqrt(avg(x*x))', 'rms')}, count(*) samples FROM w GROUP BY 1, 2""")
def st02(v):
    e = _stream(v, "events").select(F.date_trunc("second", "ts").alias("ts"), F.col("user_id").alias("clip_id"), (F.col("value") / dbl(100)).alias("x"))
    e, close = S.with_closing(e)
    out = S.run_to_end(S.sliding_levels(e, "24 hours", "12 hours"), "append", close)
    return out.select("clip_id", F.unix_timestamp("start").alias("start_s"), r6(F.col("rms")).alias("rms"), "samples")


@query("st03_first_copies", "SELECT DISTINCT sha256(text) sha FROM documents")
def st03(v):
    """The number of a document is its time in seconds of 2024 on; the delay is the table's own span, so all copies meet in any order of arrival."""
    at = F.timestamp_seconds(F.col("doc_id") + 1_704_067_200).alias("ts")
    d = _stream(v, "documents").select("doc_id", sha256_text(F.col("text")).alias("sha"), at)
    delay = f"{S.span_seconds(v.table('documents').select(at))} seconds"
    return S.run_to_end(S.first_copies(d, "sha", delay), "append").select("sha")


@query("st04_move_audit", """
SELECT analysis_id, ord, f from_state, state, f='SUCCEEDED' from_terminal FROM v_log_prev WHERE f IS NOT NULL AND concat(f, '>', state) NOT IN ('QUEUED>RUNNING', 'RUNNING>SUCCEEDED')""")
def st04(v):
    """Moves in order of their dates, whatever the order they arrive in: the delay is the log's own span."""
    o = _stream(v, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "F", "RUNNING").otherwise("SUCCEEDED").alias("state"))
    delay = f"{S.span_seconds(v.table('orders'), 'o_orderdate')} seconds"
    o, close = S.with_closing(o)
    return S.run_to_end(S.move_audit(o, delay), "append", close)
