"""Streaming forms of four batch operators, and a run-to-the-end helper."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filmgrain.operators.jobs import ANALYSIS_MOVES
from filmgrain.operators.metrics import rollup_aggregates
from filmgrain.session import work_folder

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table (a folder or one file) as a stream with the schema it is stored with.

    The last letter is written as a glob because a plain path must be a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def hourly_rollup(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Metric roll-up per hour and series. ``events``: ts, series, kind, value. Rows later
    than the watermark are dropped in append mode."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = df.groupBy(F.window("ts", "1 hour"), "series").agg(*rollup_aggregates())
    return out.select(F.col("window.start").alias("hour"), "series", "counter_total", "samples", "sample_sum", "sample_max")


def sliding_levels(samples: DataFrame, size: str, hop: str, delay: str = "1 minute") -> DataFrame:
    """Root mean square of overlapping windows. ``samples``: ts, clip_id, x."""
    df = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = df.groupBy(F.window("ts", size, hop), "clip_id").agg(
        F.sqrt(F.sum(F.col("x") * F.col("x")) / F.count(F.lit(1))).alias("rms"), F.count(F.lit(1)).alias("samples"))
    return out.select("clip_id", F.col("window.start").alias("start"), "rms", "samples")


def first_copies(rows: DataFrame, key: str, delay: str = "1 day", salts: int = 16) -> DataFrame:
    """First row of each key within the watermark. A copy meets the first one where it comes at most ``delay`` after it; rows
    more than ``delay`` behind the newest are late and dropped (``span_seconds`` of a table gives a delay that loses none).

    Two rounds: copies of a hot key are first thinned per salt over many tasks, then the
    few left meet on the key.
    """
    df = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    others = [c for c in rows.columns if c != key]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark([key, "_salt"]).dropDuplicatesWithinWatermark([key]).drop("_salt")


def span_seconds(rows: DataFrame, time: str = "ts") -> int:
    """Whole seconds between the first and the last ``time`` of a table, and one more: a delay under which none of its rows is late."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ends = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    return 1 if ends.low is None else (ends.high - ends.low) // 1_000_000 + 1


_WAITING = ["analysis_id", "no_id", "ms", "ord", "state"]


class _MoveAudit(StatefulProcessor):
    """Holds the moves of a bucket of analyses until the watermark has passed them, then reports those that are not allowed in event-time order.

    A batch's moves are kept as one packed entry, the last states of the bucket's analyses too, and both are worked on as columns: calls to
    the state grow with buckets and batches, not with moves or analyses. One timer per bucket stands at its earliest waiting move.
    """

    legal = frozenset((a, b) for a, to in ANALYSIS_MOVES.items() for b in to)
    final = frozenset(a for a, to in ANALYSIS_MOVES.items() if not to)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.alarm = handle.getValueState("alarm", "ms bigint")

    def _set_alarm(self, ms: int | None) -> None:
        held = self.alarm.get()
        if held and ms is not None and held[0] <= ms:
            return
        if held:
            self.handle.deleteTimer(held[0])
            self.alarm.clear()
        if ms is not None:
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part.loc[part["state"].notna(), _WAITING]
            if len(part):
                self.waiting.appendValue((_packed(part),))
                low = int(part["ms"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._set_alarm(first)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = pd.concat([_unpacked(packed) for (packed,) in self.waiting.get()], ignore_index=True)
        due = held["ms"] <= now
        moves, later = held[due].sort_values(_WAITING, kind="stable"), held[~due]
        self.waiting.clear()
        self.alarm.clear()
        if len(later):
            self.waiting.appendValue((_packed(later),))
            self._set_alarm(int(later["ms"].min()))
        yield self._judged(moves)

    def _judged(self, moves: pd.DataFrame) -> pd.DataFrame:
        """Moves of ``moves``, sorted by analysis and time, that are not allowed; the last states are brought up to date."""
        who = _WAITING[:2]
        kept = self.last.get()
        last = _unpacked(kept[0]) if kept else moves.iloc[:0][[*who, "state"]]
        # The state an analysis stood in goes before its moves; it has a number too, as gaps would make doubles of the others.
        stood = last.merge(moves[who].drop_duplicates(), on=who).assign(ms=0, ord=0, move=False)
        both = pd.concat([stood, moves.assign(move=True)], ignore_index=True).sort_values(who, kind="stable")
        before = both.groupby(who, sort=False)["state"].shift()
        pairs = pd.Series(list(zip(before, both["state"])), index=both.index, dtype=object)
        bad = before.notna() & both["move"].astype(bool) & ~pairs.isin(self.legal)
        ends = pd.concat([last, moves[[*who, "state"]]], ignore_index=True).drop_duplicates(who, keep="last")
        self.last.update((_packed(ends),))
        out = both[bad]
        return pd.DataFrame({
            "analysis_id": out["analysis_id"].astype("Int64").mask(out["no_id"]), "ord": out["ord"], "from_state": before[bad], "state": out["state"],
            "from_terminal": before[bad].isin(self.final)})

    def close(self) -> None:
        pass


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_pandas()


def move_audit(log: DataFrame, delay: str = "1 hour", buckets: int = 4096) -> DataFrame:
    """Illegal moves of a state-change stream (ts, analysis_id bigint, ord bigint, state), in the order of ts, then ord.

    Moves wait in state until the watermark, ``delay`` behind the newest, has passed them, so the result is the same however the
    rows are split into micro-batches, as long as none is later than ``delay``; Spark drops later rows, and those from before 1970, where its
    watermark begins. End the stream with ``with_closing``,
    or the last moves keep waiting. Analyses share state by ``buckets``, a number that stays with a stream's checkpoint. The moves of one
    bucket within ``delay``, and those of one analysis, fit a task.
    """
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # Milliseconds alone go to Python, whose own timestamps end in 2262; nulls there would make doubles of numbers.
    timed = timed.select(
        F.pmod(F.xxhash64("analysis_id"), F.lit(buckets)).alias("_bucket"), F.coalesce("analysis_id", F.lit(0).cast("bigint")).alias("analysis_id"),
        F.col("analysis_id").isNull().alias("no_id"), F.coalesce("ord", F.lit(0).cast("bigint")).alias("ord"), "state", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=_MoveAudit(),
        outputStructType="analysis_id bigint, ord bigint, from_state string, state string, from_terminal boolean",
        outputMode="Append", timeMode="EventTime")


def with_closing(rows: DataFrame, after: str = "9000-01-01") -> tuple[DataFrame, Callable[[], None]]:
    """``rows`` (a stream with a time column ``ts``) and an act that ends it.

    An append-mode result comes out when the watermark passes it, which the end of the data alone doesn't
    do. The act adds one row far in the future, whose own window never closes, so everything before it comes out and its state is released.
    """
    spark = rows.sparkSession
    folder = f"{work_folder(spark)}/closing-{uuid.uuid4().hex}"
    spark.createDataFrame([], rows.schema).write.parquet(folder)
    last = spark.readStream.schema(rows.schema).parquet(folder)

    def close() -> None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "ts"]
        end = F.lit(after).cast(rows.schema["ts"].dataType).alias("ts")
        spark.range(1).select(end, *empty).select(rows.columns).coalesce(1).write.mode("append").parquet(folder)

    return rows.union(last), close


def run_to_end(df: DataFrame, mode: str, close: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what is there now and return its result as a table. With ``close`` (see
    ``with_closing``) the stream is ended and run on from where it stood.

    Each micro-batch has its own folder, so a batch that is run again after a lost executor
    replaces its output instead of repeating it.
    """
    spark = df.sparkSession
    root = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run() -> None:
        writer = df.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{root}/state")
        writer.trigger(availableNow=True).start().awaitTermination()

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        run()
        if close:
            close()
            run()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)
