"""Windowed audio features over one-row-per-sample tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from filmgrain.functions.numeric import dbl, int_div
from filmgrain.operators.ordered import join_one
from filmgrain.operators.timeline import hop_starts

FFT_SIZE, FFT_HOP = 512, 256
SILENCE_DB = -120.0


def _in_clip(pcm: DataFrame, clips: DataFrame, rate: int) -> DataFrame:
    last = F.floor(F.col("duration_ms") * rate / 1000)
    return join_one(pcm, clips.select("clip_id", "duration_ms"), ["clip_id"]).where(F.col("i") < last)


def _windows_of(index, rate: int, hop_ms: int, window_ms: int):
    """Starts of the windows that hold a sample: those whose first sample is not after it
    and whose end sample is. Two candidates too many on each side are tested and dropped."""
    hop = F.floor(index * dbl(1000) / dbl(rate) / dbl(hop_ms)).cast("bigint")
    reach = -(-window_ms // hop_ms)
    starts = F.transform(F.sequence(F.greatest(hop - reach, F.lit(0).cast("bigint")), hop + 1), lambda k: k * hop_ms)
    return F.filter(starts, lambda s: (F.floor(s * rate / 1000) <= index) & (F.floor((s + window_ms) * rate / 1000) > index))


def window_levels(pcm: DataFrame, clips: DataFrame, rate: int, hop_ms: int = 500, window_ms: int = 1000) -> DataFrame:
    """Level of every (overlapping) window; a window without samples is at -120 dB.

    Samples are first summed between neighbouring window edges, so only those sums are
    repeated over the windows they belong to.
    """
    if window_ms % hop_ms == 0:
        # Window edges fall on hop edges: one segment per hop.
        guess = F.floor(F.col("i") * dbl(1000) / dbl(rate) / dbl(hop_ms)).cast("bigint")
        seg = F.when(F.floor((guess + 1) * hop_ms * rate / 1000) <= F.col("i"), guess + 1).otherwise(guess)
        sums = _in_clip(pcm, clips, rate).groupBy("clip_id", seg.alias("seg")).agg(
            F.sum(F.col("x") * F.col("x")).alias("sq"), F.count(F.lit(1)).alias("n"))
        reach = window_ms // hop_ms
        spread = F.sequence(F.greatest(F.col("seg") - (reach - 1), F.lit(0).cast("bigint")), F.col("seg"))
        parts = sums.select("clip_id", (F.explode(spread).alias("k")), "sq", "n").withColumn("start_ms", F.col("k") * hop_ms)
    else:
        parts = _in_clip(pcm, clips, rate).select(
            "clip_id", F.explode(_windows_of(F.col("i"), rate, hop_ms, window_ms)).alias("start_ms"),
            (F.col("x") * F.col("x")).alias("sq"), F.lit(1).alias("n"))
    level = parts.groupBy("clip_id", "start_ms").agg(F.sqrt(F.sum("sq") / F.sum("n")).alias("rms"))
    grid = hop_starts(clips, hop_ms).withColumnRenamed("at_ms", "start_ms")
    db = dbl(20) * F.log10(F.col("rms") + dbl(1e-12))
    return grid.join(level, ["clip_id", "start_ms"], "left").select("clip_id", "start_ms", F.coalesce(db, dbl(SILENCE_DB)).alias("rms_dbfs"))


def _flux(samples: np.ndarray) -> float:
    """Mean rise of the magnitude spectrum between neighbouring frames."""
    if len(samples) < FFT_SIZE + FFT_HOP:
        return 0.0
    frames = np.lib.stride_tricks.sliding_window_view(samples, FFT_SIZE)[::FFT_HOP]
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(FFT_SIZE), axis=1))
    return float(np.maximum(np.diff(spectrum, axis=0), 0.0).sum(axis=1).mean())


def spectral_flux(pcm: DataFrame, clips: DataFrame, rate: int, hop_ms: int = 500, window_ms: int = 1000) -> DataFrame:
    """Flux (also the onset strength) of every window.

    Samples are packed once into arrays of one window's length; a window takes its parts of the two
    or three arrays it touches, and Python transforms many windows a batch. A window holds at
    most ``rate * window_ms / 1000`` samples.
    """
    span = max(1, rate * window_ms // 1000)
    packed = _in_clip(pcm, clips, rate).groupBy("clip_id", F.floor(F.col("i") / span).cast("bigint").alias("_seg")).agg(
        F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("_s"))
    low, high = F.col("_seg") * span, (F.col("_seg") + 1) * span

    def first(start):
        return F.floor(start * rate / 1000)

    # Windows whose samples may lie in the array, one too many on each side.
    k0 = F.greatest(F.floor((low * 1000 / rate - window_ms) / hop_ms).cast("bigint") - 1, F.lit(0).cast("bigint"))
    k1 = F.floor(high * 1000 / rate / hop_ms).cast("bigint") + 1
    parts = packed.select("clip_id", "_s", F.explode(F.sequence(k0, k1)).alias("_k")).withColumn("start_ms", F.col("_k") * hop_ms)
    mine = F.filter("_s", lambda p: (p["i"] >= first(F.col("start_ms"))) & (p["i"] < first(F.col("start_ms") + window_ms)))
    parts = parts.select("clip_id", "start_ms", mine.alias("_p")).where(F.size("_p") > 0)
    whole = F.array_sort(F.flatten(F.collect_list("_p")))
    windows = parts.groupBy("clip_id", "start_ms").agg(F.transform(whole, lambda p: p["x"]).alias("x"))

    @F.pandas_udf("double")
    def measure(x: pd.Series) -> pd.Series:
        return pd.Series([_flux(np.asarray(w, float)) for w in x])

    flux = windows.select("clip_id", "start_ms", measure("x").alias("flux"))
    grid = hop_starts(clips, hop_ms).withColumnRenamed("at_ms", "start_ms")
    return grid.join(flux, ["clip_id", "start_ms"], "left").withColumn("flux", F.coalesce("flux", dbl(0)))


def audio_windows(pcm: DataFrame, clips: DataFrame, rate: int, hop_ms: int = 500, window_ms: int = 1000) -> DataFrame:
    """Level, flux and onset of every window of every clip."""
    return window_levels(pcm, clips, rate, hop_ms, window_ms).join(
        spectral_flux(pcm, clips, rate, hop_ms, window_ms), ["clip_id", "start_ms"]).withColumn("onset", F.col("flux"))
