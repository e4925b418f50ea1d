"""Reports: assembly, availability, summary facts and the flat views readers use.

A clip has at most ``max_duration_ms / min_shot_ms`` shots, so one report row per clip
with its shots nested is bounded; all roll-ups are plain aggregates over shot rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from filmgrain.config import AnalysisConfig, DEFAULT_CONFIG, SCHEMA_VERSION
from filmgrain.functions.numeric import clip, dbl, round_decimal
from filmgrain.schemas import REPORT, keys

PILLAR_KIND = {
    "shots": "Measured", "chromatic": "Measured", "spatial": "Estimated", "motion": "Measured",
    "audio": "Measured", "tension": "Measured", "critic": "Interpreted",
}
MEASURES = ("chromatic", "spatial", "temporal")
SHOT_IDS = ("incoming_boundary_id", "outgoing_boundary_id", "representative_sample_id")


def envelope(status: Column, value: Column, confidence: Column, reason: Column, fallback: str,
             evidence: Column, method: Column) -> Column:
    """Measurement struct: a value only when OK, a reason only when not."""
    ok = status == "OK"
    why = F.coalesce(F.nullif(reason, F.lit("")), F.lit(fallback))
    return F.struct(
        status.alias("status"), F.when(ok, value).alias("value"),
        F.when(ok, confidence).cast("double").alias("confidence"),
        F.when(~ok, why).alias("reason_code"), evidence.alias("evidence_sample_ids"), method.alias("method"))


def provenance(method: str, version: str, config_hash: str, revision: str, started: Column, completed: Column,
               seed: int | None = None, model: str | None = None, device: str | None = "cpu") -> Column:
    text = "string"
    return F.struct(
        F.lit(method).alias("method"), F.lit(version).alias("method_version"), F.lit(config_hash).alias("config_hash"),
        F.lit(revision).alias("code_revision"), F.lit(seed).cast("bigint").alias("random_seed"),
        F.lit(model).cast(text).alias("model_name"), F.lit(device).cast(text).alias("device"),
        started.alias("started_at"), completed.alias("completed_at"))


def assemble(shots: DataFrame, chromatic: DataFrame, spatial: DataFrame, temporal: DataFrame) -> DataFrame:
    """One row per clip: its shots in order, each with three envelopes.

    Measurements are left-joined so a shot is never lost; ``missing`` counts the shots
    without one of them and is a contract error when above zero. The ids of boundaries and of the representative
    sample come along where ``shots`` has them.
    """
    key = ["clip_id", "shot_index"]
    df = shots.withColumns({c: F.lit(None).cast("string") for c in SHOT_IDS if c not in shots.columns})
    for name, m in zip(MEASURES, (chromatic, spatial, temporal)):
        df = df.join(m.select(*key, F.col("measure").alias(name)), key, "left")
    gap = sum((F.col(m).isNull().cast("int") for m in MEASURES), F.lit(0))
    item = F.struct("shot_index", "shot_id", "start_ms", "end_ms", *SHOT_IDS, *MEASURES)
    return df.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("shot_count"), F.sum(gap).alias("missing"), F.array_sort(F.collect_list(item)).alias("shots"))


def report_documents(reports: DataFrame, heads: DataFrame, config: AnalysisConfig = DEFAULT_CONFIG,
                     names: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """JSON text of each report with every field of the fixed schema present. Where the evidence is held in another form than sample
    ids, ``names`` gives the ids from clip, shot index and the array of evidence.

    ``heads``: clip_id, analysis_id, generated_at and the structs video, availability and
    summary, one row per clip; timeline_artifact and critique, where it has them, are told too.
    """
    heads = heads.withColumns({c: F.lit(None).cast("string") for c in ("timeline_artifact", "critique") if c not in heads.columns})

    def analysis(s: Column) -> Column:
        shot = F.struct(
            s["shot_id"].alias("shot_id"), s["shot_index"].alias("index"),
            F.struct(s["start_ms"].alias("start_ms"), s["end_ms"].alias("end_ms")).alias("time_range"), *[s[c].alias(c) for c in SHOT_IDS])
        return F.struct(shot.alias("shot"), *[told(s, m).alias(m) for m in MEASURES])

    def told(s: Column, m: str) -> Column:
        if names is None:
            return s[m]
        return s[m].withField("evidence_sample_ids", names(F.col("clip_id"), s["shot_index"], s[m]["evidence_sample_ids"]))

    whole = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "analysis_id", "video", "generated_at",
        F.lit(config.pipeline_version).alias("pipeline_version"), F.lit(config.hash()).alias("configuration_hash"),
        "availability", "summary", F.transform("shots", analysis).alias("shots"),
        "timeline_artifact", "critique")
    return reports.join(heads, "clip_id").select("analysis_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("doc"))


def report_verdicts(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Reads report documents with the fixed schema: identity, shot count and the first
    broken document rule, null for a valid report."""
    r = F.col("_r")
    df = docs.withColumn("_r", F.from_json(doc, REPORT))
    index = F.transform(r["shots"], lambda s: s["shot"]["index"])
    extra = F.size(F.array_except(F.json_object_keys(doc), F.array(*[F.lit(k) for k in keys(REPORT)]))) > 0
    count = F.coalesce(F.size(r["shots"]), F.lit(0))
    problem = (
        F.when(r["analysis_id"].isNull() | F.try_parse_json(doc).isNull(), "not_a_report").when(extra, "unknown_key")
        .when(r["schema_version"].isNull() | (r["schema_version"] != SCHEMA_VERSION), "schema_version")
        .when((count == 0) | (r["summary"]["shot_count"] != count), "shot_count")
        .when(index != F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), "index_contiguous")
        .when(~r["video"]["has_audio"] & (r["availability"]["audio"] == "COMPLETE"), "audio_without_stream"))
    return df.select(*[c for c in docs.columns if c != doc], r["analysis_id"].alias("document_id"), r["schema_version"].alias("schema_version"),
                     count.alias("shot_count"), problem.alias("problem"), problem.isNull().alias("valid"))


def metric_kind(status: Column) -> Column:
    return F.when(status == "OK", "Measured").otherwise("Unavailable")


def _level(every: Column, some: Column) -> Column:
    return F.when(every, "COMPLETE").when(some, "PARTIAL").otherwise("UNAVAILABLE")


def availability(shot_rows: DataFrame) -> DataFrame:
    """Per-clip availability from shot rows with c_status, s_status, global_motion and the
    clip's audio_status and point count."""
    ok = F.col("c_status") == "OK"
    sure = F.col("s_status").isin("OK", "NO_SUBJECT")
    moved = F.col("global_motion").isNotNull()
    idle = F.bool_and(F.col("s_status") == "NOT_COMPUTED")
    return shot_rows.groupBy("clip_id").agg(
        F.lit("COMPLETE").alias("shots"),
        _level(F.bool_and(ok), F.bool_or(ok)).alias("chromatic"),
        F.when(idle, "UNAVAILABLE").otherwise(_level(F.bool_and(sure), F.bool_or(sure))).alias("spatial"),
        _level(F.bool_and(moved), F.bool_or(moved)).alias("motion"),
        F.when(F.max("audio_status") == "OK", "COMPLETE").otherwise("UNAVAILABLE").alias("audio"),
        F.when(F.max("point_count") > 0, "COMPLETE").otherwise("UNAVAILABLE").alias("tension"),
        F.lit("NOT_REQUESTED").alias("critic"),
    )


def weighted_palette(swatches: DataFrame, top: int = 3) -> DataFrame:
    """Most present colours of each clip by proportion times shot length, ties by hex.

    Weights are compared to six places, as a shot's last proportion is what the others leave of one and sums depend on
    their order: their last digits would part equal colours.
    """
    weight = swatches.groupBy("clip_id", "hex").agg(F.sum(F.col("proportion") * F.col("length_ms")).alias("weight"))
    order = Window.partitionBy("clip_id").orderBy(F.round("weight", 6).desc(), "hex")
    return weight.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def first_peaks(peaks: DataFrame, top: int = 8) -> DataFrame:
    """The first peaks of each clip in time, as display seconds."""
    order = Window.partitionBy("clip_id").orderBy("at_ms")
    return peaks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn(
        "peak_seconds", round_decimal(F.col("at_ms") / dbl(1000), 1))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, dbl(0)).otherwise(round_decimal(part / F.when(whole > 0, whole), 2))


def critic_facts(shot_rows: DataFrame, swatches: DataFrame, peaks: DataFrame) -> DataFrame:
    """Compact facts of each report: counts, display seconds, ratios, palette and peaks.

    Medians here run over a clip's shots (bounded).
    """
    length = F.col("end_ms") - F.col("start_ms")
    c_ok, s_ok = F.col("c_status") == "OK", F.col("s_status") == "OK"
    base = shot_rows.groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("shot_count"), F.avg(length).alias("_mean"), F.percentile(length, F.lit(0.5)).alias("_median"),
        F.count_if(c_ok & (F.col("lighting_key") == "LOW_KEY_ESTIMATE")).alias("_low"), F.count_if(c_ok).alias("_c"),
        F.count_if(s_ok).alias("_s"), F.percentile(F.when(s_ok, F.col("thirds")), F.lit(0.5)).alias("_thirds"),
        (F.max("has_audio") & (F.max("audio_status") == "OK")).alias("audio_available"))
    colours = weighted_palette(swatches).groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "hex")))["hex"].alias("palette"))
    times = first_peaks(peaks).groupBy("clip_id").agg(F.array_sort(F.collect_list("peak_seconds")).alias("peak_seconds"))
    return base.join(colours, "clip_id", "left").join(times, "clip_id", "left").select(
        "clip_id", "shot_count",
        round_decimal(F.col("_mean") / dbl(1000), 2).alias("asl_seconds"),
        round_decimal(F.col("_median") / dbl(1000), 2).alias("median_seconds"),
        _ratio(F.col("_low"), F.col("_c")).alias("low_key_ratio"),
        _ratio(F.col("_c"), F.col("shot_count")).alias("chromatic_valid_ratio"),
        _ratio(F.col("_s"), F.col("shot_count")).alias("spatial_valid_ratio"),
        round_decimal(F.col("_thirds"), 2).alias("median_thirds"),
        F.coalesce("palette", F.array().cast("array<string>")).alias("palette"),
        F.coalesce("peak_seconds", F.array().cast("array<double>")).alias("peak_seconds"),
        "audio_available",
    )


def facts_json() -> Column:
    """Canonical JSON of a facts row: sorted keys, nulls kept."""
    return F.to_json(F.struct(
        F.struct(F.col("median_thirds").alias("median_thirds_proximity"), F.col("spatial_valid_ratio").alias("valid_shot_ratio")).alias("composition"),
        F.struct("asl_seconds", "median_seconds", "shot_count").alias("editing"),
        F.struct("low_key_ratio", F.col("chromatic_valid_ratio").alias("valid_shot_ratio")).alias("lighting"),
        F.col("palette"), F.lit("1.0").alias("schema_version"),
        F.struct("audio_available", "peak_seconds").alias("tension_proxy"),
    ), {"ignoreNullFields": "false"})


# --- reader views --------------------------------------------------------------

def timecode(ms: Column) -> Column:
    """[HH:]MM:SS.mmm; negative instants give null."""
    def part(unit: int, mod: int) -> Column:
        return F.pmod(F.floor(ms / unit), F.lit(mod)).cast("int")

    hours = F.floor(ms / 3_600_000).cast("int")
    tail = F.format_string("%02d:%02d.%03d", part(60_000, 60), part(1000, 60), part(1, 1000))
    return F.when(ms >= 0, F.when(hours > 0, F.concat(F.format_string("%02d:", hours), tail)).otherwise(tail))


def seek_seconds(ms: Column) -> Column:
    return F.when(ms >= 0, F.floor(ms / 1000).cast("bigint"))


def pillar_rows(avail: DataFrame, key: str = "clip_id") -> DataFrame:
    """One row per clip and pillar with how its numbers are to be read."""
    rows = avail.unpivot([key], list(PILLAR_KIND), "pillar", "availability")
    kind = F.create_map(*[F.lit(x) for kv in PILLAR_KIND.items() for x in kv])
    return rows.withColumn("kind", F.when(F.col("availability") != "COMPLETE", "Unavailable").otherwise(F.element_at(kind, F.col("pillar"))))


def evidence_chips(facts: DataFrame) -> DataFrame:
    """Labelled facts in display order; optional facts that are absent give no chip."""
    def one(label: Column, kind: str) -> Column:
        return F.struct(label.alias("label"), F.lit(kind).alias("kind"))

    def say(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def many(values: Column, head: str, tail: str) -> Column:
        return F.transform(values, lambda x: one(say(head, x, tail), "Measured"))

    c = F.col
    fixed = F.array(
        one(say(c("shot_count"), " shots"), "Measured"), one(say("ASL ", c("asl_seconds"), "s"), "Measured"),
        one(say("median ", c("median_seconds"), "s"), "Measured"), one(say("low-key estimate ", c("low_key_ratio")), "Estimated"),
        one(say("chromatic valid ", c("chromatic_valid_ratio")), "Measured"), one(say("spatial valid ", c("spatial_valid_ratio")), "Estimated"))
    maybe = F.array(F.when(c("median_thirds").isNotNull(), one(say("thirds proximity ", c("median_thirds")), "Estimated")))
    audio = F.array(F.when(c("audio_available"), one(F.lit("audio present"), "Measured")))
    chips = F.array_compact(F.concat(fixed, maybe, many(c("palette"), "", ""), audio, many(c("peak_seconds"), "peak ", "s")))
    return facts.select("clip_id", F.posexplode(chips).alias("position", "_chip")).select("clip_id", "position", "_chip.*")


def palette_bars(swatches: DataFrame) -> DataFrame:
    return swatches.withColumn("width_pct", round_decimal(F.col("proportion") * dbl(100), 4))


def shot_bars(shots: DataFrame) -> DataFrame:
    length = F.col("end_ms") - F.col("start_ms")
    return shots.withColumns({
        "duration_ms": length, "label": F.concat(F.lit("shot "), F.col("shot_index").cast("string"), F.lit(" · "), timecode(length))})


def lightness_markers(rows: DataFrame) -> DataFrame:
    """Lightness values of shots whose colour measurement is OK."""
    return rows.where(F.col("status") == "OK").select(
        *[c for c in ("clip_id", "shot_index", "shot_id") if c in rows.columns],
        F.col("p10_lstar").alias("p10"), F.col("p50_lstar").alias("p50"), F.col("p90_lstar").alias("p90"),
        F.col("mean_lstar").alias("mean"), "shadow_ratio", "highlight_ratio")


def subject_schematic() -> dict[str, Column]:
    """A centred box that stands for median coverage and height."""
    w = clip(F.sqrt("subject_coverage_ratio_median"), 0.05, 1)
    h = clip(F.col("subject_height_ratio_median"), 0.05, 1)
    return {"x": (dbl(1) - w) / 2, "y": F.greatest(dbl(0), (dbl(1) - h) / 2), "width": w, "height": h}


def tension_series(points: DataFrame, shots: DataFrame) -> DataFrame:
    """Parallel component arrays of each clip plus its internal shot starts.

    Call it on thinned points: a clip then has at most 2,000.
    """
    traces = ("cut_activity", "audio_activity", "motion_activity", "combined_proxy")
    rows = points.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("at_ms", *traces))).alias("_p"))
    starts = shots.groupBy("clip_id").agg(F.array_sort(F.collect_list("start_ms")).alias("_s"))
    inner = F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0)))
    return rows.join(starts, "clip_id").select("clip_id", *[F.col(f"_p.{c}").alias(c) for c in ("at_ms", *traces)], inner.alias("shot_boundary_ms"))


def flat_report(reports: DataFrame) -> DataFrame:
    """One flat row per shot of nested reports; absent values stay null."""
    df = reports.select("clip_id", F.explode("shots").alias("s"))
    return df.select(
        "clip_id", F.col("s.shot_index").alias("shot_index"), F.col("s.shot_id").alias("shot_id"),
        F.col("s.start_ms").alias("start_ms"), F.col("s.end_ms").alias("end_ms"),
        F.coalesce(F.transform("s.chromatic.value.palette", lambda p: p["hex"]), F.array().cast("array<string>")).alias("palette"),
        F.col("s.chromatic.value.lighting_key").alias("lighting_key"),
        F.col("s.chromatic.value.usable_pixel_ratio").alias("usable_pixel_ratio"),
        F.col("s.spatial.value.framing").alias("framing"), F.col("s.spatial.value.thirds").alias("thirds_proximity"),
        F.col("s.temporal.value.global_motion").alias("global_motion_magnitude"),
        F.col("s.temporal.value.residual_motion").alias("residual_motion_magnitude"))
