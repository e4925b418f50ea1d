"""Contract checks: each rule set turns a table into (entity, rule) rows of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmgrain.config import SCHEMA_VERSION
from filmgrain.functions.colour import hex_code
from filmgrain.functions.numeric import dbl
from filmgrain.operators.ordered import with_previous


def violations(df: DataFrame, entity: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row per entity and broken rule. A condition is true where the rule is broken;
    null counts as kept."""
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]))
    return df.select(*entity, F.explode(broken).alias("rule_id"))


def document_keys(doc: Column, allowed: list[str]) -> dict[str, Column]:
    keys = F.json_object_keys(doc)
    return {
        "unknown_key": F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0,
        "schema_version": F.coalesce(F.get_json_object(doc, "$.schema_version"), F.lit("")) != SCHEMA_VERSION,
    }


def interval() -> dict[str, Column]:
    return {"end_after_start": F.col("end_ms") <= F.col("start_ms"), "start_not_negative": F.col("start_ms") < 0}


def shot_set(shots: DataFrame) -> DataFrame:
    """Unique ids, indices counting from zero and touching edges, per clip."""
    df = with_previous(shots, ["clip_id"], ["shot_index", "start_ms"], F.floor(F.col("shot_index") / 1024), ["shot_index", "end_ms"])
    first = F.col("prev").isNull()
    rows = violations(df, ["clip_id"], {
        "index_contiguous": F.when(first, F.col("shot_index") != 0).otherwise(F.col("shot_index") != F.col("prev.shot_index") + 1),
        "edges_touch": ~first & (F.col("start_ms") != F.col("prev.end_ms")),
    })
    twice = shots.groupBy("clip_id", "shot_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.unionByName(twice.select("clip_id", F.lit("unique_shot_id").alias("rule_id"))).distinct()


def envelope() -> dict[str, Column]:
    ok = F.col("status") == "OK"
    return {
        "ok_needs_value": ok & ~F.col("has_value"), "ok_without_reason": ok & F.col("reason_code").isNotNull(),
        "absent_without_value": ~ok & F.col("has_value"), "absent_needs_reason": ~ok & (F.coalesce("reason_code", F.lit("")) == ""),
    }


def palette(swatches: Column) -> dict[str, Column]:
    """``swatches``: array of structs with rank, proportion, hex, r, g, b in display order."""
    ranks = F.transform(swatches, lambda s: s["rank"].cast("int"))
    total = F.aggregate(swatches, dbl(0), lambda t, s: t + s["proportion"])
    shown = F.transform(swatches, lambda s: F.struct((-s["proportion"]).alias("p"), s["hex"].alias("h")))
    return {
        "ranks_contiguous": (F.size(swatches) > 0) & (ranks != F.sequence(F.lit(1), F.greatest(F.size(swatches), F.lit(1)))),
        "proportions_sum": F.abs(total - dbl(1)) > 1e-6,
        "display_order": shown != F.array_sort(shown),
        "hex_matches": F.exists(swatches, lambda s: s["hex"] != hex_code(s["r"], s["g"], s["b"])),
        "one_to_five": ~F.size(swatches).between(1, 5),
    }


def lightness() -> dict[str, Column]:
    return {"percentiles_ordered": ~((F.col("p10_lstar") <= F.col("p50_lstar")) & (F.col("p50_lstar") <= F.col("p90_lstar")))}


def box() -> dict[str, Column]:
    return {
        "box_extent": (F.col("x_max") <= F.col("x_min")) | (F.col("y_max") <= F.col("y_min")),
        "centroid_inside": ~(F.col("centroid_x").between(F.col("x_min"), F.col("x_max")) & F.col("centroid_y").between(F.col("y_min"), F.col("y_max"))),
    }


def increasing(points: DataFrame, chunk_ms: int = 16_384) -> DataFrame:
    """Clips whose points, in stored order, do not strictly rise in time."""
    df = with_previous(points, ["clip_id"], ["ord"], F.floor(F.col("ord") / chunk_ms), ["at_ms"])
    return violations(df, ["clip_id"], {"at_ms_increasing": F.col("at_ms") <= F.col("prev.at_ms")}).distinct()


def samples() -> dict[str, Column]:
    got = F.col("status") == "DECODED"
    pixels = F.col("decoded_ms").isNotNull()
    return {
        "decoded_complete": got & ~(pixels & F.col("image_sha").isNotNull()),
        "decoded_without_reason": got & F.col("unavailable_reason").isNotNull(),
        "unavailable_without_pixels": ~got & (pixels | F.col("image_sha").isNotNull()),
        "unavailable_needs_reason": ~got & F.col("unavailable_reason").isNull(),
    }


def sample_order(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Clips whose results do not repeat the plan's ids one for one, in order, or whose plan
    repeats an id. The order is part of the key, so this is one equi join."""
    p = plan.select("clip_id", "ord", F.col("sample_id").alias("want"))
    r = results.select("clip_id", "ord", F.col("sample_id").alias("got"))
    off = p.join(r, ["clip_id", "ord"], "full_outer").where(~F.col("want").eqNullSafe(F.col("got")))
    twice = plan.groupBy("clip_id", "sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return off.select("clip_id", F.lit("results_follow_plan").alias("rule_id")).unionByName(
        twice.select("clip_id", F.lit("unique_sample_id").alias("rule_id"))).distinct()


def video() -> dict[str, Column]:
    codec = F.coalesce("audio_codec", F.lit(""))
    return {
        "right_angle": ~F.col("rotation").isin(0, 90, 180, 270),
        "codec_with_audio": F.col("has_audio") & (codec == ""),
        "no_codec_without_audio": ~F.col("has_audio") & F.col("audio_codec").isNotNull(),
    }


def report() -> dict[str, Column]:
    """Over nested reports with summary_count, has_audio and audio availability."""
    index = F.transform("shots", lambda s: s["shot_index"].cast("int"))
    return {
        "shot_count": F.col("summary_count") != F.size("shots"),
        "index_contiguous": index != F.sequence(F.lit(0), F.size("shots") - 1),
        "audio_without_stream": ~F.col("has_audio") & (F.col("audio") == "COMPLETE"),
    }


def critique(sentences: Column | None = None) -> dict[str, Column]:
    ok = F.col("status") == "OK"
    rules = {
        "ok_needs_text": ok & (F.coalesce("text", F.lit("")) == ""), "absent_without_text": ~ok & F.col("text").isNotNull(),
        "text_length": F.length("text") > 1200,
    }
    if sentences is not None:
        rules["sentence_count"] = ~F.size(sentences).between(1, 3)
        rules["sentence_length"] = F.exists(sentences, lambda s: ~F.length(s).between(1, 200))
    return rules


def weights(parts: list[str]) -> dict[str, Column]:
    return {"weights_sum": F.abs(sum((F.col(p) for p in parts), dbl(0)) - dbl(1)) > 1e-9}


def rising(columns: list[str]) -> dict[str, Column]:
    cond = F.lit(False)
    for a, b in zip(columns, columns[1:]):
        cond = cond | (F.col(a) >= F.col(b))
    return {"thresholds_increase": cond}


def unique(df: DataFrame, key: list[str], rule: str) -> DataFrame:
    twice = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.select(*key, F.lit(rule).alias("rule_id"))


def missing_parent(child: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """Foreign keys without a parent; only distinct keys are shuffled."""
    return child.select(key).distinct().join(parent.select(key).distinct(), key, "left_anti").withColumn("rule_id", F.lit(rule))


def provenance() -> dict[str, Column]:
    return {"completed_after_start": F.col("completed_at") < F.col("started_at")}
