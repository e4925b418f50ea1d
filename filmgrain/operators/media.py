"""Probe documents to facts, acceptance rules and display names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmgrain.config import Limits
from filmgrain.functions.numeric import duration_ms

# Accepted codecs, high-dynamic-range transfers and right angles.
CODECS = ("h264", "hevc", "vp9", "av1", "mpeg4")
HDR_TRANSFERS = ("smpte2084", "arib-std-b67", "smpte428", "smpte428-1")
RIGHT_ANGLES = (0, 90, 180, 270)

STREAM = ("struct<codec_type:string,codec_name:string,width:string,height:string,avg_frame_rate:string,r_frame_rate:string,"
          "pix_fmt:string,color_transfer:string,tags:map<string,string>,"
          "side_data_list:array<struct<side_data_type:string,rotation:string>>>")
DOCUMENT = f"struct<format:struct<duration:string>,streams:array<{STREAM}>>"


def _text(c: Column) -> Column:
    """Trimmed text; blank, unknown and unspecified count as absent."""
    t = F.trim(c)
    return F.when((t != "") & ~F.lower(t).isin("unknown", "unspecified"), t)


def _rate(raw: Column) -> Column:
    """``num/den`` or a whole number, both parts above zero; else null."""
    num = F.regexp_extract(raw, r"^\s*\+?(\d+)(?:/\+?(\d+))?\s*$", 1)
    den = F.regexp_extract(raw, r"^\s*\+?(\d+)(?:/\+?(\d+))?\s*$", 2)
    n = F.nullif(num, F.lit("")).try_cast("bigint")
    d = F.when(F.contains(raw, F.lit("/")), F.nullif(den, F.lit("")).try_cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    return F.when((n > 0) & (d > 0), F.struct(n.alias("numerator"), d.alias("denominator")))


def _rotation(stream: Column) -> Column:
    """Raw rotation text: the tag, else the first display-matrix entry, else zero."""
    tag = F.coalesce(stream["tags"]["rotate"], stream["tags"]["ROTATE"])
    sides = F.filter(stream["side_data_list"], lambda s: F.contains(F.lower(F.coalesce(s["side_data_type"], F.lit(""))), F.lit("display matrix")) & s["rotation"].isNotNull())
    return F.coalesce(tag, F.get(sides, F.lit(0))["rotation"], F.lit("0"))


def probe_facts(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One facts row per document; a document that cannot be used carries ``error_code``."""
    v = F.try_parse_json(F.col(doc))
    shaped = (
        F.try_variant_get(v, "$.streams", "array<variant>").isNotNull()
        & F.try_variant_get(v, "$.format", "map<string,variant>").isNotNull()
    )
    df = docs.withColumns({"_ok": F.coalesce(shaped, F.lit(False)), "_d": F.from_json(F.col(doc), DOCUMENT)})
    streams = F.when(F.col("_ok"), F.col("_d.streams"))
    df = df.withColumns({
        "_video": F.filter(streams, lambda s: s["codec_type"] == "video"),
        "_audio": F.filter(streams, lambda s: s["codec_type"] == "audio"),
        "_malformed": F.exists(streams, lambda s: s.isNull()),
        "_foreign": F.exists(streams, lambda s: ~F.coalesce(s["codec_type"], F.lit("")).isin("video", "audio")),
    })
    one = F.size("_video") == 1
    video, audio = F.get("_video", F.lit(0)), F.get("_audio", F.lit(0))
    turn = F.pmod(F.bround(_rotation(video).try_cast("double")).cast("bigint"), F.lit(360).cast("bigint"))
    width, height = video["width"].try_cast("int"), video["height"].try_cast("int")
    df = df.withColumns({
        "duration_ms": duration_ms(F.col("_d.format.duration").try_cast("double")),
        "width": F.when(one, width), "height": F.when(one, height), "rotation": F.when(one, turn),
        "video_codec": F.when(one, F.nullif(F.trim(video["codec_name"]), F.lit(""))),
        "pixel_format": F.when(one, _text(video["pix_fmt"])),
        "average_rate": F.when(one, _rate(video["avg_frame_rate"])),
        "real_rate": F.when(one, _rate(video["r_frame_rate"])),
        "color_transfer": F.when(one, _text(video["color_transfer"])),
        "video_streams": F.size("_video"), "audio_streams": F.size("_audio"),
        "audio_codec": F.when(F.size("_audio") == 1, F.nullif(F.trim(audio["codec_name"]), F.lit(""))),
    })
    bad_size = F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(True))
    error = (
        F.when(~F.col("_ok") | F.col("_malformed"), "PROBE_FAILED")
        .when(F.col("_foreign"), "MEDIA_UNEXPECTED_STREAM")
        .when(F.col("duration_ms").isNull(), "MEDIA_DURATION_INVALID")
        .when(one & F.col("video_codec").isNull(), "MEDIA_UNSUPPORTED_CODEC")
        .when(one & bad_size, "MEDIA_DIMENSIONS_INVALID")
        .when(one & ~F.coalesce(F.col("rotation").isin(*RIGHT_ANGLES), F.lit(False)), "MEDIA_UNSUPPORTED_ROTATION")
        .when(one & F.col("average_rate").isNull(), "MEDIA_FRAME_RATE_UNKNOWN")
        .when((F.col("audio_streams") == 1) & F.col("audio_codec").isNull(), "MEDIA_AUDIO_INCONSISTENT")
    )
    keep = [c for c in docs.columns if c != doc]
    facts = ["duration_ms", "width", "height", "rotation", "video_codec", "pixel_format", "average_rate", "real_rate",
             "color_transfer", "video_streams", "audio_streams", "audio_codec"]
    df = df.withColumn("error_code", error)
    fine = F.col("error_code").isNull()
    return df.select(*keep, "error_code", *[F.when(fine, F.col(c)).alias(c) for c in facts],
                     (fine & (F.col("audio_streams") == 1)).alias("has_audio"))


def reject_code(limits: Limits = Limits()) -> Column:
    """First failing acceptance rule, null when the facts are accepted."""
    turned = F.col("rotation").isin(90, 270)
    w = F.when(turned, F.col("height")).otherwise(F.col("width"))
    h = F.when(turned, F.col("width")).otherwise(F.col("height"))
    hdr = F.regexp_replace(F.lower("color_transfer"), "_", "-").isin(*HDR_TRANSFERS)
    return (
        F.when(F.col("size_bytes") > limits.max_upload_bytes, "MEDIA_TOO_LARGE")
        .when(F.col("video_streams") != 1, "MEDIA_VIDEO_STREAM_COUNT")
        .when(F.col("audio_streams") > 1, "MEDIA_AUDIO_STREAM_COUNT")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "MEDIA_DIMENSIONS_INVALID")
        .when(F.col("duration_ms") <= 0, "MEDIA_DURATION_INVALID")
        .when(F.col("duration_ms") > limits.max_duration_ms, "MEDIA_DURATION_EXCEEDED")
        .when((w > limits.max_width) | (h > limits.max_height), "MEDIA_DIMENSIONS_EXCEEDED")
        .when(~F.col("rotation").isin(*RIGHT_ANGLES), "MEDIA_UNSUPPORTED_ROTATION")
        .when(~F.col("video_codec").isin(*CODECS), "MEDIA_UNSUPPORTED_CODEC")
        .when(hdr, "MEDIA_UNSUPPORTED_TRANSFER")
        .when(F.col("has_audio") != F.col("audio_codec").isNotNull(), "MEDIA_AUDIO_INCONSISTENT")
    )


def display_name(raw: Column) -> Column:
    """Last path part with anything unprintable replaced, trimmed, at most 512 long."""
    base = F.regexp_extract(F.regexp_replace(raw, r"(/\.?)+$", ""), r"([^/]*)$", 1)
    base = F.when(base == ".", F.lit("")).otherwise(base)
    clean = F.trim(F.regexp_replace(base, r"[\\]|[\p{C}\p{Z}&&[^ ]]", "_"))
    return F.when(clean.isin("", ".", ".."), "upload").otherwise(F.substring(clean, 1, 512))
