"""Queries over probe documents, stored content, names, commands and critiques."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from filmgrain.config import DEFAULT_CONFIG
from filmgrain.functions.identity import analysis_key, sha256_text, stable_uuid, storage_key
from filmgrain.functions.numeric import dbl
from filmgrain.operators import content as K, media as D, text as X
from filmgrain.plans.registry import query
from filmgrain.plans.sqltext import add_views, uuid_sql
from filmgrain.session import work_folder
from filmgrain.sources import tables as T
from filmgrain.views import Views

add_views({
    "v_probe": """SELECT p_partkey k, p_size*100 width, p_size*60 height, p_retailprice/CASE WHEN p_partkey%9=0 THEN -1 ELSE 1 END AS secs,
      CASE p_partkey%6 WHEN 0 THEN 90 WHEN 1 THEN 45 ELSE 0 END rotation, CASE p_partkey%7 WHEN 0 THEN 'vp8' WHEN 1 THEN 'hevc' WHEN 2 THEN '' ELSE 'h264' END codec,
      1+CAST(p_partkey%11=0 AS INT) video_streams, CAST(p_partkey%2=0 AS INT) audio_streams,
      CASE WHEN p_partkey%13=0 THEN 'SMPTE2084' WHEN p_partkey%13=1 THEN 'unknown' END color_transfer,
      CASE p_partkey%5 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25' WHEN 2 THEN '0/0' ELSE '24/1' END rate FROM part""",
    "v_facts": """SELECT k, CASE WHEN k%17=0 THEN 'PROBE_FAILED' WHEN k%19=0 THEN 'MEDIA_UNEXPECTED_STREAM' WHEN secs <= 0 THEN 'MEDIA_DURATION_INVALID'
      WHEN video_streams=1 AND codec='' THEN 'MEDIA_UNSUPPORTED_CODEC' WHEN video_streams=1 AND rotation=45 THEN 'MEDIA_UNSUPPORTED_ROTATION'
      WHEN video_streams=1 AND rate='0/0' THEN 'MEDIA_FRAME_RATE_UNKNOWN' WHEN audio_streams=1 AND k%8=0 THEN 'MEDIA_AUDIO_INCONSISTENT' END error_code, * FROM v_probe""",
})


def _probe(v: Views):
    """Probe documents built from parts, some of them broken in each known way."""
    k = F.col("p_partkey")

    def m(n):
        return F.pmod(k, F.lit(n))

    rotation = F.when(m(6) == 0, "90").when(m(6) == 1, "45").otherwise("0")
    codec = F.when(m(7) == 0, "vp8").when(m(7) == 1, "hevc").when(m(7) == 2, "").otherwise("h264")
    rate = F.when(m(5) == 0, "30000/1001").when(m(5) == 1, "25").when(m(5) == 2, "0/0").otherwise("24/1")
    transfer = F.when(m(13) == 0, "SMPTE2084").when(m(13) == 1, "unknown")
    video = F.struct(
        F.lit("video").alias("codec_type"), codec.alias("codec_name"), (F.col("p_size") * 100).alias("width"),
        (F.col("p_size") * 60).alias("height"), rate.alias("avg_frame_rate"), F.lit("25/1").alias("r_frame_rate"),
        F.lit("yuv420p").alias("pix_fmt"), transfer.alias("color_transfer"),
        F.when(m(12) == 0, F.create_map(F.lit("rotate"), rotation)).alias("tags"),
        F.when(m(12) != 0, F.array(F.struct(F.lit("Display Matrix").alias("side_data_type"), rotation.cast("int").alias("rotation")))).alias("side_data_list"))
    audio = F.when(m(8) == 0, F.lit('{"codec_type":"audio","codec_name":" "}')).otherwise('{"codec_type":"audio","codec_name":"aac"}')
    streams = F.concat_ws(
        ",", F.to_json(video), F.when(m(11) == 0, F.to_json(video)), F.when(m(2) == 0, audio),
        F.when(m(19) == 0, F.lit('{"codec_type":"data"}')))
    seconds = F.col("p_retailprice") / F.when(m(9) == 0, -1).otherwise(1)
    doc = F.concat(F.lit('{"format":{"duration":"'), seconds.cast("string"), F.lit('"},"streams":['), streams, F.lit("]}"))
    doc = F.when(m(17) == 0, F.substring(doc, F.lit(1), F.length(doc) - 4)).otherwise(doc)
    return v.table("part").select(k.alias("k"), doc.alias("doc"))


@query("src01_probe_facts", """
SELECT k, error_code, CASE WHEN ok THEN CAST(floor(secs*1000+0.5::DOUBLE) AS BIGINT) END duration_ms, CASE WHEN one THEN width END width,
 CASE WHEN one THEN height END height, CASE WHEN one THEN CAST(rotation AS BIGINT) END rotation, CASE WHEN one THEN codec END video_codec,
 CASE WHEN one THEN CASE rate WHEN '30000/1001' THEN 30000 WHEN '25' THEN 25 ELSE 24 END END rate_num, CASE WHEN one THEN CASE rate WHEN '30000/1001' THEN 1001 ELSE 1 END END rate_den,
 CASE WHEN one AND color_transfer='SMPTE2084' THEN color_transfer END color_transfer, CASE WHEN ok THEN video_streams END video_streams,
 CASE WHEN ok THEN audio_streams END audio_streams, CASE WHEN ok AND audio_streams=1 THEN 'aac' END audio_codec, ok AND audio_streams=1 has_audio
FROM (SELECT *, error_code IS NULL ok, error_code IS NULL AND video_streams=1 one FROM v_facts)""")
def src01(v):
    return D.probe_facts(_probe(v)).select(
        "k", "error_code", "duration_ms", "width", "height", "rotation", "video_codec", F.col("average_rate.numerator").alias("rate_num"),
        F.col("average_rate.denominator").alias("rate_den"), "color_transfer", "video_streams", "audio_streams", "audio_codec", "has_audio")


@query("prj02_reject_code", """
SELECT k, CASE WHEN k*1000000 > 1073741824 THEN 'MEDIA_TOO_LARGE' WHEN video_streams<>1 THEN 'MEDIA_VIDEO_STREAM_COUNT'
 WHEN secs <= 0 THEN 'MEDIA_DURATION_INVALID' WHEN secs*1000 > 1200000 THEN 'MEDIA_DURATION_EXCEEDED'
 WHEN CASE WHEN rotation=90 THEN height ELSE width END > 4096 OR CASE WHEN rotation=90 THEN width ELSE height END > 2160 THEN 'MEDIA_DIMENSIONS_EXCEEDED'
 WHEN rotation=45 THEN 'MEDIA_UNSUPPORTED_ROTATION' WHEN codec NOT IN ('h264','hevc') THEN 'MEDIA_UNSUPPORTED_CODEC'
 WHEN color_transfer='SMPTE2084' THEN 'MEDIA_UNSUPPORTED_TRANSFER' WHEN k%23=0 THEN 'MEDIA_AUDIO_INCONSISTENT' END reject_code FROM v_probe""")
def prj02(v):
    k = F.col("p_partkey")

    def m(n):
        return F.pmod(k, F.lit(n))

    facts = v.table("part").select(
        k.alias("k"), (k * 1_000_000).alias("size_bytes"), (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 60).alias("height"),
        (F.col("p_retailprice") * F.when(m(9) == 0, -1).otherwise(1) * 1000).alias("duration_ms"),
        F.when(m(6) == 0, 90).when(m(6) == 1, 45).otherwise(0).alias("rotation"),
        F.when(m(7) == 0, "vp8").when(m(7) == 1, "hevc").when(m(7) == 2, "").otherwise("h264").alias("video_codec"),
        (1 + (m(11) == 0).cast("int")).alias("video_streams"), (m(2) == 0).cast("int").alias("audio_streams"),
        F.when(m(13) == 0, "SMPTE2084").alias("color_transfer"), (m(2) == 0).alias("has_audio"),
        F.when((m(2) == 0) != (m(23) == 0), "aac").alias("audio_codec"))
    return facts.select("k", D.reject_code().alias("reject_code"))


@query("prj03_display_name", r"""
WITH n AS (SELECT page_id, CASE page_id%6 WHEN 0 THEN url || '/' WHEN 1 THEN url || chr(9) || 'a\b ' WHEN 2 THEN './' WHEN 3 THEN url || '/..' WHEN 4 THEN '  ' ELSE repeat(url, 30) || 'é' END raw FROM pages),
b AS (SELECT page_id, regexp_extract(regexp_replace(raw, '(/\.?)+$', ''), '([^/]*)$', 1) base FROM n),
c AS (SELECT page_id, trim(regexp_replace(CASE WHEN base='.' THEN '' ELSE base END, '[\\[:cntrl:]]', '_', 'g')) clean FROM b)
SELECT page_id, CASE WHEN clean IN ('', '.', '..') THEN 'upload' ELSE substr(clean, 1, 512) END display_name FROM c""")
def prj03(v):
    u, k = F.col("url"), F.pmod("page_id", F.lit(6))
    raw = (F.when(k == 0, F.concat(u, F.lit("/"))).when(k == 1, F.concat(u, F.lit("\ta\\b "))).when(k == 2, "./")
           .when(k == 3, F.concat(u, F.lit("/.."))).when(k == 4, "  ").otherwise(F.concat(F.repeat(u, 30), F.lit("é"))))
    return v.table("pages").select("page_id", D.display_name(raw).alias("display_name"))


@query("src02_content_address", "SELECT doc_id, sha256(text) sha, substr(sha256(text),1,2) || '/' || sha256(text) storage_key FROM documents")
def src02(v):
    h = sha256_text(F.col("text"))
    return v.table("documents").select("doc_id", h.alias("sha"), storage_key(h).alias("storage_key"))


@query("src03_dedupe_ingest", """
WITH old AS (SELECT sha, min(doc_id) doc_id FROM v_content WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1), new AS (SELECT sha, min(doc_id) doc_id FROM v_content GROUP BY 1)
SELECT new.sha, coalesce(old.doc_id, new.doc_id) doc_id, old.sha IS NOT NULL reused FROM new LEFT JOIN old ON old.sha=new.sha""")
def src03(v):
    c = v.content()
    stored = K.first_writers(K.lookup(c, v.table("labels").select("doc_id")), "sha", "doc_id")
    return K.dedupe_ingest(c, stored, "sha", "doc_id").select("sha", "doc_id", "reused")


@query("src08_insert_ignore", """
WITH old AS (SELECT DISTINCT sha FROM v_content WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT sha, min(doc_id) doc_id FROM v_content WHERE sha NOT IN (SELECT sha FROM old) GROUP BY 1""")
def src08(v):
    c = v.content()
    return K.insert_ignore(c, K.lookup(c, v.table("labels").select("doc_id")), ["sha"], "doc_id").select("sha", "doc_id")


@query("src07_upsert_summary", """
WITH a AS (SELECT o_custkey analysis_id, o_orderkey version, o_totalprice shot_length FROM orders WHERE o_orderkey%2=0 UNION ALL
 SELECT o_custkey, o_orderkey, o_totalprice*2 FROM orders WHERE o_orderkey%2=1)
SELECT analysis_id, max(version) version, arg_max(shot_length, version) shot_length FROM a GROUP BY 1""")
def src07(v):
    o = v.table("orders").select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("shot_length"))
    even = F.pmod("version", F.lit(2)) == 0
    return K.upsert(o.where(even), o.where(~even).withColumn("shot_length", F.col("shot_length") * 2), "analysis_id", "version")


def _scratch(v: Views, name: str) -> str:
    return f"{work_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


DOC = StructType([StructField("analysis_id", LongType(), False), StructField("state", StringType()), StructField("score", DoubleType())])


@query("src04_read_documents", """
SELECT CASE WHEN o_orderkey%10=0 THEN NULL ELSE o_orderkey END analysis_id, CASE WHEN o_orderkey%10=0 THEN NULL ELSE o_orderstatus END state,
 CASE WHEN o_orderkey%10=0 THEN NULL ELSE o_totalprice END score, o_orderkey%10=0 corrupt FROM orders""")
def src04(v):
    """Written out as JSON lines, every tenth cut short, and read with the fixed schema."""
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("score")))
    bad = F.pmod("o_orderkey", F.lit(10)) == 0
    path = _scratch(v, "documents")
    v.table("orders").select(F.when(bad, F.substring(doc, 1, 9)).otherwise(doc).alias("value")).write.text(path)
    df = T.read_documents(v.spark, path, DOC)
    return df.select("analysis_id", "state", "score", F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query("src05_replace_documents", """
SELECT o_orderkey analysis_id, o_orderstatus state, CASE WHEN o_orderkey%4=0 THEN o_totalprice*2 ELSE o_totalprice END score FROM orders""")
def src05(v):
    """Everything is stored, then a quarter of the analyses are stored again."""
    docs = v.table("orders").select(F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("score"))
    path = _scratch(v, "stage")
    T.replace_documents(v.spark, docs, path, "analysis_id")
    again = docs.where(F.pmod("analysis_id", F.lit(4)) == 0).withColumn("score", F.col("score") * 2)
    T.replace_documents(v.spark, again, path, "analysis_id")
    return T.read_stored(v.spark, path, "analysis_id")


@query("src06_replace_shots", """
SELECT clip_id, shot_index, start_ms, end_ms FROM v_shots WHERE clip_id%5<>0 UNION ALL
SELECT clip_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), duration_ms FROM v_clips WHERE clip_id%5=0""")
def src06(v):
    """Shots are stored, then every fifth clip is replaced by one whole-length shot and all is folded into a new base."""
    path = _scratch(v, "shots")
    T.replace_documents(v.spark, v.shots().select("clip_id", "shot_index", "start_ms", "end_ms"), path, "clip_id")
    zero = F.lit(0).cast("bigint")
    whole = v.clips().where(F.pmod("clip_id", F.lit(5)) == 0).select("clip_id", zero.alias("shot_index"), zero.alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    T.replace_documents(v.spark, whole, path, "clip_id")
    T.compact_documents(v.spark, path, "clip_id")
    return T.read_stored(v.spark, path, "clip_id")


@query("src09_statistics_csv", "SELECT clip_id, at_ms, score FROM v_scores")
def src09(v):
    path = _scratch(v, "stats")
    T.write_statistics(v.scores().select("clip_id", "at_ms", "score"), path)
    return v.spark.read.option("header", True).schema("clip_id bigint, at_ms bigint, score double").csv(path)


@query("src10_benchmark_manifest", "SELECT 'cpu_core' profile, CAST(page_id AS VARCHAR) id, url path, page_id%7<>0 required FROM pages")
def src10(v):
    """Manifests of up to 50 pages each, written as documents and read back."""
    c = F.struct(F.col("page_id").cast("string").alias("id"), F.col("url").alias("path"), F.when(F.pmod("page_id", F.lit(7)) == 0, F.lit(False)).alias("required"))
    docs = v.table("pages").groupBy(F.floor(F.col("page_id") / 50).alias("part")).agg(F.collect_list(c).alias("clips"))
    path = _scratch(v, "manifest")
    docs.select(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit("cpu_core").alias("profile"), "clips")).alias("value")).write.text(path)
    return T.read_manifest(v.spark, path, whole_files=False).select("profile", "id", "path", "required")


_TAIL = (DEFAULT_CONFIG.canonical_json() + DEFAULT_CONFIG.pipeline_version).replace("'", "''")


@query("prj04_analysis_key", f"SELECT doc_id, sha256(sha || '{_TAIL}') analysis_key FROM v_content")
def prj04(v):
    return v.content().select("doc_id", analysis_key(F.col("sha"), DEFAULT_CONFIG).alias("analysis_key"))


@query("prj05_stable_uuid", f"SELECT doc_id, {uuid_sql('doc_id', 'lang', 'source')} id FROM documents")
def prj05(v):
    return v.table("documents").select("doc_id", stable_uuid(F.col("doc_id"), F.col("lang"), F.col("source")).alias("id"))


@query("jn15_point_lookup", """
SELECT doc_id, sha FROM v_content WHERE sha IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def jn15(v):
    c = v.content()
    keys = K.lookup(c, v.table("labels").select("doc_id")).select("sha")
    return K.lookup(c, keys).select("doc_id", "sha")


@query("tk03_newest_critique", "SELECT conv_id, max(turn) turn, arg_max(text, turn) text FROM conversations WHERE role='assistant' GROUP BY 1")
def tk03(v):
    return K.newest(v.table("conversations").where("role = 'assistant'").select("conv_id", "turn", "text"), "conv_id", "turn")


# --- screening -----------------------------------------------------------------

@query("prj30_redact_fields", """
SELECT event_id, '[redacted]' api_key, '[redacted]' path, CASE event_id%3 WHEN 0 THEN '[redacted]' WHEN 1 THEN '[redacted]' ELSE props END note, event_type kind FROM events""")
def prj30(v):
    note = F.when(F.pmod("event_id", F.lit(3)) == 0, F.concat(F.lit("/Users/"), F.col("event_type"))).when(
        F.pmod("event_id", F.lit(3)) == 1, F.concat(F.lit("C:\\"), F.col("event_type"))).otherwise(F.col("props"))
    fields = F.create_map(F.lit("X-Api-Key"), F.col("props"), F.lit("Local_Path"), F.col("props"), F.lit("note"), note, F.lit("kind"), F.col("event_type"))
    out = X.redact(fields)
    return v.table("events").select("event_id", out["X-Api-Key"].alias("api_key"), out["Local_Path"].alias("path"), out["note"].alias("note"), out["kind"].alias("kind"))


@query("prj31_command_verdict", """
SELECT event_id, CASE WHEN event_id%9=0 THEN 'not_an_object' WHEN event_id%10=0 THEN 'forbidden_key' WHEN event_id%11=0 THEN 'host_path'
 WHEN event_id%13=0 THEN 'too_large' WHEN event_id%7=0 THEN 'schema_invalid' ELSE 'ok' END verdict FROM events""")
def prj31(v):
    k = F.col("event_id")

    def m(n):
        return F.pmod(k, F.lit(n)) == 0

    extra = F.concat(
        F.when(m(10), F.concat(F.lit(',"trace":{"deep":[{"frames":'), F.col("props"), F.lit("}]}"))).otherwise(""),
        F.when(m(11), F.lit(',"note":["\\/users\\/x"]')).otherwise(""),
        F.when(m(13), F.concat(F.lit(',"pad":"'), F.repeat(F.lit("é"), 1400), F.lit('"'))).otherwise(""),
        F.when(m(7), F.concat(F.lit(',"extra":'), F.col("props"))).otherwise(""))
    doc = F.concat(
        F.lit('{"schema_version":"1.0","analysis_id":"'), stable_uuid(k), F.lit('","stage_name":"say \\"path\\": '), F.col("event_type"),
        F.lit('","input_artifact_ids":["'), stable_uuid("a", k), F.lit('"],"configuration_hash":"'), F.sha2(F.col("props"), 256),
        F.lit('","pipeline_version":"0.1.0","requested_at":"2024-01-01T00:00:00Z","trace_id":"t"'), extra, F.lit("}"))
    doc = F.when(m(9), F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc)
    return X.screen_commands(v.table("events").select("event_id", doc.alias("doc"))).select("event_id", "verdict")


_STEMS = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in X.FORBIDDEN_STEMS) + "]"


@query("prj32_audit_critique", rf"""
WITH t AS (SELECT conv_id, turn, text || ' ' || (conv_id%40) || ' shots, ' || (conv_id%7+0.5) || 's, #AA00' || CASE WHEN conv_id%5=0 THEN 'BB' ELSE 'cc' END
  || CASE WHEN conv_id%6=0 THEN ' emotion' ELSE '' END txt, conv_id%40+CASE WHEN conv_id%3=0 THEN 1 ELSE 0 END sc FROM conversations),
a AS (SELECT *, [sc::DOUBLE, 3.5, 2.25, 0.25, 1.0, 0.5, 1.0, 0.61, 4.5] base FROM t),
b AS (SELECT *, base || list_transform(base, lambda x: round_even(x*100, 0)) || list_transform(base, lambda x: round_even(x*100, 1)) allowed,
  regexp_extract_all(regexp_replace(txt, '#[0-9A-Fa-f]{{6}}', ' ', 'g'), '\d+(?:\.\d+)?') nums FROM a),
c AS (SELECT conv_id, turn, list_filter({_STEMS}, lambda s: contains(lower(txt), s))[1] stem, list_filter(regexp_extract_all(txt, '#[0-9A-Fa-f]{{6}}'), lambda h: upper(h) <> '#AA00CC')[1] colour,
  list_filter(nums, lambda n: len(list_filter(allowed, lambda x: abs(x-n::DOUBLE) <= 0.011)) = 0)[1] num FROM b)
SELECT conv_id, turn, CASE WHEN stem IS NOT NULL THEN 'forbidden_stem' WHEN colour IS NOT NULL THEN 'unknown_colour' WHEN num IS NOT NULL THEN 'unknown_number' ELSE 'ok' END verdict,
 coalesce(stem, colour, num) token FROM c""")
def prj32(v):
    k = F.col("conv_id")

    def m(n):
        return F.pmod(k, F.lit(n))

    text = F.concat(
        F.col("text"), F.lit(" "), m(40).cast("string"), F.lit(" shots, "), (m(7) + dbl(0.5)).cast("string"), F.lit("s, #AA00"),
        F.when(m(5) == 0, "BB").otherwise("cc"), F.when(m(6) == 0, " emotion").otherwise(""))
    palette = F.array(F.lit("#AA00CC"))
    facts = {"shot_count": m(40) + F.when(m(3) == 0, 1).otherwise(0), "asl_seconds": dbl(3.5), "median_seconds": dbl(2.25),
             "low_key_ratio": dbl(0.25), "chromatic_valid_ratio": dbl(1), "spatial_valid_ratio": dbl(0.5), "median_thirds": dbl(0.61)}
    allowed = X.allowed_numbers(facts, palette, F.array(dbl(4.5)))
    verdict, token = X.audit_text(text, allowed, palette)
    return v.table("conversations").select("conv_id", "turn", verdict.alias("verdict"), token.alias("token"))


@query("prj33_critique_key", """
SELECT doc_id, sha256('{"shot_count":' || n_chars || ',"source":"' || source || '"}' || 'critic-prompt-v1' || 'fake') key FROM documents""")
def prj33(v):
    doc = F.to_json(F.struct(F.col("n_chars").alias("shot_count"), "source"))
    return v.table("documents").select("doc_id", X.critique_key(doc, "critic-prompt-v1", "fake").alias("key"))
