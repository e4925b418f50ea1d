"""Readers, writers, provenance rules and streaming against batch."""

import json
import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from filmgrain import schemas
from filmgrain.operators import jobs as J, metrics as M, quality as Q, report as R, sampling as P
from filmgrain.operators.pillars import Pillars
from filmgrain.session import work_folder
from filmgrain.sources import tables as T
from filmgrain.streaming import twins as ST

DOC = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_documents_keep_bad_text_or_fail(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":1,"name":"x"}\n{"id":\n')
    rows = {r.id: r["_corrupt_record"] for r in T.read_documents(spark, str(tmp_path), DOC).cache().collect()}
    assert rows == {1: None, None: '{"id":'}
    with pytest.raises(Exception):
        T.read_documents(spark, str(tmp_path), DOC, strict=True).collect()


def test_whole_file_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": "1.0", "profile": "cpu_core", "clips": [{"id": "a", "path": "p"}, {"id": "b", "path": "q", "required": False}]}, indent=1))
    assert [(r.id, r.required) for r in T.read_manifest(spark, str(tmp_path)).orderBy("id").collect()] == [("a", True), ("b", False)]


def test_binary_files_are_addressed(spark, tmp_path):
    import hashlib
    (tmp_path / "x.bin").write_bytes(b"abc")
    r = T.read_files(spark, str(tmp_path), "*.bin").first()
    h = hashlib.sha256(b"abc").hexdigest()
    assert (r.sha256, r.storage_key, r.length) == (h, f"{h[:2]}/{h}", 3)


def rows_in(spark, path, **place):
    return spark.read.parquet(path).where(" and ".join(f"{k} = {v}" for k, v in place.items())).count()


def test_replacing_one_key_leaves_the_others(spark, table, tmp_path):
    """A replacement writes its own rows only, deletions are tombstones, and a new base folds all together."""
    path = str(tmp_path / "t")
    stored = lambda: sorted((r.k, r.v) for r in T.read_stored(spark, path, "k").collect())
    T.replace_documents(spark, table("k int, v int", [(i, j) for i in range(20) for j in range(3)]), path, "k", buckets=4)
    T.replace_documents(spark, table("k int, v int", [(5, 99), (77, 1)]), path, "k", buckets=8)
    want = sorted([(i, j) for i in range(20) if i != 5 for j in range(3)] + [(5, 99), (77, 1)])
    assert stored() == want and rows_in(spark, path, store_generation=1) == 2
    T.delete_documents(spark, table("k int", [(3,), (3,), (500,)]), path, "k")
    assert rows_in(spark, path, store_generation=2) == 2
    T.replace_documents(spark, table("k int, v int", [(5, 7), (5, 8)]), path, "k")
    want = sorted([x for x in want if x[0] not in (3, 5)] + [(5, 7), (5, 8)])
    assert stored() == want
    T.compact_documents(spark, path, "k")
    assert stored() == want and rows_in(spark, path, store_base=1) == len(want)
    T.replace_documents(spark, table("k int, v int", [(3, 1)]), path, "k")
    assert stored() == sorted([*want, (3, 1)])
    assert T.read_stored(spark, path, "k").columns == ["k", "v"]


def test_statistics_csv_has_a_header(spark, table, tmp_path):
    T.write_statistics(table("a int, b double", [(1, 2.5)]), str(tmp_path / "s"))
    lines = {line for p in os.listdir(tmp_path / "s") if p.endswith(".csv") for line in (tmp_path / "s" / p).read_text().split()}
    assert lines == {"a,b", "1,2.5"}


def test_pillar_backends(spark, table):
    p = Pillars("shot_id", StructType([StructField("v", DoubleType())]), "detector_not_installed")
    p.register("half", lambda df: df.withColumns({"status": F.lit("OK"), "reason_code": F.lit(None), "v": F.col("shot_id") / 2}))
    df = table("shot_id int", [(4,)])
    assert tuple(df.transform(p("half")).first()) == (4, "OK", None, 2.0)
    assert tuple(df.transform(p("none")).first()) == (4, "NOT_COMPUTED", "detector_not_installed", None)


def test_next_stage_waits_for_work_in_flight(spark, table):
    runs = table("analysis_id int, stage_name string, attempt int, state string", [
        (1, "sampling", 1, "SUCCEEDED"), (1, "report", 1, "LEASED"), (2, "sampling", 1, "FAILED_RETRYABLE"), (2, "sampling", 2, "SKIPPED"),
        (3, "sampling", 1, "FAILED_TERMINAL"), (4, "report", 1, "SUCCEEDED"), *[(5, s, 1, "SUCCEEDED") for s in J.STAGES]])
    assert {r.analysis_id: r.next_stage for r in J.next_stage(runs).collect()} == {1: None, 2: "report", 3: None, 4: "sampling", 5: None}


def test_metric_labels(spark, table):
    rows = [("stage_duration_ms", {"stage": "report"}, "histogram", -5), ("stage_duration_ms", {"stage": "report"}, "histogram", 7),
            ("cache_hits_total", {"stage": "weird"}, "counter", 2), ("nope", {"stage": "report"}, "counter", 1), ("queue_wait_ms", {}, "histogram", 1)]
    e = table("name string, labels map<string,string>, kind string, value bigint", rows)
    got = {(r.name, r.series): (r.counter_total, r.samples, r.sample_sum, r.sample_max) for r in M.metrics_rollup(e).collect()}
    assert got == {("stage_duration_ms", "stage=report"): (None, 2, 7, 7), ("cache_hits_total", "stage=other"): (2, 0, None, None)}
    assert sorted(r.problem for r in M.refused_metrics(e).collect()) == ["missing_labels", "unknown_metric"]


def test_broken_shot_sets(spark, table):
    ok = [(1, i, f"a{i}", i * 10, i * 10 + 10) for i in range(2000)]
    bad = [(2, 0, "x", 0, 10), (2, 2, "x", 11, 20)]
    got = {(r.clip_id, r.rule_id) for r in Q.shot_set(table("clip_id int, shot_index int, shot_id string, start_ms int, end_ms int", ok + bad)).collect()}
    assert got == {(2, "index_contiguous"), (2, "edges_touch"), (2, "unique_shot_id")}


# --- streams ---------------------------------------------------------------------------------

@pytest.fixture
def in_three_files(spark, tmp_path):
    def write(df, by):
        path = str(tmp_path / "in")
        n = df.count()
        rows = df.orderBy(by).collect()
        for i in range(3):
            spark.createDataFrame(rows[i * n // 3:(i + 1) * n // 3], df.schema).coalesce(1).write.mode("append").parquet(path)
        return path
    return write


@pytest.mark.parametrize("by", ["changed_at", "mixed"])
def test_move_audit_equals_batch_for_any_split(spark, table, in_three_files, by):
    """In order of time, and with moves of every time in every file; one analysis has most of the rows, some of them twice."""
    states = ["QUEUED", "RUNNING", "SUCCEEDED", "RUNNING", "QUEUED", "CANCELED"]
    rows = [(a, i, i, states[(a + i * (1 + a % 2)) % 6]) for a in range(4) for i in range(12)] + [(9, i % 50, i, states[i * i % 6]) for i in range(150)] + [(5, 3, 1, "QUEUED")] * 2
    log = table("analysis_id bigint, t bigint, ord bigint, state string", rows).withColumn("changed_at", F.timestamp_seconds((F.col("t") + 1) * 86_400 * 900)).drop("t")
    log = log.withColumn("mixed", F.xxhash64("changed_at", "ord", "analysis_id"))
    stream, close = ST.with_closing(ST.stream_table(spark, in_three_files(log.withColumn("ts", F.col("changed_at")), by), 1).select("ts", "analysis_id", "ord", "state"))
    out = ST.run_to_end(ST.move_audit(stream, f"{ST.span_seconds(log, 'changed_at')} seconds"), "append", close)
    want = J.illegal_moves(log).select("analysis_id", "ord", "from_state", "state", "from_terminal")
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(tuple(r) for r in want.collect()) and got


def test_hourly_rollup_equals_batch(spark, table, in_three_files):
    e = table("s bigint, series string, kind string, value bigint", [(i * 700, f"s{i % 3}", ("counter", "histogram")[i % 2], i % 11 - 3) for i in range(90)])
    e = e.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    path = in_three_files(e, "ts")
    rows, close = ST.with_closing(ST.stream_table(spark, path, 1))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = ST.run_to_end(ST.hourly_rollup(rows), "append", close)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    want = e.groupBy(F.window("ts", "1 hour").start.alias("hour"), "series").agg(*M.rollup_aggregates())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_late_rows_are_dropped_in_append_mode(spark, table, in_three_files):
    e = table("s bigint, ord int", [(0, 0), (100_000, 1), (200_000, 2), (300_000, 3), (60, 4), (400_000, 5)]).select(
        F.timestamp_seconds("s").alias("ts"), F.lit("a").alias("series"), F.lit("counter").alias("kind"), F.lit(1).cast("bigint").alias("value"), "ord")
    path = in_three_files(e, "ord")
    out = ST.run_to_end(ST.hourly_rollup(ST.stream_table(spark, path, 1)), "append")
    assert {r.hour.hour + 24 * (r.hour.day - 1): r.counter_total for r in out.collect()}[0] == 1


def test_first_copies_across_batches(spark, table, in_three_files):
    rows = table("n int, sha string", [(i, f"h{i % 7}") for i in range(60)]).withColumn("ts", F.timestamp_seconds("n"))
    out = ST.run_to_end(ST.first_copies(ST.stream_table(spark, in_three_files(rows, "n"), 1), "sha"), "append")
    assert sorted(r.sha for r in out.collect()) == [f"h{i}" for i in range(7)]


def test_first_copies_meet_decades_apart(spark, table, in_three_files):
    """The second copy of each comes in another micro-batch, up to 57 years away, and out of order."""
    rows = table("n bigint, sha string", [((1 + i * 37 % 60) * 30_000_000, f"h{i % 7}") for i in range(60)]).withColumn("ts", F.timestamp_seconds("n")).withColumn("place", F.xxhash64("n"))
    delay = f"{ST.span_seconds(rows)} seconds"
    out = ST.run_to_end(ST.first_copies(ST.stream_table(spark, in_three_files(rows, "place"), 1).drop("place"), "sha", delay), "append")
    assert sorted(r.sha for r in out.collect()) == [f"h{i}" for i in range(7)]
    assert ST.span_seconds(rows.where("n < 0")) == 1


def test_sliding_levels(spark, table, in_three_files):
    rows = table("n int, x double", [(i, float(i % 5)) for i in range(40)]).select(F.timestamp_millis(F.col("n") * 250).alias("ts"), F.lit(1).alias("clip_id"), "x", "n")
    stream, close = ST.with_closing(ST.stream_table(spark, in_three_files(rows, "n"), 1))
    out = ST.run_to_end(ST.sliding_levels(stream, "1 second", "500 milliseconds"), "append", close)
    got = {int(r.start.timestamp() * 1000): (r.rms, r.samples) for r in out.collect()}
    for start, (rms, n) in got.items():
        part = [i % 5 for i in range(40) if start <= i * 250 < start + 1000]
        assert n == len(part) and rms == pytest.approx((sum(p * p for p in part) / len(part)) ** 0.5)


# --- stored documents ---------------------------------------------------------------------------

def report_doc(**changes):
    doc = {"schema_version": "1.0", "analysis_id": "a", "video": {"has_audio": True}, "generated_at": "2024-01-01T00:00:00Z", "pipeline_version": "0.1.0",
           "configuration_hash": "0" * 64, "availability": {"audio": "COMPLETE"}, "summary": {"shot_count": 2},
           "shots": [{"shot": {"shot_id": f"s{i}", "index": i}} for i in range(2)], "timeline_artifact": None, "critique": None}
    doc.update(changes)
    return json.dumps(doc)


@pytest.mark.parametrize("doc,problem", [
    (report_doc(), None), (report_doc(path="/x"), "unknown_key"), (report_doc(schema_version="2.0"), "schema_version"),
    (report_doc(summary={"shot_count": 3}), "shot_count"), (report_doc(shots=[]), "shot_count"),
    (report_doc(shots=[{"shot": {"index": 0}}, {"shot": {"index": 2}}]), "index_contiguous"),
    (report_doc(video={"has_audio": False}), "audio_without_stream"), ("[]", "not_a_report"), ("{", "not_a_report")])
def test_report_verdicts(spark, table, doc, problem):
    r = R.report_verdicts(table("doc string", [(doc,)])).first()
    assert (r.problem, r.valid) == (problem, problem is None)


def test_document_schemas_parse(spark):
    for ddl in (schemas.REPORT, schemas.TIMELINE, schemas.SHOT_SET):
        assert schemas.keys(ddl)[:2] == ["schema_version", "analysis_id"] and len(schemas.struct(ddl).fields) == len(schemas.keys(ddl))


def test_shot_without_evidence_has_no_representative(spark, table):
    shots = table("clip_id int, shot_id string", [(1, "a"), (1, "b")])
    plan = table("clip_id int, shot_id string, ord int, sample_id string, purposes array<string>", [
        (1, "a", 0, "x", ["EVIDENCE"]), (1, "a", 4, "y", ["MOTION", "EVIDENCE"]), (1, "a", 9, "z", ["MOTION"]), (1, "b", 1, "w", ["MOTION"])])
    assert {r.shot_id: r.representative_sample_id for r in P.representatives(shots, plan).collect()} == {"a": "y", "b": None}


def test_outcomes_use_the_newest_attempt(spark, table):
    runs = table("analysis_id int, stage_name string, attempt int, state string", [
        (1, "sampling", 1, "SUCCEEDED"), (1, "report", 1, "SUCCEEDED"), (1, "report", 2, "FAILED_TERMINAL"),
        (2, "sampling", 1, "FAILED_RETRYABLE"), (2, "sampling", 2, "SUCCEEDED"), (2, "report", 1, "SUCCEEDED"),
        (3, "sampling", 1, "SUCCEEDED"), (3, "report", 1, "SUCCEEDED"), (4, "sampling", 1, "SUCCEEDED"), (4, "report", 1, "SUCCEEDED")])
    cols = "analysis_id int, chromatic string, spatial string, motion string, audio string, tension string, critic string, has_audio boolean, spatial_requested boolean"
    full = ["COMPLETE"] * 5 + ["NOT_REQUESTED"]
    avail = table(cols, [(1, *full, True, True), (2, *full, True, True), (3, "PARTIAL", *full[1:], True, True)])
    assert {r.analysis_id: r.outcome for r in J.outcomes(runs, avail).collect()} == {1: "FAILED", 2: "SUCCEEDED", 3: "PARTIAL", 4: "FAILED"}
    # Progress counts any finished attempt, so a later failure does not lower it.
    assert {r.analysis_id: round(r.progress, 9) for r in J.progress(runs).collect()}[1] == 0.9


def test_work_folder_is_the_one_the_session_names():
    class Conf:
        def get(self, name, default=None):
            return {"spark.checkpoint.dir": "/shared/scratch"}.get(name, default)

    assert work_folder(SimpleNamespace(conf=Conf())) == "/shared/scratch"


def test_work_folder_is_an_error_on_a_cluster_that_names_none():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    with pytest.raises(ValueError):
        work_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://somewhere:7077")))
    local = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))
    assert work_folder(local) == work_folder(local)


def test_corpus_folder_may_be_missing(tmp_path):
    """Without the corpus operators the other queries still register."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("filmgrain", "tools"):
        shutil.copytree(f"{root}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 140 and said[1:] == ["False", "True"]


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1])\nfrom filmgrain.session import local_session\nfrom filmgrain.operators import colour\ns = local_session(1)\n"
            "df = s.createDataFrame([(1, 10.0, 0.0, 0.0, 5)], 'shot_id int, lstar double, a_star double, b_star double, n bigint')\nprint('rows', colour.palette_centres(df).count())")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows 1" in said.stdout, said.stderr[-1500:]
