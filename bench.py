"""Time the headline queries and print one JSON line.

Every query runs in full into Spark's ``noop`` sink, so all rows are computed and none
come back to the driver. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from filmgrain.plans.catalogue import QUERIES
from filmgrain.session import local_session

HEADLINE = [
    "ag01_editing_summary", "wn01_score_changes", "wn04_merge_short_shots", "wn07_sampling_plan", "jn02_point_to_shot",
    "jn03_cut_activity", "jn04_motion_at_hop", "jn06_frame_at_or_after", "wn15_timeline", "wn16_peaks", "ag05_flow_statistics",
    "ag06_shot_motion", "wn11_direction_consistency", "jn08_outside_boxes", "wn08_letterbox_bounds", "ag02_lightness",
    "shot_palette", "shot_colour_values", "wn21_track_subjects", "ag09_spatial_values", "ag12_window_levels", "ag13_spectral_flux", "jn01_assemble_report",
    "ag19_critic_facts", "ag22_status_view", "ag24_metrics_rollup", "jn14_illegal_moves", "src01_probe_facts", "src03_dedupe_ingest",
    "prj31_command_verdict", "prj32_audit_critique",
]
CLIP_MS = 259_200


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    # One pass over a tiny query so JVM start-up is not charged to the first one.
    QUERIES["prj34_time_range"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    out = {"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder).removeprefix("sf")}
    if "wn15_timeline" in times:
        clips = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct().count()
        out["timeline_clips_per_second"] = round(clips / times["wn15_timeline"], 1)
        out["timeline_realtime_factor_milli"] = round(times["wn15_timeline"] * 1e6 / (clips * CLIP_MS), 3)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
