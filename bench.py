"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and once for the clock. The result is written to the
no-op sink, so that every column is computed.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "speaker_stats", "build_turns", "filler_top3", "echo_window", "echo_drop", "asof_speaker", "split_segments",
    "tidy_windows", "dedup_exact", "dedup_items", "search_meetings", "page_lookahead", "upsert_meetings",
    "calendar_current", "busy_sessions", "job_transitions", "session_activity", "waveform_peaks", "silence_filter",
    "voice_centroids", "diarize"]


def main():
    from pyspark.sql import SparkSession

    from parley.registry import load
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("parley-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = load()[0], {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
