"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names, default the
headline list, "all" for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paperloom import workload  # noqa: E402
from paperloom.plans.session import build_session  # noqa: E402

HEADLINE = (
    "session_results",
    "score_by_part",
    "wrong_answers",
    "session_outcomes",
    "question_with_origin",
    "playlist",
    "random_question",
    "topic_expansion",
    "reply_claims",
    "answer_insert",
    "page_numbers",
    "reconcile_manifest",
    "census_years",
    "validate_years",
    "stranded_tasks",
    "dataset_split",
    "merge_sheets",
    "place_questions",
    "book_rollup",
    "stack_layout",
    "registration_state",
    "question_upsert",
    "delete_plan",
    "violations",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    every = workload.all_queries()
    names = list(every) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = build_session("paperloom-bench", master=f"local[{cpus}]", partitions=max(int(cpus), 4))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()
    every["session_results"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    os_bean = spark._jvm.java.lang.management.ManagementFactory.getOperatingSystemMXBean()
    # The same work whatever the tables: tells a slower machine from a slower query.
    start = time.perf_counter()
    spark.range(100_000_000).selectExpr("sum(hash(id) % 1000)").collect()
    calibration = round(time.perf_counter() - start, 3)
    timed, cpu = {}, {}
    for name in names:
        start, before = time.perf_counter(), os_bean.getProcessCpuTime()
        every[name](spark, folder).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - start, 3)
        cpu[name] = round((os_bean.getProcessCpuTime() - before) / 1e9, 2)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "jvm_cpu_sec": cpu, "calibration_sec": calibration, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
