"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
The item and sheet tables are stored outside the clock, one small query starts the session's workers,
then every query runs BENCH_RUNS times (default 1) and the median counts. Results go to the noop sink, so all rows are computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "sheet_verdict", "recount_verdict", "progress_summary", "review_stats", "wrong_items", "unjudged_by_exam", "overturn_rate",
    "number_sections", "drift_warnings", "merge_pages", "apply_reference", "build_reference", "run_diff_items", "trial_summary",
    "teacher_mark_compare", "phase_gate", "usage_by_staff", "usage_by_hour", "token_stage_split", "call_cost", "cost_levers",
    "exact_title_match", "title_similarity_join", "prompt_overlap_join", "match_answer_key", "ocr_report", "replace_children",
    "dq_constraint_violations", "tokens_to_lines", "token_diff_answers", "word_count",
)


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    from markloom.checks import all_queries
    from markloom.checks.views import store
    from markloom.session import build_session

    spark = build_session("markloom-bench", f"local[{cpus}]", cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    names = wanted.split(",") if wanted else HEADLINE

    def once(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    store(spark, sf_dir, ("items", "sheets", "trials", "trial_runs", "usage", "calls", "exams", "exam_items"))
    once("usage_by_hour")
    for name in names:
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
