"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (``all`` or comma-separated names) choose the run.
"""

from __future__ import annotations

import json
import os
import time

from trialspark.plans import catalog
from trialspark.session import build_session

HEADLINE = [
    "exclusion_reasons", "accuracy_table", "union_sources", "normalise_scores", "rt_box",
    "rt_rank", "attach_fscore", "fscore_long", "fscore_pre", "filler_accuracy", "linear_test",
    "training_structure_test", "accuracy_bars", "beta_interval", "session_accuracy",
    "break_times", "trials_wide", "training_gate", "first_seen_id", "run_ids", "schedule",
    "assign_words", "nested_contrasts", "posterior_summary", "pmcmc", "sentence_case",
    "split_template", "semi_seen_by_people", "synth_items", "fit_map_logit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("filler_accuracy")  # start-up and file caches are not part of any query
    times = {name: run(name) for name in names}
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
