"""Headline queries on local cores, better of two runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatprep.plans import catalog
from chatprep.session import local_session

HEADLINE = [
    "draft_vocabulary_coverage",
    "token_frequency",
    "valid_turns",
    "render_qwen",
    "mask_general_prefix",
    "masked_samples",
    "step_views",
    "pad_batches",
    "block_anchors",
    "split_exact",
    "strided_shards",
    "lenient_scan",
    "from_value",
    "boxed_integers",
    "accuracy_labelled_integers",
    "run_metrics",
    "speedup_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session("bench", cpus)
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run also loads and compiles classes
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
