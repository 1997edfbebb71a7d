"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is run to completion with a ``noop`` write (the whole result is
computed, nothing is collected to the driver); the time is the best of
``BENCH_REPEAT`` runs after one warm-up run of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from claimtext.plans import catalog  # noqa: E402
from claimtext.session import get_spark  # noqa: E402

HEADLINE = [
    "extract_tuples",
    "extract_member_side_counts",
    "extract_default_lexicon",
    "process_string_nostem",
    "vocabulary_nostem",
    "vocabulary_stem",
    "stem_dictionary",
    "vocabulary_filter",
    "tfidf_weights",
    "topk_similar",
    "topk_labels",
    "retrieve_from_tuples",
    "retrieve_repeated_queries",
    "hierarchy_levels",
    "hierarchy_codes",
    "hierarchy_full",
    "html_container_text",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    n_cpus = os.cpu_count() or 8 if cpus.strip() == "*" else int(cpus)
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = sys.argv[1:] or HEADLINE
    # the driver's tables are single-row-group files: spread text tables over the cores
    spark = get_spark(cores=cpus,
                      shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(2 * n_cpus))),
                      scan_partitions=int(os.environ.get("BENCH_SCAN_PARTITIONS", str(2 * n_cpus))))
    # warm-up: JIT, Python workers, parquet footers
    catalog.QUERIES["fold_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
