"""Times the headline queries and prints one JSON line.

Each query is built and run into the no-op sink, so every column is computed.
``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores.  Chunk features run
on the 60-second grid here (the SQL checks use 600 seconds).
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks import queries as q
from checks.registry import QUERIES
from checks.views import Inputs
from pulseweave.operators import chunks
from pulseweave.session import configure, local_session

HEADLINE = (
    "wave_meta", "cohort_overlap", "weight_from_charts", "cohort", "cohort_labs",
    "drip_intervals", "push_intervals", "cohort_inputs", "cohort_inputs_v3",
    "icd_secondary", "cohort_codes", "signal_coverage", "align", "rechunk",
    "chunk_dataset", "run_summary",
)


def features_60s(spark, directory):
    i = Inputs(configure(spark), directory)
    return chunks.chunk_features(*q.feature_inputs(i), 60.0)


def infusions_60s(spark, directory):
    i = Inputs(configure(spark), directory)
    return chunks.chunk_infusions(*q.feature_inputs(i)[:2], 60.0)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: QUERIES[name] for name in HEADLINE}
    todo["chunk_infusions_60s"] = infusions_60s
    todo["chunk_features_60s"] = features_60s
    wanted = sys.argv[1:]
    timings = {}
    QUERIES["signal_map"](spark, directory).count()  # starts the workers
    for name, build in todo.items():
        if wanted and name not in wanted:
            continue
        start = time.perf_counter()
        build(spark, directory).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
