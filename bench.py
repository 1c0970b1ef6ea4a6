"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed completely with the ``noop`` sink (no collect to the driver); the
second of two runs is reported (the first warms the JVM and the file listing cache).
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from cohortspark.plans.queries import QUERIES  # noqa: E402
from cohortspark.plans.registry import ROOT_SETTING  # noqa: E402
from cohortspark.session import build_session, checkpoint_dir  # noqa: E402

HEADLINE = [
    "monthly_incidence",        # flagship: stays -> episodes -> month x sex x band
    "episodes",
    "keep_last",
    "code_rule",
    "attrition",
    "mentions",
    "stay_rollup",
    "incidence_grouping_sets",
    "completeness_probe",
    "its_by_group",
    "risk_ratio",
    "km_curve",
    "asof_nearest",
    "cohen_kappa",
    "stratified_sample",
    "score_join",
    "mention_score",
    "modality_mix",
    "history_by_date",
    "token_labels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times = {}
    for name in names:
        best = None
        for _ in range(2):
            # no stage table of an earlier query or run is reused
            spark.conf.set(ROOT_SETTING, f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}")
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = time.perf_counter() - t0
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
