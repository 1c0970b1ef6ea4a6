"""Time every registered query at a scale factor (second of two runs) and print a markdown table."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortspark.plans.queries import QUERIES  # noqa: E402
from cohortspark.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(master="local[8]", shuffle_partitions=16)
    print("| query | seconds | rows out |")
    print("| --- | --- | --- |")
    for name, fn in QUERIES.items():
        secs = None
        for _ in range(2):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            secs = time.perf_counter() - t0
        rows = fn(spark, sf_dir).count()
        print(f"| {name} | {secs:.2f} | {rows} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
