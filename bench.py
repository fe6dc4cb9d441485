"""Timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``refresh_*`` is the pipeline by layer, ``rerun`` a second load on top of it, ``rerun_one_month_changed`` a third in
which appointments of one month differ, ``chart_*``
the dashboard on the published marts, and the rest are registered queries planned from the
source tables to their result.  Rows go to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from carelake.config import RefreshConfig
from carelake.plans.dashboard import charts
from carelake.plans.refresh import Refresh
from carelake.session import local_session
from verification.oracle import AS_OF
from verification.queries import QUERIES, Layers

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
CHART_REPEATS = 5

HEADLINE = (
    "t2_appointment",
    "t7_user",
    "m6_dim_patient",
    "m10_fact",
    "k2_mart_patients",
    "k4_mart_patient_disability",
    "k5_mart_professionals",
    "k6_mart_professional_appointments",
    "q9_completed_vs_cancelled",
    "q12_price_over_time",
    "v1_duplicate_fingerprints",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run, repeats: int) -> float:
    """Median after one unmeasured warm-up."""
    run()
    seconds = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return statistics.median(seconds)


def main() -> None:
    spark = local_session(CPUS)
    times: dict[str, float] = {}

    for name in HEADLINE:
        times[name] = timed(lambda n=name: drain(QUERIES[n](spark, SF_DIR)), REPEATS)

    layers = Layers(spark, SF_DIR)
    cfg = RefreshConfig(root=tempfile.mkdtemp(prefix="carelake-bench-"), as_of=AS_OF)
    first = Refresh(spark, cfg, load=layers.source)
    first.run()
    times |= {f"refresh_{layer}": seconds for layer, seconds in first.seconds.items()}
    rows = sum(r.table_rows for r in first.results if r.layer == "raw")

    second = Refresh(spark, cfg, load=layers.source)
    second.run()
    times["rerun"] = sum(second.seconds.values())

    def one_month_changed(entity: str):
        df = layers.source(entity)
        if entity != "appointment":
            return df
        return df.withColumn("status", F.when(F.col("date").contains("1996-03"), "completed").otherwise(F.col("status")))

    third = Refresh(spark, cfg, load=one_month_changed)
    third.run()
    times["rerun_one_month_changed"] = sum(third.seconds.values())

    # Planned anew each time: a DataFrame that has run keeps its shuffles.
    for name in charts(second.marts):
        times[f"chart_{name}"] = timed(lambda n=name: charts(second.marts)[n].collect(), CHART_REPEATS)

    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": os.path.basename(SF_DIR).removeprefix("sf"),
                "raw_rows": rows,
                "raw_rows_per_second": round(rows / sum(first.seconds.values())),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
