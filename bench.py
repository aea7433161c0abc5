"""Time the headline reports and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. The written stages
(transactions with places, bounds, master, shared slice counts and percentiles) are timed on
their own, once in a cold session and once in a warm one. Every report is then timed from those
stages to its rows. What a report writes for itself is written by its first run and kept;
that run is timed as ``first_`` and counted, the best of three more stands under the report's own
name. The headline is the warm stages, the first runs and, of reports that write nothing, the best
runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfmetrics import REPORTS, Pipeline  # noqa: E402
from shelfmetrics.plans.workspace import Workspace  # noqa: E402
from shelfmetrics.session import build_session  # noqa: E402
from shelfmetrics.sources.orders_star import STAR_SETTINGS, star_sources  # noqa: E402

ROW_LEVEL = {
    "clean_product_metadata",
    "clean_consumer_insights",
    "clean_geography",
    "clean_competitor_pricing",
    "dedup_transactions",
    "flag_transactions",
    "master_sales",
    "core_clean_slice",
    "geo_enriched_slice",
    "persona_slice",
    "returns_slice",
    "bulk_slice",
}
PROFILES = (
    "demand_by_bucket",
    "income_sensitivity",
    "channel_tolerance",
    "category_tolerance",
    "age_sensitivity",
    "claim_premium_power",
    "claim_category_matrix",
    "state_pricing",
    "city_tier_pricing",
    "occasion_power",
    "state_occasion_matrix",
    "tier_occasion_mix",
    "sku_playbook",
)
STAGES = {
    "located": lambda p: p.located,
    "bounds": lambda p: p.bounds,
    "master": lambda p: p.master,
    "slices": lambda p: p.profiler.shared[0].table,
    "ranks": lambda p: p.profiler.shared[0].ranks,
}
REPEATS = 3


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def run(name: str, pipeline: Pipeline) -> None:
    rows = REPORTS[name](pipeline)
    if name in ROW_LEVEL:
        rows.write.format("noop").mode("overwrite").save()
    else:
        rows.collect()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    scratch = tempfile.mkdtemp(prefix="shelfmetrics-bench-")

    def fresh() -> Pipeline:
        return Pipeline(star_sources(spark, folder), Workspace(spark, scratch), STAR_SETTINGS)

    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for suffix in ("_cold", ""):
        pipeline = fresh()
        for stage in STAGES:
            seconds[f"build_{stage}{suffix}"] = timed(lambda: STAGES[stage](pipeline))
    for name in PROFILES:
        seconds[f"first_{name}"] = timed(lambda: run(name, pipeline))
    for name in REPORTS:
        seconds[name] = min(timed(lambda: run(name, pipeline)) for _ in range(REPEATS))

    counted = [f"first_{name}" if name in PROFILES else name for name in REPORTS]
    headline = sum(seconds[name] for name in (*counted, *(f"build_{s}" for s in STAGES)))
    print(
        json.dumps(
            {
                "metric": "all stages (warm) plus all reports, first runs where they write",
                "value": round(headline, 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
