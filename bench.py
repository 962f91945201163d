"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Like the published baseline this times queries over stored tables: the star is
derived from the raw tables first (timed as `star_derivation`), then each query
runs once to warm up and the median of the following runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
import uuid

from pyspark.sql import SparkSession

from perfattr.operators import attribution, contribution, linking, returns, risk
from perfattr.plans import inputs, marts
from perfattr.plans.queries import REGISTRY
from perfattr.sources import testdata
from perfattr.sources.star import write_bucketed_positions
from perfattr.sources.storage import shared_folder

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
P = inputs.PERIODS_PER_YEAR


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # One file per bucket, so a bucketed scan may be trusted to be sorted.
        .config("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(build) -> float:
    """Seconds to build and run a query; building may store small tables."""
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = session()
    started = time.perf_counter()
    star = testdata.load(spark, SF_DIR).star
    seconds = {"star_derivation": time.perf_counter() - started}
    rows = star.positions_daily.count()

    table = f"positions_{uuid.uuid4().hex}"
    started = time.perf_counter()
    write_bucketed_positions(star.positions_daily, table, int(CPUS), f"{shared_folder(spark)}/{table}")
    seconds["bucketed_write"] = time.perf_counter() - started
    bucketed = star.with_positions(spark.table(table))

    def linked(s):
        return linking.linked_attribution(attribution.held_sectors(s, within_lifespan=True))

    def risk_summary(s):
        days = returns.day_returns(attribution.held_sectors(s, within_lifespan=True))
        return risk.risk_summary(days, periods_per_year=P)

    headline = {
        "attribution_period": lambda: attribution.attribution_over_period(star),
        "attribution_period_bucketed": lambda: attribution.attribution_over_period(bucketed),
        "attribution_linked": lambda: linked(star),
        "contribution": lambda: contribution.contributions(star),
        "risk_summary": lambda: risk_summary(star),
        "performance_summary": lambda: marts.performance_summary(star, periods_per_year=P),
    }
    for name, build in headline.items():
        run(build)
        seconds[name] = statistics.median(run(build) for _ in range(RUNS))
    for name in ("model_positions_monthly", "model_flow_check"):
        seconds[name] = run(lambda name=name: REGISTRY[name](spark, SF_DIR))

    best = seconds["attribution_period"]  # over plain Parquet; the bucketed layout stands beside it
    print(
        json.dumps(
            {
                "metric": "full-history sector attribution of all portfolios, median",
                "value": round(best, 3),
                "unit": "sec",
                "queries": {name: round(s, 3) for name, s in seconds.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "position_rows": rows,
                "rows_per_sec": round(rows / best),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
