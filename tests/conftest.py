from __future__ import annotations

import os
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from perfattr.sources import schemas  # noqa: E402
from perfattr.sources.star import Star  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text: str) -> date:
    return date.fromisoformat(text)


def weekdays(start: date, n: int) -> list[date]:
    """`start` and the n weekdays after it."""
    days = [start]
    while len(days) <= n:
        nxt = days[-1] + timedelta(days=1)
        while nxt.weekday() >= 5:
            nxt += timedelta(days=1)
        days.append(nxt)
    return days


def make_star(spark, **rows) -> Star:
    return Star(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in schemas.STAR.items()})


GOLDEN_POSITIONS = {
    "2024-01-02": [(100, 10.00), (50, 20.00), (200, 5.00), (25, 40.00)],
    "2024-01-03": [(100, 10.50), (50, 19.00), (200, 5.10), (25, 40.80)],
    "2024-01-04": [(100, 11.00), (50, 19.00), (400, 5.25), (25, 40.00)],
    "2024-01-05": [(100, 11.11), (50, 19.38), (400, 5.20), (25, 41.00)],
}


@pytest.fixture(scope="session")
def golden(spark) -> Star:
    """The hand-worked example: two sectors, four securities, one deposit."""
    third = day("2024-01-03")
    return make_star(
        spark,
        securities=[
            (1, "AAA", "Tech", "EQUITY"),
            (2, "BBB", "Tech", "EQUITY"),
            (3, "CCC", "Energy", "EQUITY"),
            (4, "DDD", "Energy", "EQUITY"),
        ],
        portfolios=[(1, "Golden", day("2024-01-02"), "USD")],
        positions_daily=[
            (day(d), 1, i + 1, float(q), p, q * p)
            for d, held in GOLDEN_POSITIONS.items()
            for i, (q, p) in enumerate(held)
        ],
        transactions=[(day("2024-01-04"), 1, None, "CASHFLOW", 0.0, 1020.0)],
        benchmark_weights=[(third, i + 1, w) for i, w in enumerate((0.45, 0.15, 0.25, 0.15))],
        benchmark_returns=[(third, i + 1, r) for i, r in enumerate((0.05, -0.05, 0.02, 0.02))],
    )


@pytest.fixture(scope="session")
def universe(spark) -> Star:
    """Six securities with full history over 60 weekdays, one portfolio, invented returns."""
    days = weekdays(day("2024-01-02"), 60)
    sectors = ["Energy", "Energy", "Information Technology", "Information Technology", "Utilities", "Utilities"]
    ids = range(1, 7)
    rets = {(t, i): 0.03 * (((7 * i + 3 * t) % 11) / 10 - 0.45) for t in range(1, 61) for i in ids}
    prices = {(0, i): 40.0 + 5 * i for i in ids}
    for t in range(1, 61):
        for i in ids:
            prices[t, i] = prices[t - 1, i] * (1 + rets[t, i])
    return make_star(
        spark,
        securities=[(i, f"SEC{i:03d}", sectors[i - 1], "EQUITY") for i in ids],
        portfolios=[(1, "Portfolio 001", days[0], "USD")],
        positions_daily=[
            (d, 1, i, 10.0 * i, prices[t, i], 10.0 * i * prices[t, i]) for t, d in enumerate(days) for i in ids
        ],
        benchmark_weights=[(d, i, w / 21) for d in days[1:] for i, w in zip(ids, (1, 2, 3, 4, 5, 6))],
        benchmark_returns=[(d, i, rets[t, i]) for t, d in enumerate(days) if t for i in ids],
    )
