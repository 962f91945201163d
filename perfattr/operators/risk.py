"""Risk figures and curves of daily returns (keys, date, rp, rb).

Windows run over one portfolio's days, so they are as long as the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.functions import measures as m
from perfattr.operators.common import over_time, running

PORTFOLIO = ("portfolio_id",)
ROLLING_DAYS = 63


def curves(days: DataFrame, keys: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Cumulative portfolio, benchmark and active return up to each day."""
    so_far = running(*keys)
    return (
        days.withColumn("cum_rp", m.cumulative(F.col("rp"), so_far))
        .withColumn("cum_rb", m.cumulative(F.col("rb"), so_far))
        .withColumn("cum_active", F.col("cum_rp") - F.col("cum_rb"))
    )


def drawdowns(days: DataFrame, keys: Sequence[str] = PORTFOLIO) -> DataFrame:
    """Decline from the running peak of the portfolio's growth curve."""
    so_far = running(*keys)
    return (
        days.withColumn("growth", m.cumulative(F.col("rp"), so_far) + 1)
        .withColumn("drawdown", m.drawdown(F.col("growth"), so_far))
        .drop("growth")
    )


def rolling_tracking_error(
    days: DataFrame,
    keys: Sequence[str] = PORTFOLIO,
    window: int = ROLLING_DAYS,
    periods_per_year: int = m.PERIODS_PER_YEAR,
) -> DataFrame:
    """Tracking error of the last `window` days, or of all days if there are fewer."""
    frame = over_time(*keys).rowsBetween(1 - window, W.currentRow)
    width = F.least(F.lit(window), F.count("*").over(W.partitionBy(*keys)))
    active = F.col("rp") - F.col("rb")
    full = (F.row_number().over(over_time(*keys)) >= width) & (width >= 2)
    full = full & (F.count(active).over(frame) == F.count(F.lit(1)).over(frame))
    spread = F.stddev_samp(active).over(frame)
    return days.withColumn("rolling_te", F.when(full, spread * F.sqrt(F.lit(float(periods_per_year)))))


def risk_summary(
    days: DataFrame, keys: Sequence[str] = PORTFOLIO, periods_per_year: int = m.PERIODS_PER_YEAR
) -> DataFrame:
    """Linked returns, tracking error, information ratio and maximum drawdown per key.

    All of the portfolio's figures are NULL if one of its returns is undefined.
    """
    active = F.col("rp") - F.col("rb")
    whole = m.complete(F.col("rp"))
    return (
        drawdowns(days, keys)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_days"),
            m.linked(F.col("rp")).alias("twr"),
            m.linked(F.col("rb")).alias("bench_twr"),
            F.when(whole, m.tracking_error(active, periods_per_year)).alias("te"),
            F.when(whole, m.information_ratio(active, periods_per_year)).alias("ir"),
            F.when(whole, F.least(F.min("drawdown"), F.lit(0.0))).alias("max_drawdown"),
        )
    )
