"""Trading calendars.  A calendar has one row per date, so its windows are not partitioned."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PERIODS = ("MTD", "QTD", "YTD", "1Y", "SI")
SAMPLE_EVERY = 5


def trading_calendar(dated: DataFrame) -> DataFrame:
    """(date, prev_date, idx) of the distinct dates of any table."""
    order = W.orderBy("date")
    return dated.select("date").distinct().select(
        "date",
        F.lag("date").over(order).alias("prev_date"),
        (F.row_number().over(order) - 1).alias("idx"),
    )


def weekday_calendar(spark: SparkSession, start: date, days: int) -> DataFrame:
    """`start` and the `days` weekdays that follow it."""
    span = (days // 5 + 2) * 7
    first = F.lit(start).cast("date")
    weekdays = (
        spark.range(1)
        .select(F.explode(F.sequence(first, F.date_add(first, span))).alias("date"))
        .where((F.weekday("date") < 5) | (F.col("date") == first))
    )
    return trading_calendar(weekdays).where(F.col("idx") <= days)


def rebalance_flags(calendar: DataFrame) -> DataFrame:
    """Calendar with flags on the first trading day of a month and of a quarter."""
    this, prev = F.col("date"), F.col("prev_date")
    new_month = F.coalesce(F.trunc(this, "month") != F.trunc(prev, "month"), F.lit(False))
    return calendar.withColumn("month_start", new_month).withColumn(
        "quarter_start", new_month & ((F.month(this) - 1) % 3 == 0)
    )


def sampled(calendar: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """Every n-th date with its running number `week`."""
    return calendar.where(F.col("idx") % every == 0).withColumn(
        "week", F.floor(F.col("idx") / every).cast("int")
    )


def date_array(dated: DataFrame) -> DataFrame:
    """One row holding the sorted distinct dates of a table."""
    return dated.agg(F.array_sort(F.collect_set("date")).alias("dates"))


def _period_target(period: str, last: Column) -> Column | None:
    if period == "MTD":
        return F.trunc(last, "month")
    if period == "QTD":
        return F.trunc(last, "quarter")
    if period == "YTD":
        return F.trunc(last, "year")
    if period == "1Y":
        # The day after 28 February when the year before has no such day.
        leap_day = (F.month(last) == 2) & (F.dayofmonth(last) == 29)
        return F.when(leap_day, F.date_add(F.add_months(last, -12), 1)).otherwise(F.add_months(last, -12))
    return None


def period_starts(dated: DataFrame) -> DataFrame:
    """(period, start_date): first trading day of each report period before the last date."""
    last, first = F.element_at("dates", -1), F.element_at("dates", 1)

    def start(period: str) -> Column:
        target = _period_target(period, last)
        if target is None:
            return first
        return F.coalesce(F.array_min(F.filter("dates", lambda d: d >= target)), first)

    rows = [F.struct(F.lit(p).alias("period"), start(p).alias("start_date")) for p in PERIODS]
    return date_array(dated).where(F.size("dates") > 0).select(F.inline(F.array(*rows)))
