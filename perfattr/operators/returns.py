"""Valuations and returns of portfolios and of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.functions import measures as m
from perfattr.operators.attribution import Held, market_calendar, within
from perfattr.operators.common import Day, Portfolios, as_date, in_range, over_time, pick_portfolios
from perfattr.operators.series import by_calendar
from perfattr.sources.star import Star


def valuations(star: Star, start: Day = None, end: Day = None, portfolios: Portfolios = None) -> DataFrame:
    """(portfolio_id, date, begin_date, mv_begin, mv_end, cf) for every day with a prior close."""
    positions = pick_portfolios(in_range(star.positions_daily, end=end), portfolios)
    values = positions.groupBy("portfolio_id", "date").agg(F.sum("market_value").alias("mv_end"))
    flows = (
        pick_portfolios(in_range(star.transactions, end=end), portfolios)
        .where(F.col("type") == "CASHFLOW")
        .groupBy("portfolio_id", "date")
        .agg(F.sum("amount").alias("cf"))
    )
    series = over_time("portfolio_id")
    days = values.join(flows, ["portfolio_id", "date"], "left").select(
        "portfolio_id",
        "date",
        F.lag("date").over(series).alias("begin_date"),
        F.lag("mv_end").over(series).alias("mv_begin"),
        "mv_end",
        F.coalesce("cf", F.lit(0.0)).alias("cf"),
    )
    return in_range(days.where(F.col("mv_begin").isNotNull()), start)


def sub_period_returns(valued: DataFrame, strict: bool = False) -> DataFrame:
    """Valuations with the day's market-value return `rp`."""
    rp = m.sub_period_return(F.col("mv_begin"), F.col("mv_end"), F.col("cf"), strict)
    return valued.withColumn("rp", rp)


def benchmark_days(star: Star, start: Day = None, end: Day = None) -> DataFrame:
    """(date, rb): weight-normalised benchmark return per day."""
    return (
        in_range(star.benchmark_weights, start, end)
        .join(in_range(star.benchmark_returns, start, end), ["date", "security_id"])
        .groupBy("date")
        .agg(m.weighted_mean(F.col("ret"), F.col("weight")).alias("rb"))
    )


def held_days(held: Held, with_sectors: bool = False) -> DataFrame:
    """(portfolio_id, idx, date, rp, rb) for every benchmark date in a portfolio's span, out of its held sectors.

    `idx` is the date's place in the benchmark's calendar.  `with_sectors` adds the day's held rows as a
    list, so they need not be computed again.
    """
    figures = [F.sum(F.col("wp") * F.col("rp")).alias("own")]
    if with_sectors:
        entry = F.struct("sector", "wp", "own", "selection", "interaction")
        figures.append(F.collect_list(entry).alias("sectors"))
    own = held.rows.groupBy("portfolio_id", "date").agg(*figures)
    own = own.select("portfolio_id", "date", F.struct(*own.columns[2:]).alias("own"))
    days = by_calendar(held.spans, market_calendar(held.market), own).where(within(F.col("day.date")))
    # A day without holdings returns 0, as cash would.
    rp = F.coalesce("own.own", F.when(F.col("day.rb").isNotNull(), 0.0))
    return days.select("portfolio_id", "idx", "day.date", rp.alias("rp"), "day.rb", *(["own.sectors"] if with_sectors else []))


def day_returns(held: Held) -> DataFrame:
    """(portfolio_id, date, rp, rb): weight-based returns of every day."""
    return held_days(held).drop("idx")


def market_value_days(
    star: Star, start: Day = None, end: Day = None, portfolios: Portfolios = None
) -> DataFrame:
    """Sub-period returns next to the benchmark return of the same date, NULL where it has none."""
    valued = sub_period_returns(valuations(star, start, end, portfolios))
    return valued.join(benchmark_days(star, start, end), "date", "left")


def twr(valued: DataFrame, period_end: Day = None) -> DataFrame:
    """Linked and annualised return per portfolio.

    The measurement period runs from the first prior close to `period_end`,
    or to the portfolio's last valuation if none is given.  A day without a
    defined return leaves no linked return; `bad_days` counts them.
    """
    last = as_date(period_end) if period_end is not None else F.max("date")
    return (
        sub_period_returns(valued)
        .groupBy("portfolio_id")
        .agg(
            F.min("date").alias("first_date"),
            F.count("*").alias("n_days"),
            F.datediff(last, F.min("begin_date")).alias("calendar_days"),
            F.count_if(F.col("rp").isNull()).alias("bad_days"),
            m.linked(F.col("rp")).alias("twr"),
        )
        .withColumn("twr_annualised", m.annualised(F.col("twr"), F.col("calendar_days")))
    )


def active_returns(days: DataFrame) -> DataFrame:
    """Linked portfolio and benchmark return per portfolio and their difference and ratio.

    Each series is linked over its own days.
    """
    return (
        days.groupBy("portfolio_id")
        .agg(m.linked(F.col("rp")).alias("twr"), m.linked_present(F.col("rb")).alias("bench_twr"))
        .withColumn("active_return", F.col("twr") - F.col("bench_twr"))
        .withColumn("active_geometric", m.geometric_active(F.col("twr"), F.col("bench_twr")))
    )
