"""Result tables a report or dashboard reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.functions import measures as m
from perfattr.operators import attribution, calendar, contribution, linking, models, quality, returns, risk
from perfattr.operators.common import Day, Portfolios, as_date
from perfattr.sources import commits
from perfattr.sources.star import Star, portfolio_names
from perfattr.sources.storage import remove, stored


def performance_summary(
    star: Star,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
    periods_per_year: int = m.PERIODS_PER_YEAR,
) -> DataFrame:
    """Returns, active return and risk per portfolio, out of market values.

    Each series is linked over its own days; tracking error and information ratio
    take the days that both have.  Annualisation counts the days to `end` (or the
    last date with returns).
    """
    days = returns.market_value_days(star, start, end, portfolios)
    if end is not None:
        period_end = as_date(end)
    else:
        period_end = star.benchmark_returns.agg(F.max("date").alias("last_date")).scalar()
    active = F.col("rp") - F.col("rb")
    whole = m.complete(F.col("rp"))
    summary = (
        risk.drawdowns(days)
        .groupBy("portfolio_id")
        .agg(
            F.min("date").alias("from_date"),
            F.min("begin_date").alias("begin_date"),
            F.count("*").alias("n_days"),
            m.linked(F.col("rp")).alias("twr"),
            m.linked_present(F.col("rb")).alias("bench_twr"),
            F.when(whole, m.tracking_error(active, periods_per_year)).alias("te"),
            F.when(whole, m.information_ratio(active, periods_per_year)).alias("ir"),
            F.when(whole, F.least(F.min("drawdown"), F.lit(0.0))).alias("max_drawdown"),
        )
        .withColumn("calendar_days", F.datediff(period_end, F.col("begin_date")))
        .withColumn("twr_annualised", m.annualised(F.col("twr"), F.col("calendar_days")))
        .withColumn("bench_annualised", m.annualised(F.col("bench_twr"), F.col("calendar_days")))
        .withColumn("active_return", F.col("twr") - F.col("bench_twr"))
        .withColumn("active_geometric", m.geometric_active(F.col("twr"), F.col("bench_twr")))
        .drop("begin_date")
    )
    return portfolio_names(star, summary)


def lifespan_days(star: Star) -> DataFrame:
    """Number of attribution days and their range per portfolio."""
    spans = attribution.lifespans(star.positions_daily)
    days = calendar.date_array(star.benchmark_weights).scalar()
    inside = F.filter(
        "dates", lambda d: (d > F.col("first_position")) & (d <= F.col("last_position"))
    )
    return spans.withColumn("dates", days).withColumn("dates", inside).select(
        "portfolio_id",
        "first_position",
        "last_position",
        F.array_min("dates").alias("first_day"),
        F.array_max("dates").alias("last_day"),
        F.size("dates").alias("n_days"),
    )


def market_context(star: Star) -> DataFrame:
    """Benchmark return per date with its index and weekly sampling flag."""
    dates = calendar.trading_calendar(star.benchmark_weights)
    return dates.join(returns.benchmark_days(star), "date").select(
        "date", "idx", (F.col("idx") % calendar.SAMPLE_EVERY == 0).alias("is_week"), "rb"
    )


def sector_labels(star: Star) -> DataFrame:
    """Sectors of the benchmark with their short labels."""
    sectors = attribution.benchmark_sectors(star).select("sector").distinct()
    return sectors.withColumn("label", m.short_sector(F.col("sector")))


def period_kpis(days: DataFrame, dated: DataFrame, periods_per_year: int = m.PERIODS_PER_YEAR) -> DataFrame:
    """Risk summary per portfolio and report period.

    Periods are anchored to the last date of `dated`; each keeps at least the
    last two days of a portfolio.
    """
    starts = (
        calendar.period_starts(dated)
        .agg(F.collect_list(F.struct("period", "start_date")).alias("periods"))
        .scalar()
    )
    from_end = F.row_number().over(W.partitionBy("portfolio_id").orderBy(F.desc("date")))
    members = F.filter(
        "periods", lambda p: (F.col("date") >= p["start_date"]) | (F.col("from_end") <= 2)
    )
    spread = (
        days.withColumn("from_end", from_end)
        .withColumn("periods", starts)
        .select("portfolio_id", "date", "rp", "rb", F.inline(members))
    )
    return risk.risk_summary(spread, ["portfolio_id", "period"], periods_per_year).withColumn(
        "active_return", F.col("twr") - F.col("bench_twr")
    )


def waterfall(linked: DataFrame) -> DataFrame:
    """Steps in basis points: sectors by total effect, then a closing bar from zero."""
    best_first = W.partitionBy("portfolio_id").orderBy(F.desc("total"), "sector")
    up_to = best_first.rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = linked.select(
        "portfolio_id",
        F.row_number().over(best_first).alias("step"),
        F.col("sector").alias("label"),
        F.sum("total").over(up_to).alias("stop"),
        "total",
    ).select(
        "portfolio_id",
        "step",
        "label",
        m.basis_points(F.col("stop") - F.col("total")).alias("bar_start"),
        m.basis_points(F.col("stop")).alias("bar_end"),
        m.basis_points(F.col("total")).alias("total_bps"),
    )
    closing = linked.groupBy("portfolio_id").agg(
        (F.count("*") + 1).cast("int").alias("step"),
        F.lit("Active return").alias("label"),
        F.lit(0.0).alias("bar_start"),
        m.basis_points(F.sum("total")).alias("bar_end"),
        m.basis_points(F.sum("total")).alias("total_bps"),
    )
    return steps.unionByName(closing)


def active_weights(linked: DataFrame) -> DataFrame:
    """Average active weight per sector in percent, with ranks by active and by held weight."""
    whole = W.partitionBy("portfolio_id")
    return (
        linked.select(
            "portfolio_id",
            "sector",
            m.percent(F.col("avg_wp") - F.col("avg_wb")).alias("active_weight"),
            "avg_wp",
        )
        .withColumn("active_rank", F.row_number().over(whole.orderBy(F.desc("active_weight"), "sector")))
        .withColumn("weight_rank", F.row_number().over(whole.orderBy(F.desc("avg_wp"), "sector")))
    )


def weekly_weights(daily: DataFrame, star: Star) -> DataFrame:
    """Sector weights on every fifth benchmark date; `week_start` is a portfolio's first."""
    weeks = calendar.sampled(calendar.trading_calendar(star.benchmark_weights)).select("date", "week")
    return daily.join(weeks, "date").select(
        "portfolio_id",
        "week",
        F.min("week").over(W.partitionBy("portfolio_id")).alias("week_start"),
        "date",
        "sector",
        m.export_weight(F.col("wp")).alias("wp"),
    )


def week_readout(weekly: DataFrame, week: int | None = None) -> DataFrame:
    """Weights of one week, by default each portfolio's latest."""
    if week is not None:
        return weekly.where(F.col("week") == week)
    latest = F.max("week").over(W.partitionBy("portfolio_id"))
    return weekly.withColumn("latest", latest).where(F.col("week") == F.col("latest")).drop("latest")


def portfolio_detail(
    star: Star, held: attribution.Held, periods_per_year: int = m.PERIODS_PER_YEAR
) -> DataFrame:
    """One nested row per portfolio: series, risk, attribution and contributors.

    Every list is bounded by the calendar, the sectors or the ranks shown.  Give sectors that are kept: the fact is
    then scanned once for them and once for the contributions.
    """
    days = returns.day_returns(held)
    series = days.groupBy("portfolio_id").agg(
        F.sort_array(F.collect_list(F.struct("date", m.export_number(F.col("rp")).alias("rp")))).alias("series")
    )
    figures = ("twr", "bench_twr", "te", "ir", "max_drawdown")
    summary = risk.risk_summary(days, periods_per_year=periods_per_year).select(
        "portfolio_id", F.struct(*(m.export_number(F.col(c)).alias(c) for c in figures)).alias("risk")
    )
    effects = ("avg_wp", "avg_wb", "allocation", "selection", "interaction")
    linked = linking.linked_attribution(held).groupBy("portfolio_id").agg(
        F.sort_array(
            F.collect_list(F.struct("sector", *(m.export_number(F.col(c)).alias(c) for c in effects)))
        ).alias("attribution")
    )
    ranked = contribution.top_bottom(contribution.contributions(star, totals=held.totals))
    entry = F.struct("rank", "ticker", "sector", m.export_number(F.col("contribution")).alias("contribution"))
    sides = ranked.groupBy("portfolio_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "top", entry))).alias("top"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "bottom", entry))).alias("bottom"),
    )
    detail = (
        series.join(summary, "portfolio_id")
        .join(linked, "portfolio_id")
        .join(sides, "portfolio_id", "left")
    )
    return portfolio_names(star, detail)


def weights_matrix(weekly: DataFrame) -> DataFrame:
    """One nested row per portfolio: the weekly weights of every sector."""
    by_sector = weekly.groupBy("portfolio_id", "week_start", "sector").agg(
        F.sort_array(F.collect_list(F.struct("week", "wp"))).alias("weeks")
    )
    return by_sector.groupBy("portfolio_id", "week_start").agg(
        F.sort_array(F.collect_list(F.struct("sector", F.col("weeks.wp").alias("weights")))).alias("sectors")
    )


def export_marts(star: Star, path: str, periods_per_year: int = m.PERIODS_PER_YEAR) -> int:
    """Write the dashboard tables as JSON lines, one document per portfolio; returns the number of the export.

    All six are there together or not at all: they are written to a folder of their own, which one commit then
    names.  Daily effects that are not finite or NULL, and figures of any table that are NaN or infinite, are refused
    before anything is written.
    """
    spark = star.portfolios.sparkSession
    daily = stored(attribution.attribution_daily(star, within_lifespan=True))
    figures = ["wp", "wb", "rp", "rb_i", "rb_total", "allocation", "selection", "interaction"]
    if not quality.non_finite(daily, figures).isEmpty():
        raise ValueError("the daily effects hold figures that are not finite")
    held = attribution.held_sectors(star, within_lifespan=True, keep=True)
    tables = {
        "market": market_context(star),
        "sectors": sector_labels(star),
        "portfolios": star.portfolios.select("portfolio_id", "name"),
        "securities": models.eligible_securities(star).withColumn("label", m.short_sector(F.col("sector"))),
        "portfolio": portfolio_detail(star, held, periods_per_year),
        "weights": weights_matrix(weekly_weights(daily, star)),
    }
    tables = {name: stored(table, name) for name, table in tables.items()}
    for name, table in tables.items():
        if not quality.not_finite_inside(table).isEmpty():
            raise ValueError(f"{name} holds figures that are not finite")
    folder = f"export={uuid.uuid4().hex}"
    try:
        for name, table in tables.items():
            table.write.json(f"{path}/{folder}/{name}")
        number = len(commits.entries(spark, path)) + 1
        commits.commit(spark, path, number, {"folder": folder, "outputs": list(tables)})
    except Exception:
        remove(spark, f"{path}/{folder}")
        raise
    return number


def read_marts(spark: SparkSession, path: str, export: int | None = None) -> dict[str, DataFrame]:
    """The tables of an export, by default the last."""
    made = commits.entries(spark, path)
    if not made:
        raise ValueError(f"nothing is exported to {path}")
    entry = made[-1 if export is None else export - 1]
    return {name: spark.read.json(f"{path}/{entry['folder']}/{name}") for name in entry["outputs"]}
