"""Sector attribution: allocation, selection and interaction per portfolio and day.

The fact is scanned once and shuffled once, for the prior close, and meets returns and
sectors as one row per security (`series`).  Everything after the (portfolio, date,
sector) aggregate is small.

An unheld sector's effect depends on the benchmark alone.  `held_sectors` therefore has
rows for held sectors only, next to the benchmark's calendar; day returns, linked and
summed effects are made of these.  Only `attribution_daily`, whose result it is, spells
out every portfolio, date and sector.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.functions import measures as m
from perfattr.operators.common import Day, Portfolios, in_range, pick_portfolios
from perfattr.operators.series import basis_returns, by_calendar, from_place_0, prior_closes
from perfattr.sources.star import Star
from perfattr.sources.storage import stored


def weight_basis(
    star: Star,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
) -> DataFrame:
    """(portfolio_id, security_id, date, basis): prior-close value of every holding.

    The lag is taken before the lower date bound, so the first day still sees
    its prior close.
    """
    positions = pick_portfolios(in_range(star.positions_daily, end=end), portfolios)
    return in_range(prior_closes(positions), start)


def sector_bases(
    star: Star,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
) -> DataFrame:
    """(portfolio_id, date, place, sector, basis, basis_ret, total): sums over the holdings that have a return.

    `place` is the date's index in the calendar of returns, `total` the basis of all sectors.
    """
    collapsed = (
        basis_returns(star, start, end, portfolios)
        .groupBy("portfolio_id", "date", "sector")
        .agg(
            F.min("place").alias("place"),
            F.sum("basis").alias("basis"),
            F.sum(F.col("basis") * F.col("ret")).alias("basis_ret"),
        )
    )
    return collapsed.withColumn("total", F.sum("basis").over(W.partitionBy("portfolio_id", "date")))


def portfolio_sectors(
    star: Star,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
) -> DataFrame:
    """(portfolio_id, date, sector, wp, rp); NULL weight or return on a zero basis."""
    return _sector_weights(sector_bases(star, start, end, portfolios))


def _sector_weights(bases: DataFrame) -> DataFrame:
    return bases.select(
        "portfolio_id",
        "date",
        "sector",
        F.try_divide("basis", "total").alias("wp"),
        F.try_divide("basis_ret", "basis").alias("rp"),
    )


def _kept(bases: DataFrame) -> DataFrame:
    """Stored, a row per portfolio: `cells` with the other columns and `totals`, the day totals by calendar index."""
    cells = F.collect_list(F.struct("date", "sector", "basis", "basis_ret", "total")).alias("cells")
    listed = F.array_sort(F.collect_set(F.struct("place", "total"))).alias("listed")
    folded = bases.groupBy("portfolio_id").agg(cells, listed)
    return stored(folded.select("portfolio_id", "cells", from_place_0("listed", "total").alias("totals")), "bases")


def benchmark_sectors(star: Star, start: Day = None, end: Day = None) -> DataFrame:
    """(date, sector, wb, rb_i, rb_total) of the benchmark."""
    by_sector = (
        in_range(star.benchmark_weights, start, end)
        .join(in_range(star.benchmark_returns, start, end), ["date", "security_id"])
        .join(star.securities.select("security_id", "sector"), "security_id")
        .groupBy("date", "sector")
        .agg(
            F.sum("weight").alias("wb"),
            m.weighted_mean(F.col("ret"), F.col("weight")).alias("rb_i"),
        )
    )
    day = W.partitionBy("date")
    total = F.try_divide(F.sum(F.col("wb") * F.col("rb_i")).over(day), F.sum("wb").over(day))
    return by_sector.withColumn("rb_total", total)


def lifespans(positions: DataFrame) -> DataFrame:
    """First and last position date per portfolio."""
    return positions.groupBy("portfolio_id").agg(
        F.min("date").alias("first_position"), F.max("date").alias("last_position")
    )


def portfolio_spans(
    star: Star, portfolios: Portfolios = None, within_lifespan: bool = False
) -> DataFrame:
    """(portfolio_id, after, until): a portfolio's days lie after `after` and up to `until`; null is no limit.

    `within_lifespan` takes the days after the first and up to the last position.
    """
    ids = pick_portfolios(star.portfolios.select("portfolio_id"), portfolios)
    if not within_lifespan:
        none = F.lit(None).cast("date")
        return ids.select("portfolio_id", none.alias("after"), none.alias("until"))
    spans = lifespans(pick_portfolios(star.positions_daily, portfolios))
    return ids.join(spans, "portfolio_id").select(
        "portfolio_id", F.col("first_position").alias("after"), F.col("last_position").alias("until")
    )


def within(day: Column) -> Column:
    """Whether a day lies in its portfolio's span."""
    later = F.col("after").isNull() | (day > F.col("after"))
    return later & (F.col("until").isNull() | (day <= F.col("until")))


def market_calendar(market: DataFrame) -> DataFrame:
    """One row: `days`, the benchmark's dates in order with their total return (date, rb)."""
    days = market.groupBy("date").agg(F.max("rb_total").alias("rb"))
    return days.agg(F.array_sort(F.collect_list(F.struct("date", "rb"))).alias("days"))


@dataclass(frozen=True)
class Held:
    """Held sectors of all portfolios, and what the others need.

    rows: portfolio_id, date, sector, wp, rp, own, selection, interaction; the allocation of a held sector
    is `own` less what it would be unheld.  market: date, sector, wb, rb_i, rb_total, a stored table.
    spans: portfolio_id, after, until.  totals: portfolio_id, totals, the basis of all holdings with a return by
    calendar index; a stored table, if the sums of the whole fact have been kept.
    """

    rows: DataFrame
    market: DataFrame
    spans: DataFrame
    totals: DataFrame | None = None


def held_sectors(
    star: Star,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
    within_lifespan: bool = False,
    keep: bool = False,
) -> Held:
    """Effects of the sectors held by each portfolio; one without a weight or return of its own counts as unheld.

    With `keep` their sums and the spans are stored, so several tables can be made of them without the fact.
    """
    market = stored(benchmark_sectors(star, start, end), "market")
    wb, rb_i, rb = (F.col(c) for c in ("wb", "rb_i", "rb_total"))
    wp, rp = F.coalesce("wp", F.lit(0.0)), F.coalesce("rp", rb_i)
    bases = sector_bases(star, start, end, portfolios)
    kept = _kept(bases) if keep else None
    if keep:  # all of a portfolio in one task
        bases = kept.select("portfolio_id", "cells").repartition("portfolio_id").select("portfolio_id", F.inline("cells"))
    rows = _sector_weights(bases).join(market, ["date", "sector"])
    rows = rows.select(
        "portfolio_id",
        "date",
        "sector",
        wp.alias("wp"),
        rp.alias("rp"),
        (wp * (rb_i - rb)).alias("own"),
        m.selection_effect(wb, rp, rb_i).alias("selection"),
        m.interaction_effect(wp, wb, rp, rb_i).alias("interaction"),
    )
    whole = keep and start is None and end is None and portfolios is None
    totals = kept.select("portfolio_id", "totals") if whole else None
    spans = portfolio_spans(star, portfolios, within_lifespan)
    return Held(rows, market, stored(spans, "spans") if keep else spans, totals)


def spine(
    star: Star,
    held: DataFrame,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
    within_lifespan: bool = False,
) -> DataFrame:
    """Every (portfolio, date, benchmark sector), for results that have a row for each, with `wp` and `rp` where `held` has them.

    The benchmark's sectors are one array in the order of the calendar, as long as dates times
    sectors; each portfolio unfolds the part within its span next to its own days, so nothing is joined by date.
    """
    sectors = F.array_sort(F.collect_list(F.struct("sector", "wb", "rb_i", "rb_total")))
    days = benchmark_sectors(star, start, end).groupBy("date").agg(sectors.alias("sectors"))
    calendar = days.agg(F.array_sort(F.collect_list(F.struct("date", "sectors"))).alias("days"))
    own = held.groupBy("portfolio_id", "date").agg(F.collect_list(F.struct("sector", "wp", "rp")).alias("own"))
    unfolded = by_calendar(portfolio_spans(star, portfolios, within_lifespan), calendar, own)
    unfolded = unfolded.where(within(F.col("day.date"))).select(
        "portfolio_id", F.col("day.date").alias("date"), "own", F.inline("day.sectors")
    )
    mine = F.get(F.filter("own", lambda x: x["sector"] == F.col("sector")), F.lit(0))
    return unfolded.withColumn("mine", mine).select(
        "portfolio_id", "date", "sector", "wb", "rb_i", "rb_total", F.col("mine.wp").alias("wp"), F.col("mine.rp").alias("rp")
    )


def attribution_daily(
    star: Star,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
    within_lifespan: bool = False,
) -> DataFrame:
    """Effects per portfolio, date and sector.

    A sector without a weight or return of its own counts as unheld: weight 0
    and the benchmark's return, which leaves its allocation effect only.
    """
    held = portfolio_sectors(star, start, end, portfolios)
    grid = spine(star, held, start, end, portfolios, within_lifespan)
    wp, wb, rp, rb_i, rb = (F.col(c) for c in ("wp", "wb", "rp", "rb_i", "rb_total"))
    return (
        grid.withColumn("wp", F.coalesce(wp, F.lit(0.0)))
        .withColumn("rp", F.coalesce(rp, rb_i))
        .select(
            "portfolio_id",
            "date",
            "sector",
            "wp",
            "wb",
            "rp",
            "rb_i",
            "rb_total",
            m.allocation_effect(wp, wb, rb_i, rb).alias("allocation"),
            m.selection_effect(wb, rp, rb_i).alias("selection"),
            m.interaction_effect(wp, wb, rp, rb_i).alias("interaction"),
        )
    )


def attribution_period(daily: DataFrame) -> DataFrame:
    """Arithmetic sums of the daily effects and average weights per portfolio and sector."""
    return (
        daily.groupBy("portfolio_id", "sector")
        .agg(
            F.avg("wp").alias("avg_wp"),
            F.avg("wb").alias("avg_wb"),
            F.sum("allocation").alias("allocation"),
            F.sum("selection").alias("selection"),
            F.sum("interaction").alias("interaction"),
        )
        .withColumn("total", F.col("allocation") + F.col("selection") + F.col("interaction"))
    )


def attribution_over_period(
    star: Star,
    start: Day = None,
    end: Day = None,
    portfolios: Portfolios = None,
) -> DataFrame:
    """The same as `attribution_period` over all benchmark dates, without a row per portfolio and day.

    An unheld sector has an allocation effect only, -wb * (rb_i - rb), so the part of the
    allocation that depends on the benchmark alone is one sum per sector; the rest are sums
    over held rows.
    """
    held = held_sectors(star, start, end, portfolios)
    wb, rb_i, rb = (F.col(c) for c in ("wb", "rb_i", "rb_total"))
    own = held.rows.groupBy("portfolio_id", "sector").agg(
        F.sum("wp").alias("wp"),
        F.sum("own").alias("held"),
        F.sum("selection").alias("selection"),
        F.sum("interaction").alias("interaction"),
    )
    by_sector = held.market.groupBy("sector").agg(
        F.count("*").alias("n_days"),
        F.avg("wb").alias("avg_wb"),
        F.sum(wb * (rb_i - rb)).alias("market"),
    )
    sectors = by_sector.agg(F.collect_list(F.struct("sector", "n_days", "avg_wb", "market")).alias("sectors")).scalar()
    every = held.spans.withColumn("sectors", sectors).select("portfolio_id", F.inline("sectors"))

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0.0))

    return (
        every.join(own, ["portfolio_id", "sector"], "left")
        .select(
            "portfolio_id",
            "sector",
            F.try_divide(or_zero("wp"), "n_days").alias("avg_wp"),
            "avg_wb",
            (or_zero("held") - F.col("market")).alias("allocation"),
            or_zero("selection").alias("selection"),
            or_zero("interaction").alias("interaction"),
        )
        .withColumn("total", F.col("allocation") + F.col("selection") + F.col("interaction"))
    )
