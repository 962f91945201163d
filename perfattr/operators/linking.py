"""Log-linking of daily effects over a period (Cariño)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.functions import measures as m
from perfattr.operators.attribution import Held, market_calendar
from perfattr.operators.returns import held_days


def link_factors(days: DataFrame) -> DataFrame:
    """Daily returns (portfolio_id, date, rp, rb) with coefficients k_day, k_period and their ratio.

    The period coefficient needs the product over all days only, in any order.
    One day that no log can link leaves the whole portfolio without factors.
    """
    whole = W.partitionBy("portfolio_id")
    growth_p = F.product(1 + F.col("rp")).over(whole)
    growth_b = F.product(1 + F.col("rb")).over(whole)
    linkable = F.count("k_day").over(whole) == F.count(F.lit(1)).over(whole)
    return (
        days.withColumn("k_day", m.carino_coefficient(F.col("rp"), F.col("rb")))
        .withColumn("k_period", F.when(linkable, m.carino_coefficient(growth_p - 1, growth_b - 1)))
        .withColumn("factor", F.try_divide("k_day", "k_period"))
    )


def market_arrays(market: DataFrame) -> DataFrame:
    """One row: `sectors`, for each benchmark sector its weights and its effects where unheld, by calendar index.

    An entry is null on dates without the sector.  The arrays are as long as the calendar.
    """
    calendar = market_calendar(market).scalar()
    grid = market.select("sector").distinct().withColumn("days", calendar)
    grid = grid.select("sector", F.posexplode("days")).select("sector", F.col("pos").alias("idx"), "col.date")
    lost = F.col("wb") * (F.col("rb_i") - F.col("rb_total"))
    cells = grid.join(market, ["date", "sector"], "left").select("sector", "idx", "wb", lost.alias("lost"))
    lists = cells.groupBy("sector").agg(F.array_sort(F.collect_list(F.struct("idx", "wb", "lost"))).alias("cells"))
    rows = lists.select("sector", F.col("cells.wb").alias("wb"), F.col("cells.lost").alias("lost"))
    return rows.agg(F.collect_list(F.struct("sector", "wb", "lost")).alias("sectors"))


def _total(values: Column) -> Column:
    """Sum of an array's defined values."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def linked_attribution(held: Held) -> DataFrame:
    """Effects per portfolio and sector that add up to the linked active return.

    They are NULL for a portfolio with days that cannot be linked; `unlinked_days`
    counts these.

    What held sectors add is summed over their rows.  What a sector loses where it is unheld, and the
    part of the benchmark in every held one, is the dot product of the portfolio's
    factors, one array per portfolio, with the sector's array of the market: no row per
    portfolio, date and sector is made.
    """
    whole = W.partitionBy("portfolio_id")
    days = (
        link_factors(held_days(held, with_sectors=True))
        .withColumn("n_days", F.count("*").over(whole))
        .withColumn("unlinked", F.count_if(F.col("k_day").isNull()).over(whole))
    )
    f = F.col("factor")
    own = (
        days.select("portfolio_id", "factor", F.inline("sectors"))
        .groupBy("portfolio_id", "sector")
        .agg(
            F.sum("wp").alias("wp"),
            F.sum(f * F.col("own")).alias("own"),
            F.sum(f * F.col("selection")).alias("selection"),
            F.sum(f * F.col("interaction")).alias("interaction"),
        )
    )
    folded = days.groupBy("portfolio_id").agg(
        F.min("idx").alias("first"),
        F.max("n_days").alias("n_days"),
        F.max("unlinked").alias("unlinked_days"),
        F.count("factor").alias("linked"),
        F.array_sort(F.collect_list(F.struct("idx", "factor"))).alias("factors"),
    )
    every = folded.withColumn("sectors", market_arrays(held.market).scalar()).select(
        "portfolio_id", "first", "n_days", "unlinked_days", "linked", "factors", F.inline("sectors")
    )
    part = [F.slice(c, F.col("first") + 1, F.col("n_days").cast("int")) for c in ("wb", "lost")]
    products = F.zip_with("factors", "lost", lambda d, x: d["factor"] * x)
    every = every.withColumn("wb", part[0]).withColumn("lost", part[1])
    every = every.where(F.exists("wb", lambda x: x.isNotNull())).select(
        "portfolio_id",
        "sector",
        "n_days",
        "unlinked_days",
        "linked",
        _total(F.col("wb")).alias("wb"),
        _total(products).alias("lost"),
    )

    def effect(value: Column) -> Column:
        return F.when(F.col("linked") > 0, value)

    def or_zero(name: str) -> Column:
        return F.coalesce(name, F.lit(0.0))

    return (
        every.join(own, ["portfolio_id", "sector"], "left")
        .select(
            "portfolio_id",
            "sector",
            F.try_divide(or_zero("wp"), "n_days").alias("avg_wp"),
            F.try_divide("wb", "n_days").alias("avg_wb"),
            effect(or_zero("own") - F.col("lost")).alias("allocation"),
            effect(or_zero("selection")).alias("selection"),
            effect(or_zero("interaction")).alias("interaction"),
            "unlinked_days",
        )
        .withColumn("total", F.col("allocation") + F.col("selection") + F.col("interaction"))
    )


def attribution_totals(linked: DataFrame) -> DataFrame:
    """One total row per portfolio."""
    return linked.groupBy("portfolio_id").agg(
        *(F.sum(c).alias(c) for c in ("avg_wp", "avg_wb", "allocation", "selection", "interaction", "total"))
    )
