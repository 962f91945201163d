"""Contribution of single securities to the portfolio return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.operators.common import Day, Portfolios
from perfattr.operators.series import basis_returns
from perfattr.sources.star import Star

TOP, BOTTOM = 8, 5


def contributions(
    star: Star, start: Day = None, end: Day = None, portfolios: Portfolios = None, totals: DataFrame | None = None
) -> DataFrame:
    """(portfolio_id, ticker, sector, contribution): sum of daily weight times return.

    Weights are shares of the holdings that have a return that day, so the day
    total is taken after the fact has met its returns.

    The day totals are a window by portfolio and date: over a fact bucketed by portfolio neither they nor the
    sums per series move it, and nothing is stored.  Given stored `totals` of the same holdings (`Held`), these
    meet the fact as an array per portfolio, and it is not sorted by date.
    """
    held = basis_returns(star, start, end, portfolios).where(F.col("portfolio_id").isNotNull())
    if totals is None:
        total = F.sum("basis").over(W.partitionBy("portfolio_id", "date"))
    else:
        held = held.join(totals.hint("shuffle_hash"), "portfolio_id")
        total = F.get("totals", F.col("place"))
    part = F.try_divide(F.col("basis") * F.col("ret"), total)
    return (
        held.select("portfolio_id", "security_id", part.alias("part"))
        .join(star.securities.select("security_id", "ticker", "sector"), "security_id")
        .groupBy("portfolio_id", "ticker", "sector")
        .agg(F.sum("part").alias("contribution"))
    )


def top_bottom(contributed: DataFrame, top: int = TOP, bottom: int = BOTTOM) -> DataFrame:
    """Best and worst contributors per portfolio; the worst exclude the best.

    Both come from one ranking of a portfolio's securities, so the contributions are read once.
    """
    whole = W.partitionBy("portfolio_id")
    best_first = whole.orderBy(F.col("contribution").desc(), "ticker", "sector")
    ranked = contributed.withColumn("place", F.row_number().over(best_first)).withColumn(
        "n", F.count("*").over(whole)
    )
    is_top = F.col("place") <= top
    return (
        ranked.where(is_top | (F.col("place") > F.col("n") - bottom))
        .withColumn("rank", F.when(is_top, F.col("place")).otherwise(F.col("n") - F.col("place") + 1).cast("int"))
        .withColumn("side", F.when(is_top, "top").otherwise("bottom"))
        .drop("place", "n")
    )
