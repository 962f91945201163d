"""Series as arrays: returns per security by calendar index, and prior-close values that meet them.

A security's returns are one row with an array as long as the calendar, so the fact meets them by
security and finds the day by its index.  If that table is small enough to be broadcast, the fact moves
only for the prior close, and not at all if it is bucketed.  Beyond that the fact moves once, by security and
a salt of the portfolio: that placement serves the prior-close window and the join alike, and a security
held by all portfolios lies in as many tasks as there are salts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from perfattr.operators.common import Day, Portfolios, in_range, over_time, pick_portfolios
from perfattr.sources.star import Star
from perfattr.sources.storage import broadcast_limit

#: Parts a security's portfolios are dealt to where returns are too large for a broadcast.
SALTS = 16


@dataclass(frozen=True)
class Returns:
    """rows: security_id, sector, rets; places: the calendar's index of each day from its first date on."""

    rows: DataFrame
    first: date | None
    places: list[int]
    n_bytes: int

    def index(self, day: Column) -> Column:
        """A date's place in the arrays; null if nothing has a return on it."""
        if self.first is None:
            return F.lit(None).cast("int")
        places = F.split(F.lit(",".join(map(str, self.places))), ",").cast("array<int>")  # folded to a constant
        return F.nullif(F.get(places, F.datediff(day, F.lit(self.first))), F.lit(-1))


def returns_by_security(star: Star, start: Day = None, end: Day = None) -> Returns:
    """Returns of the securities in the master as arrays by calendar index, null on dates without one.

    The calendar is read to the driver: a number per day of the year between its first and last date.
    """
    returns = in_range(star.benchmark_returns, start, end)
    known = returns.agg(F.collect_set("date").alias("dates"), F.count_distinct("security_id").alias("n")).first()
    dates = sorted(known.dates)
    places = [-1] * ((dates[-1] - dates[0]).days + 1 if dates else 0)
    for place, day in enumerate(dates):
        places[(day - dates[0]).days] = place
    found = Returns(returns, dates[0] if dates else None, places, known.n * len(dates) * 9)
    listed = F.array_sort(F.collect_list(F.struct("place", "ret"))).alias("listed")
    rows = returns.withColumn("place", found.index(F.col("date"))).groupBy("security_id").agg(listed)
    rows = star.securities.select("security_id", "sector").join(rows, "security_id")
    return replace(found, rows=rows.select("security_id", "sector", from_place_0("listed", "ret").alias("rets")))


def from_place_0(listed: str, name: str, kind: DataType | str = "double") -> Column:
    """Array by place, null where the ordered list of (place, value) has none."""
    none = F.lit(None).cast(kind)

    def step(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(listed, i - 1)["place"], F.lit(-1))
        return F.concat(F.array_repeat(none, x["place"] - before - 1), F.array(x[name]))

    return F.flatten(F.transform(listed, step))


def prior_closes(positions: DataFrame, *placed: str) -> DataFrame:
    """(portfolio_id, security_id, date, basis) of days with an earlier position; `placed` names further columns of the key."""
    keys = ("portfolio_id", "security_id", *placed)
    basis = F.lag("market_value").over(over_time(*keys))
    return positions.select(*keys, "date", basis.alias("basis")).where(F.col("basis").isNotNull())


def basis_returns(
    star: Star, start: Day = None, end: Day = None, portfolios: Portfolios = None
) -> DataFrame:
    """(portfolio_id, security_id, sector, date, place, basis, ret) of holdings with a prior close and a return.

    `place` is the date's index in the calendar of returns.
    The prior close is taken before the lower date bound, so the first day still sees its own.
    """
    returns = returns_by_security(star, start, end)
    positions = pick_portfolios(in_range(star.positions_daily, end=end), portfolios)
    if returns.n_bytes <= broadcast_limit(star.benchmark_returns.sparkSession):
        met = prior_closes(positions).join(F.broadcast(returns.rows), "security_id")
    else:
        salt = F.pmod(F.xxhash64("portfolio_id"), F.lit(SALTS)).cast("int")
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        placed = positions.withColumn("salt", salt).repartition("security_id", "salt")
        every = returns.rows.select("security_id", "sector", "rets", parts).hint("shuffle_hash")
        met = prior_closes(placed, "salt").join(every, ["security_id", "salt"])
    placed = met.withColumn("place", returns.index(F.col("date")))
    columns = ("portfolio_id", "security_id", "sector", "date", "place", "basis")
    found = placed.select(*columns, F.get("rets", F.col("place")).alias("ret"))
    return in_range(found.where(F.col("ret").isNotNull()), start)


def by_calendar(spans: DataFrame, calendar: DataFrame, own: DataFrame) -> DataFrame:
    """Rows of `spans` unfolded to the days of a calendar: its columns, `idx`, `day` and `own`, null where there is none.

    calendar: one row with `days`, an array of structs with a unique date.  own: (portfolio_id, date, own), one row per
    portfolio and date.  A portfolio's own rows become one array, so the two meet by portfolio: rows placed by portfolio
    stay where they are, before this and after it.
    """
    first = F.array_min(F.transform("days", lambda day: day["date"]))
    place = F.transform("days", lambda day, i: F.struct(F.datediff(day["date"], "first").alias("place"), i.alias("idx")))
    ruler = calendar.withColumn("first", first).withColumn("listed", F.filter(place, lambda x: x["place"].isNotNull()))
    ruler = ruler.select(F.struct("first", from_place_0("listed", "idx", "int").alias("places")).alias("ruler")).scalar()
    placed = own.withColumn("ruler", ruler)
    idx = F.get("ruler.places", F.datediff("date", "ruler.first"))
    placed = placed.select("portfolio_id", idx.alias("place"), "own").where(F.col("place").isNotNull())
    listed = placed.groupBy("portfolio_id").agg(F.array_sort(F.collect_list(F.struct("place", "own"))).alias("listed"))
    filled = from_place_0("listed", "own", own.schema["own"].dataType)
    met = spans.withColumn("days", calendar.scalar()).join(listed.select("portfolio_id", filled.alias("owns")), "portfolio_id", "left")
    days = F.transform("days", lambda day, i: F.struct(i.alias("idx"), day.alias("day"), F.get("owns", i).alias("own")))
    return met.select(*spans.columns, F.inline(days))
