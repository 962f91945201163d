"""Variants of the derived star and the import and model inputs made from it.

Each brings out one rule: unheld sectors, zero weight bases, short lifespans,
broken holdings files, models of every rebalance rule.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.operators.calendar import trading_calendar
from perfattr.sources import testdata
from perfattr.sources.star import Star

PERIODS_PER_YEAR = 12


def sector_names(star: Star) -> list[str]:
    """The part types, which act as sectors, in order; a handful."""
    return [r.sector for r in star.securities.select("sector").distinct().orderBy("sector").collect()]


def _sector_rank(star: Star) -> DataFrame:
    """(security_id, sector_rank, n_sectors); the distinct sectors alone are numbered."""
    sectors = star.securities.select("sector").distinct()
    ranked = sectors.withColumn("sector_rank", F.row_number().over(W.orderBy("sector")) - 1)
    ranked = ranked.withColumn("n_sectors", sectors.agg(F.count("*").alias("n")).scalar())
    return star.securities.join(ranked, "sector").select("security_id", "sector_rank", "n_sectors")


def tilted(star: Star) -> Star:
    """Every portfolio lacks one sector."""
    held = star.positions_daily.join(_sector_rank(star), "security_id")
    kept = held.where(F.col("sector_rank") != F.col("portfolio_id") % F.col("n_sectors"))
    return star.with_positions(kept.drop("sector_rank", "n_sectors"))


def sold_out(star: Star) -> Star:
    """Every portfolio holds nothing of one sector for three dates."""
    dates = trading_calendar(star.benchmark_returns).select("date", "idx")
    held = star.positions_daily.join(_sector_rank(star), "security_id").join(dates, "date", "left")
    gone = F.coalesce(
        F.col("idx").between(6, 8)
        & (F.col("sector_rank") == (F.col("portfolio_id") + 1) % F.col("n_sectors")),
        F.lit(False),
    )
    return star.with_positions(
        held.withColumn("quantity", F.when(gone, 0.0).otherwise(F.col("quantity")))
        .withColumn("market_value", F.col("quantity") * F.col("price"))
        .drop("sector_rank", "n_sectors", "idx")
    )


def short_lived(star: Star) -> Star:
    """Every fifth portfolio ends in the middle of the calendar, the next one starts there."""
    dates = trading_calendar(star.benchmark_returns)
    middle = dates.agg(F.floor(F.count("*") / 2).alias("n")).scalar()
    turn = dates.where(F.col("idx") == middle).select(F.max("date").alias("turn")).scalar()
    kind = F.col("portfolio_id") % 5
    return star.with_positions(
        star.positions_daily.where(
            ((kind != 0) | (F.col("date") <= turn)) & ((kind != 1) | (F.col("date") >= turn))
        )
    )


def gapped(star: Star) -> Star:
    """Every seventh series is missing for a while, some of them for more than two years."""
    dates = trading_calendar(star.benchmark_returns).select("date", "idx")
    held = star.positions_daily.join(dates, "date", "left")
    kind = (F.col("portfolio_id") * 3 + F.col("security_id")) % 7
    gone = (kind == 2) & F.col("idx").between(38, 64) | (kind == 4) & F.col("idx").between(57, 60)
    return star.with_positions(held.where(~F.coalesce(gone, F.lit(False))).drop("idx"))


def benchmark_holes(star: Star) -> Star:
    """The benchmark has no weights in March and no returns in August."""
    return replace(
        star,
        benchmark_weights=star.benchmark_weights.where(F.month("date") != 3),
        benchmark_returns=star.benchmark_returns.where(F.month("date") != 8),
    )


def sparse_benchmark(star: Star) -> Star:
    """The first sector is missing from the benchmark in January."""
    first = star.securities.agg(F.min("sector").alias("first_sector")).scalar()
    dropped = star.securities.where(F.col("sector") == first).select("security_id")
    january = star.benchmark_weights.where(F.month("date") == 1)
    rest = star.benchmark_weights.where(F.month("date") != 1)
    return replace(
        star, benchmark_weights=rest.unionByName(january.join(dropped, "security_id", "left_anti"))
    )


# -- holdings -----------------------------------------------------------------------


def _account(portfolio_id: str = "portfolio_id") -> Column:
    return F.format_string("A%08d", F.col(portfolio_id))


def holdings_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored steps of all holdings, bucketed by account."""

    def write(path: str) -> None:
        buckets = testdata.n_buckets(spark, sf_dir)
        testdata.write_bucketed(_holding_steps(spark, sf_dir), path, buckets, "account", "ticker", "from_month")

    return testdata.write_once(spark, sf_dir, "holdings", write)


_HOLDING = ("account", "date", "ticker", "sector", "quantity", "price", "dividend")


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdings of all accounts as they would be delivered, unfolded from their stored steps."""
    return testdata.unfolded(_stored_steps(spark, sf_dir), _prices(spark, sf_dir)).select(*_HOLDING)


def holdings_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all rows of an account in one task: their steps are moved there, before they are unfolded."""
    rows = spark.read.parquet(holdings_path(spark, sf_dir))
    placed = rows.repartition(testdata.n_buckets(spark, sf_dir), "account")
    return testdata.unfolded(placed, _prices(spark, sf_dir)).select(*_HOLDING)


def broken_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one fault per account."""
    sectors = sector_names(testdata.load(spark, sf_dir).star)
    return _with_faults(_stored_steps(spark, sf_dir), _prices(spark, sf_dir), sectors)


def _holding_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All portfolios as accounts; a third with new tickers, a third with known ones, a third mixed."""
    loaded = testdata.load(spark, sf_dir)
    steps = testdata.matrix_steps(loaded.market, loaded.buys).join(
        F.broadcast(loaded.star.securities.select("security_id", "ticker", "sector")), "security_id"
    )
    kind = F.col("portfolio_id") % 3
    new = (kind == 0) | ((kind == 2) & (F.col("security_id") % 2 == 0))
    return steps.select(
        _account().alias("account"),
        F.when(new, F.concat(F.lit("N-"), F.col("ticker"))).otherwise(F.col("ticker")).alias("ticker"),
        "sector",
        "security_id",
        "held",
        "bought",
        "from_month",
        "to_month",
    )


def _stored_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.read_bucketed(spark, holdings_path(spark, sf_dir))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.matrix_prices(testdata.load(spark, sf_dir).market)


def account_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier as an account, and one without holdings per nation."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        _account("s_suppkey").alias("account"), F.col("s_name").alias("name")
    )
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.format_string("E%08d", F.col("n_nationkey")).alias("account"), F.col("n_name").alias("name")
    )
    return suppliers.unionByName(nations)


def _with_faults(steps: DataFrame, prices: DataFrame, sectors: list[str]) -> DataFrame:
    """One fault for nine of ten accounts, chosen by the last digit of the account number.

    The others each give the new tickers of one brand another sector, so they contradict one another.  What
    does not depend on the month is decided per step, before it is unfolded.
    """
    number = F.substring("account", 2, 8).cast("int")
    first_sector, last_sector = F.lit(sectors[0]), F.lit(sectors[-1])
    other = F.when(F.col("sector") == first_sector, last_sector).otherwise(first_sector)
    brand = F.substring_index("ticker", "#", -1)
    kind = F.col("kind")
    sector = (
        F.when((kind == 1) & (brand == "7"), F.lit("PETROLEUM"))
        .when((kind == 7) & (brand == "5"), other)
        .when((kind == 0) & F.col("ticker").startswith("N-") & (brand.cast("int") == F.floor(number / 10) % 25 + 1), other)
        .otherwise(F.col("sector"))
    )
    marked = (
        steps.withColumn("kind", number % 10)
        .withColumn("in_may", F.when((kind == 6) & (brand == "3"), other))
        .withColumn("brand", brand)
        .withColumn("sector", sector)
    )

    def month(year: int, of_year: int) -> int:
        return 12 * year + of_year - 1

    def lost(m: Column) -> Column:
        return ((kind == 4) & (m == month(1998, 3))) | (
            (kind == 5) & (m == month(1999, 8)) & (F.col("brand") == "2")
        )

    def repeated(m: Column) -> Column:
        return (kind == 9) & (m == month(2000, 4))

    months = F.sequence("from_month", "to_month")
    months = F.concat(F.filter(months, lambda m: ~lost(m)), F.filter(months, repeated))
    rows = testdata.unfolded(marked, prices.withColumn("of_year", testdata.month_of_year(F.col("month"))), months)
    of_year = F.col("of_year")
    return rows.select(
        "account",
        F.when((kind == 3) & (F.col("month") == month(1997, 2)), F.date_add("date", 1))
        .otherwise(F.col("date"))
        .alias("date"),
        "ticker",
        F.when(of_year == 5, F.coalesce("in_may", "sector")).otherwise(F.col("sector")).alias("sector"),
        F.when((kind == 8) & (of_year == 7), F.lit(None)).otherwise(F.col("quantity")).alias("quantity"),
        F.when((kind == 2) & (of_year == 12), -F.col("price")).otherwise(F.col("price")).alias("price"),
        "dividend",
    )


# -- models ---------------------------------------------------------------------------

WEIGHT_STEPS = 2**20
# Sector names of the public standard, four of them with a short label.
LONG_SECTORS = (
    "Information Technology",
    "Communication Services",
    "Consumer Discretionary",
    "Consumer Staples",
    "Energy",
    "Utilities",
)
#: The limit that the broken targets are checked against.
MAX_HOLDINGS = 150


def targets(star: Star, rebalance: str | None = None) -> DataFrame:
    """One model per portfolio: all of its last holdings.

    Weights are percents in steps of 2**-20 of the whole; the largest holding
    takes the rest.  The rebalance rule goes round by portfolio unless given.
    """
    last = star.positions_daily.agg(F.max("date").alias("last_date")).scalar()
    largest = W.partitionBy("portfolio_id").orderBy(F.desc("market_value"), "security_id")
    top = (
        star.positions_daily.where(F.col("date") == last)
        .withColumn("place", F.row_number().over(largest))
    )
    whole = W.partitionBy("portfolio_id")
    steps = F.greatest(
        F.floor(F.col("market_value") / F.sum("market_value").over(whole) * WEIGHT_STEPS), F.lit(1)
    )
    sized = top.withColumn("steps", steps)
    rest = F.lit(WEIGHT_STEPS) - F.sum("steps").over(whole) + F.col("steps")
    rule = F.element_at(
        F.array(F.lit("NONE"), F.lit("MONTHLY"), F.lit("QUARTERLY")), F.col("portfolio_id") % 3 + 1
    )
    return (
        sized.withColumn("steps", F.when(F.col("place") == 1, rest).otherwise(F.col("steps")))
        .join(star.securities.select("security_id", "ticker"), "security_id")
        .select(
            F.format_string("M%08d", "portfolio_id").alias("model"),
            "ticker",
            (F.col("steps") * 100.0 / WEIGHT_STEPS).alias("weight"),
            (F.lit(rebalance) if rebalance else rule).alias("rebalance"),
        )
    )


def broken_targets(star: Star) -> DataFrame:
    """The targets with one fault per model, chosen by the last digit of its number."""
    kind = F.substring("model", 2, 8).cast("int") % 8
    largest = F.row_number().over(W.partitionBy("model").orderBy(F.desc("weight"), "ticker")) == 1
    rows = targets(star).withColumn("largest", largest)
    spoilt = rows.select(
        "model",
        F.when((kind == 1) & F.col("largest"), F.concat(F.lit("X-"), F.col("ticker")))
        .otherwise(F.col("ticker"))
        .alias("ticker"),
        F.when((kind == 2) & F.col("largest"), -F.col("weight"))
        .when((kind == 3) & F.col("largest"), F.col("weight") + 20.0)
        .otherwise(F.col("weight"))
        .alias("weight"),
        "rebalance",
        "largest",
    )
    again = spoilt.where((kind == 4) & F.col("largest"))
    many = spoilt.where(kind == 5).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(6))))
    many = many.withColumn("ticker", F.concat_ws("/", "ticker", "copy")).drop("copy")
    lower = spoilt.where((kind != 5) & (kind != 6)).unionByName(
        spoilt.where(kind == 6).withColumn("ticker", F.lower("ticker"))
    )
    number = F.substring("model", 2, 8).cast("int")
    rule = F.when(number % 24 == 7, "YEARLY").when((number % 24 == 15) & F.col("largest"), "QUARTERLY")
    return (
        lower.unionByName(again)
        .unionByName(many)
        .withColumn("rebalance", F.coalesce(rule, F.col("rebalance")))
        .drop("largest")
    )


def late_returns(star: Star) -> Star:
    """The last ticker has returns in the last twelve dates only."""
    dates = trading_calendar(star.benchmark_returns)
    n_dates = dates.agg(F.count("*").alias("n_dates")).scalar()
    recent = dates.where(F.col("idx") >= n_dates - 12).select("date")
    last_ticker = star.securities.agg(F.max("ticker").alias("ticker")).scalar()
    late = star.securities.where(F.col("ticker") == last_ticker).select("security_id")
    full = star.benchmark_returns.join(late, "security_id", "left_anti")
    short = star.benchmark_returns.join(late, "security_id", "left_semi").join(recent, "date", "left_semi")
    return replace(star, benchmark_returns=full.unionByName(short))
