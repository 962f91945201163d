"""Model portfolios: target weights turned into rebalanced holdings.

Targets hold (model, ticker, weight, rebalance) with rebalance NONE, MONTHLY
or QUARTERLY.  Between two rebalances quantities stay fixed, so a model's value
at the k-th rebalance is the initial value times the product of the growth of
its targets over the segments before: no day-by-day loop.  Everything that
depends on a security only is computed per security, not per model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.operators.calendar import rebalance_flags, trading_calendar
from perfattr.operators.common import over_time, running
from perfattr.operators.holdings import ImportBatch, import_holdings
from perfattr.sources.schemas import GICS_SECTORS
from perfattr.sources.star import Star
from perfattr.sources.storage import stored

REBALANCES = ("NONE", "MONTHLY", "QUARTERLY")
INITIAL_VALUE = 1_000_000.0
BASE_PRICE = 100.0


# -- targets --------------------------------------------------------------------


def eligible_securities(star: Star) -> DataFrame:
    """(ticker, sector) with a return on every calendar date after the first."""
    returns = star.benchmark_returns
    first = returns.agg(F.min("date").alias("first_date")).scalar()
    n_dates = trading_calendar(returns).agg(F.count("*").alias("n_dates")).scalar()
    return (
        returns.where(F.col("date") > first)
        .groupBy("security_id")
        .agg(F.count("*").alias("n"))
        .join(star.securities, "security_id")
        .groupBy("ticker", "sector")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") == n_dates - 1)
        .select("ticker", "sector")
    )


def canonical_tickers(targets: DataFrame, securities: DataFrame) -> DataFrame:
    """Targets with the master's spelling of their tickers, whatever the case given."""
    spelling = securities.groupBy(F.upper("ticker").alias("key")).agg(F.min("ticker").alias("known"))
    return (
        targets.withColumn("key", F.upper("ticker"))
        .join(spelling, "key", "left")
        .withColumn("ticker", F.coalesce("known", "ticker"))
        .drop("key", "known")
    )


def equal_weights(picks: DataFrame) -> DataFrame:
    """Percent weights of (model, ticker): equal to two decimals, the first takes the rest."""
    n = F.count("*").over(W.partitionBy("model"))
    place = F.row_number().over(W.partitionBy("model").orderBy("ticker"))
    each = F.floor(F.lit(10000) / n) / 100
    return picks.select(
        "model",
        "ticker",
        F.when(place == 1, F.round(F.lit(100.0) - each * (n - 1), 2)).otherwise(each).alias("weight"),
    )


def _as_fraction(raw_sum: Column, value: Column) -> Column:
    """A sum of 90 to 110 means percents."""
    return F.when(raw_sum.between(90.0, 110.0), value / 100.0).otherwise(value)


def target_violations(
    targets: DataFrame, star: Star, models: DataFrame | None = None, max_holdings: int | None = None
) -> DataFrame:
    """(model, rule, n) for every broken rule; `models` lists those expected to have targets.

    `max_holdings` is a limit for forms that have one.
    """
    raw = F.sum("weight")
    off_sum = ~F.coalesce(_as_fraction(raw, raw).between(0.999, 1.001), F.lit(False))
    sums = targets.groupBy("model").agg(
        F.count("*").alias("rows"),
        F.count_if(~F.coalesce(F.col("weight") > 0, F.lit(False))).alias("not_positive"),
        F.when(off_sum, 1).otherwise(0).alias("off_sum"),
        F.count_if(~F.coalesce(F.col("rebalance").isin(*REBALANCES), F.lit(False))).alias("unknown_rule"),
        (F.count_distinct(F.coalesce("rebalance", F.lit(""))) - 1).alias("further_rules"),
    )
    repeats = (
        targets.groupBy("model", "ticker").count().where(F.col("count") > 1)
        .groupBy("model").agg(F.count("*").alias("n"))
    )
    tickers = targets.select("model", "ticker").distinct()
    returned = star.benchmark_returns.select("security_id").distinct()
    known = star.securities.join(returned, "security_id", "left_semi").select("ticker").distinct()
    unknown = tickers.join(known, "ticker", "left_anti")
    partial = tickers.join(known, "ticker", "left_semi").join(
        eligible_securities(star).select("ticker"), "ticker", "left_anti"
    )

    def rule(df: DataFrame, name: str, n: str) -> DataFrame:
        return df.select("model", F.lit(name).alias("rule"), F.col(n).cast("long").alias("n")).where("n > 0")

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("model").agg(F.count("*").alias("n"))

    limit = F.col("rows") if max_holdings is None else F.lit(max_holdings)
    too_many = sums.withColumn("extra", F.greatest(F.col("rows") - limit, F.lit(0)))
    found = (
        rule(too_many, "too_many_holdings", "extra")
        .unionByName(rule(sums, "unknown_rebalance", "unknown_rule"))
        .unionByName(rule(sums, "mixed_rebalance", "further_rules"))
        .unionByName(rule(sums, "weight_not_positive", "not_positive"))
        .unionByName(rule(sums, "weights_off_sum", "off_sum"))
        .unionByName(rule(repeats, "duplicate_ticker", "n"))
        .unionByName(rule(counted(unknown), "unknown_ticker", "n"))
        .unionByName(rule(counted(partial), "partial_history", "n"))
    )
    if models is not None:
        empty = models.select("model").distinct().join(targets, "model", "left_anti")
        found = found.unionByName(rule(empty.withColumn("n", F.lit(1)), "no_holdings", "n"))
    return found


def model_weights(targets: DataFrame, violations: DataFrame) -> DataFrame:
    """Targets of the valid models with weights that sum to 1."""
    whole = W.partitionBy("model")
    raw = F.sum("weight").over(whole)
    fraction = _as_fraction(raw, F.col("weight"))
    return (
        targets.join(violations.select("model").distinct(), "model", "left_anti")
        .select(
            "model",
            "ticker",
            "rebalance",
            F.try_divide(fraction, _as_fraction(raw, raw)).alias("weight"),
        )
    )


# -- price paths ----------------------------------------------------------------


def total_return_index(star: Star, tickers: DataFrame | None = None) -> DataFrame:
    """(ticker, sector, date, px): index of eligible securities, 100 on the first date."""
    wanted = eligible_securities(star)
    if tickers is not None:
        wanted = wanted.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    returns = star.benchmark_returns.join(
        star.securities.join(wanted, ["ticker", "sector"], "left_semi").select(
            "security_id", "ticker", "sector"
        ),
        "security_id",
    )
    first = star.benchmark_returns.agg(F.min("date").alias("first_date")).scalar()
    base = returns.select("ticker", "sector").distinct().select(
        "ticker", "sector", first.alias("date"), F.lit(0.0).alias("ret")
    )
    later = returns.where(F.col("date") > first).select("ticker", "sector", "date", "ret")
    growth = F.product(1 + F.col("ret")).over(running("ticker", "sector"))
    return base.unionByName(later).select(
        "ticker", "sector", "date", (F.lit(BASE_PRICE) * growth).alias("px")
    )


def segmented_index(index: DataFrame, used: DataFrame, star: Star) -> DataFrame:
    """The index per rebalance rule in use, with segment numbers and the price orders are sized at.

    `used` holds the (ticker, rebalance) pairs that some model has.  A segment starts on a
    rebalance date; its orders use the prior close.
    """
    flags = rebalance_flags(trading_calendar(star.benchmark_returns)).select(
        "date", "month_start", "quarter_start"
    )
    starts = (
        F.when(F.col("rebalance") == "MONTHLY", F.col("month_start"))
        .when(F.col("rebalance") == "QUARTERLY", F.col("quarter_start"))
        .otherwise(F.lit(False))
    )
    series, so_far = over_time("ticker", "sector"), running("ticker", "sector", "rebalance")
    order_px = F.when(
        F.col("starts") | F.col("prev_px").isNull(), F.coalesce("prev_px", "px")
    )
    return (
        index.withColumn("prev_px", F.lag("px").over(series))
        .join(flags, "date")
        .join(used, "ticker")
        .withColumn("starts", starts)
        .withColumn("segment", F.count_if("starts").over(so_far).cast("int"))
        .withColumn("order_px", F.last(order_px, ignorenulls=True).over(so_far))
        .select("ticker", "sector", "rebalance", "date", "px", "segment", "order_px")
    )


def price_paths(segmented: DataFrame) -> DataFrame:
    """One row per ticker and rule: `path`, its days in order, and `growth` of each segment up to the next order.

    The growth of the last segment is null.  Both are as long as the calendar at most.
    """
    entry = F.struct("date", "px", "segment", "order_px")
    folded = segmented.groupBy("ticker", "sector", "rebalance").agg(
        F.array_sort(F.collect_list(entry)).alias("path")
    )
    before = lambda i: F.get("path", i - 1)["segment"]
    opened = F.filter("path", lambda x, i: F.coalesce(before(i) != x["segment"], F.lit(True)))
    orders = F.transform(opened, lambda x: x["order_px"])
    return folded.withColumn("orders", orders).select(
        "ticker",
        "sector",
        "rebalance",
        "path",
        F.zip_with(F.slice("orders", 2, F.size("orders")), "orders", lambda to, at: F.try_divide(to, at)).alias("growth"),
    )


def segment_values(weights: DataFrame, paths: DataFrame) -> DataFrame:
    """(model, values): value at the prior close of every rebalance, by segment number."""
    growth = (
        weights.join(paths.select("ticker", "rebalance", "growth"), ["ticker", "rebalance"])
        .select("model", "weight", F.posexplode("growth").alias("segment", "growth"))
        .groupBy("model", "segment")
        .agg(F.sum(F.col("weight") * F.col("growth")).alias("growth"))
    )
    before = W.partitionBy("model").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    grown = F.coalesce(F.product("growth").over(before), F.lit(1.0))
    values = growth.select("model", "segment", (F.lit(INITIAL_VALUE) * grown).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("segment", "value")))
    return values.groupBy("model").agg(ordered["value"].alias("values"))


def model_holdings(weights: DataFrame, star: Star) -> DataFrame:
    """Holdings rows of the models, ready for the importer; the model is the account.

    A target meets its model's values and its ticker's path as one row each; days are spelt out last, so
    no row per target and day is shuffled.  The targets are dealt to all shuffle partitions, however small they are, as each
    turns into a row per day.  The rows of a model lie in one task wherever they are read: values and paths are stored, the days
    are not.
    """
    used = weights.select("ticker", "rebalance").distinct()
    paths = stored(price_paths(segmented_index(total_return_index(star, weights), used, star)))
    values = stored(segment_values(weights, paths))
    value = F.element_at("values", F.col("segment") + 1)
    dealt = weights.repartition(int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model")
    return (
        dealt.join(values.hint("merge"), "model")  # a broadcast of the targets would undo the dealing
        .join(paths.select("ticker", "sector", "rebalance", "path"), ["ticker", "rebalance"])
        .select("model", "ticker", "sector", "weight", "values", F.inline("path"))
        .select(
            F.col("model").alias("account"),
            "date",
            "ticker",
            "sector",
            F.try_divide(F.col("weight") * value, F.col("order_px")).alias("quantity"),
            F.col("px").alias("price"),
            F.lit(0.0).alias("dividend"),
        )
    )


def checked_weights(
    targets: DataFrame, star: Star, models: DataFrame | None = None, max_holdings: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Target violations and the weights of the valid models, both stored; the targets are worked out once."""
    targets = stored(targets, "targets")
    violations = stored(target_violations(targets, star, models, max_holdings))
    return violations, stored(model_weights(targets, violations))


def build_models(
    targets: DataFrame,
    star: Star,
    models: DataFrame | None = None,
    sectors: Sequence[str] = GICS_SECTORS,
) -> tuple[DataFrame, ImportBatch]:
    """Target violations and the import of all valid models; tickers may be given in any case."""
    violations, weights = checked_weights(canonical_tickers(targets, star.securities), star, models)
    return violations, import_holdings(model_holdings(weights, star), star, sectors=sectors)
