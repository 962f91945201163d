"""The registered queries over the derived star.

Each takes (spark, sf_dir) and reads whole tables.  Computed doubles are
rounded so that results can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfattr.operators import attribution as att
from perfattr.operators import calendar as cal
from perfattr.operators import contribution as con
from perfattr.operators import holdings as imp
from perfattr.operators import linking, models, quality, returns, risk
from perfattr.plans import inputs, marts
from perfattr.sources import batches, testdata
from perfattr.sources import star as stars
from perfattr.sources.holdings_csv import read_holdings
from perfattr.sources.ordered import read_places, write_ordered
from perfattr.sources.periods import read_window, write_by_period
from perfattr.sources.star import Star
from perfattr.sources.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]

WINDOW = ("1997-02-01", "1999-10-01")
P = inputs.PERIODS_PER_YEAR
REGISTRY: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Round every double column."""
    return df.select(
        *(
            F.round(f.name, special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def over_star(name: str, digits: int = 9, **special: int):
    """Register a function of the derived star."""

    def register(build: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
        REGISTRY[name] = lambda spark, sf_dir: rounded(build(testdata.load(spark, sf_dir).star), digits, **special)
        return build

    return register


# -- tables and calendar ----------------------------------------------------------------


@over_star("star_counts")
def star_counts(star: Star) -> DataFrame:
    return stars.row_counts(star)


@over_star("data_range")
def data_range(star: Star) -> DataFrame:
    return stars.data_range(star)


@over_star("calendar")
def calendar(star: Star) -> DataFrame:
    return cal.trading_calendar(star.benchmark_returns)


@over_star("rebalance_dates")
def rebalance_dates(star: Star) -> DataFrame:
    return cal.rebalance_flags(cal.trading_calendar(star.benchmark_returns)).drop("idx")


@over_star("period_starts")
def period_starts(star: Star) -> DataFrame:
    return cal.period_starts(star.benchmark_returns)


@over_star("portfolio_names")
def portfolio_names(star: Star) -> DataFrame:
    """Every second portfolio is unknown to the master and gets the fallback name."""
    known = star.portfolios.where(F.col("portfolio_id") % 2 == 0)
    ids = star.positions_daily.select("portfolio_id").distinct()
    return stars.portfolio_names(replace(star, portfolios=known), ids)


# -- returns ------------------------------------------------------------------------------


@over_star("valuations", 4)
def valuations(star: Star) -> DataFrame:
    return returns.valuations(star)


@over_star("subperiod_returns")
def subperiod_returns(star: Star) -> DataFrame:
    return returns.sub_period_returns(returns.valuations(star)).select("portfolio_id", "date", "rp")


@over_star("twr_by_portfolio", 8)
def twr_by_portfolio(star: Star) -> DataFrame:
    return returns.twr(returns.valuations(star))


@over_star("twr_with_bad_days", 8)
def twr_with_bad_days(star: Star) -> DataFrame:
    """Every third portfolio pays out its whole value in its Decembers."""
    valued = returns.valuations(star)
    out = (F.col("portfolio_id") % 3 == 0) & (F.month("date") == 12)
    return returns.twr(valued.withColumn("cf", F.when(out, -F.col("mv_begin")).otherwise(F.col("cf"))))


@over_star("benchmark_returns_daily")
def benchmark_returns_daily(star: Star) -> DataFrame:
    return returns.benchmark_days(star)


@over_star("active_return", 8)
def active_return(star: Star) -> DataFrame:
    return returns.active_returns(returns.market_value_days(star))


@over_star("portfolio_day_returns")
def portfolio_day_returns(star: Star) -> DataFrame:
    return returns.day_returns(att.held_sectors(star))


# -- attribution ---------------------------------------------------------------------------


@over_star("weight_basis", 4)
def weight_basis(star: Star) -> DataFrame:
    return att.weight_basis(star)


@over_star("sector_weights")
def sector_weights(star: Star) -> DataFrame:
    return att.portfolio_sectors(star)


@over_star("benchmark_sectors")
def benchmark_sectors(star: Star) -> DataFrame:
    return att.benchmark_sectors(star)


@over_star("attribution_daily")
def attribution_daily(star: Star) -> DataFrame:
    return att.attribution_daily(star)


@over_star("attribution_daily_tilted")
def attribution_daily_tilted(star: Star) -> DataFrame:
    return att.attribution_daily(inputs.tilted(star))


@over_star("attribution_zero_basis")
def attribution_zero_basis(star: Star) -> DataFrame:
    return att.attribution_daily(inputs.sold_out(star))


@over_star("attribution_window")
def attribution_window(star: Star) -> DataFrame:
    return att.attribution_daily(star, *WINDOW)


def _bounded_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of a fact with gaps, from the periods it touches and what is carried into them."""
    star = testdata.load(spark, sf_dir).star

    def write(path: str) -> None:
        write_by_period(inputs.gapped(star).positions_daily, path)

    path = testdata.write_once(spark, sf_dir, "gapped", write)
    window = star.with_positions(read_window(spark, path, *WINDOW)).by_portfolio()
    return rounded(att.attribution_over_period(window, *WINDOW))


REGISTRY["attribution_bounded_lookback"] = _bounded_lookback


@over_star("attribution_gapped")
def attribution_gapped(star: Star) -> DataFrame:
    """The same window out of the whole fact."""
    return att.attribution_over_period(inputs.gapped(star), *WINDOW)


REGISTRY["attribution_picked_portfolios"] = lambda spark, sf_dir: rounded(
    att.attribution_period(
        att.attribution_daily(
            testdata.load(spark, sf_dir).star,
            portfolios=spark.read.parquet(f"{sf_dir}/supplier.parquet")
            .where(F.col("s_acctbal") < 0)
            .select(F.col("s_suppkey").cast("int").alias("portfolio_id")),
        )
    )
)


@over_star("attribution_period")
def attribution_period(star: Star) -> DataFrame:
    return att.attribution_over_period(star)


@over_star("attribution_period_sold_out")
def attribution_period_sold_out(star: Star) -> DataFrame:
    return att.attribution_over_period(inputs.sold_out(inputs.tilted(star)))


@over_star("attribution_lifespan")
def attribution_lifespan(star: Star) -> DataFrame:
    return att.attribution_daily(inputs.short_lived(star), within_lifespan=True)


@over_star("lifespan")
def lifespan(star: Star) -> DataFrame:
    return marts.lifespan_days(inputs.short_lived(star))


@over_star("carino_factors", 8)
def carino_factors(star: Star) -> DataFrame:
    return linking.link_factors(returns.day_returns(att.held_sectors(star, within_lifespan=True)))


@over_star("attribution_linked")
def attribution_linked(star: Star) -> DataFrame:
    return linking.linked_attribution(att.held_sectors(star, within_lifespan=True))


@over_star("attribution_linked_short_lived")
def attribution_linked_short_lived(star: Star) -> DataFrame:
    return attribution_linked(inputs.short_lived(star))


@over_star("linked_with_bad_days")
def linked_with_bad_days(star: Star) -> DataFrame:
    """Every third portfolio is geared so that some of its days cannot be linked."""
    held = att.held_sectors(star, within_lifespan=True)
    gear = F.when(F.col("portfolio_id") % 3 == 0, 25.0).otherwise(1.0)
    return linking.linked_attribution(replace(held, rows=held.rows.withColumn("rp", F.col("rp") * gear)))


@over_star("attribution_totals")
def attribution_totals(star: Star) -> DataFrame:
    return linking.attribution_totals(
        linking.linked_attribution(att.held_sectors(star, within_lifespan=True))
    )


@over_star("contribution")
def contribution(star: Star) -> DataFrame:
    return con.contributions(star)


@over_star("top_bottom_contributors")
def top_bottom_contributors(star: Star) -> DataFrame:
    return con.top_bottom(con.contributions(star))


# -- risk -----------------------------------------------------------------------------------


def _weight_days(star: Star) -> DataFrame:
    return returns.day_returns(att.held_sectors(star, within_lifespan=True))


@over_star("risk_summary", 8)
def risk_summary(star: Star) -> DataFrame:
    return risk.risk_summary(_weight_days(star), periods_per_year=P)


@over_star("risk_summary_short_lived", 8)
def risk_summary_short_lived(star: Star) -> DataFrame:
    return risk_summary(inputs.short_lived(star))


@over_star("cumulative_curves", 8)
def cumulative_curves(star: Star) -> DataFrame:
    return risk.curves(_weight_days(star))


@over_star("drawdown_series", 8)
def drawdown_series(star: Star) -> DataFrame:
    return risk.drawdowns(_weight_days(star))


@over_star("rolling_te", 8)
def rolling_te(star: Star) -> DataFrame:
    return risk.rolling_tracking_error(_weight_days(star), periods_per_year=P)


@over_star("rolling_te_short_lived", 8)
def rolling_te_short_lived(star: Star) -> DataFrame:
    return rolling_te(inputs.short_lived(star))


@over_star("period_kpis", 8)
def period_kpis(star: Star) -> DataFrame:
    return marts.period_kpis(_weight_days(star), star.benchmark_returns, P)


@over_star("period_kpis_short_lived", 8)
def period_kpis_short_lived(star: Star) -> DataFrame:
    return period_kpis(inputs.short_lived(star))


# -- marts ----------------------------------------------------------------------------------


@over_star("performance_summary", 8)
def performance_summary(star: Star) -> DataFrame:
    return marts.performance_summary(star, periods_per_year=P)


@over_star("performance_summary_window", 8)
def performance_summary_window(star: Star) -> DataFrame:
    return marts.performance_summary(star, *WINDOW, periods_per_year=P)


@over_star("performance_summary_holes", 8)
def performance_summary_holes(star: Star) -> DataFrame:
    return marts.performance_summary(inputs.benchmark_holes(star), periods_per_year=P)


@over_star("active_return_holes", 8)
def active_return_holes(star: Star) -> DataFrame:
    return returns.active_returns(returns.market_value_days(inputs.benchmark_holes(star)))


@over_star("market_context")
def market_context(star: Star) -> DataFrame:
    return marts.market_context(star)


@over_star("sector_labels")
def sector_labels(star: Star) -> DataFrame:
    return marts.sector_labels(star)


@over_star("waterfall", 5)
def waterfall(star: Star) -> DataFrame:
    return marts.waterfall(linking.linked_attribution(att.held_sectors(star, within_lifespan=True)))


@over_star("active_weights", 8)
def active_weights(star: Star) -> DataFrame:
    return marts.active_weights(attribution_linked(star))


@over_star("active_weights_tilted", 8)
def active_weights_tilted(star: Star) -> DataFrame:
    return active_weights(inputs.tilted(star))


@over_star("weekly_weights", 5)
def weekly_weights(star: Star) -> DataFrame:
    return marts.weekly_weights(att.attribution_daily(star, within_lifespan=True), star)


@over_star("weekly_weights_short_lived", 5)
def weekly_weights_short_lived(star: Star) -> DataFrame:
    return weekly_weights(inputs.short_lived(star))


@over_star("week_readout", 5)
def week_readout(star: Star) -> DataFrame:
    return marts.week_readout(weekly_weights(star))


@over_star("week_readout_short_lived", 5)
def week_readout_short_lived(star: Star) -> DataFrame:
    return week_readout(inputs.short_lived(star))


@over_star("weights_matrix")
def weights_matrix(star: Star) -> DataFrame:
    """The nested weekly weights, a row per portfolio and sector, as text."""
    rows = marts.weights_matrix(weekly_weights(star)).select("portfolio_id", "week_start", F.inline("sectors"))
    weights = F.array_join(F.transform("weights", lambda w: F.format_string("%.5f", w)), ",")
    return rows.withColumn("weights", weights)


@over_star("sector_labels_gics")
def sector_labels_gics(star: Star) -> DataFrame:
    """The part types under names of the public sector standard."""
    names = dict(zip(inputs.sector_names(star), inputs.LONG_SECTORS))
    named = star.securities.replace(names, subset="sector")
    return marts.sector_labels(replace(star, securities=named))


def _spelt(*figures: Column) -> Column:
    """Fields of a nested row as one text; numbers with seven digits, undefined ones as null."""
    return F.concat_ws("|", *figures)


def _figure(value: Column) -> Column:
    return F.coalesce(F.format_string("%.7f", value + 0.0), F.lit("null"))


@over_star("portfolio_detail")
def portfolio_detail(star: Star) -> DataFrame:
    """The nested documents, every list as canonical text."""
    detail = marts.portfolio_detail(star, att.held_sectors(star, within_lifespan=True, keep=True), P)

    def listed(name: str, spell: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.array_join(F.transform(name, spell), ";"), F.lit("")).alias(name)

    def ranked(x: Column) -> Column:
        return _spelt(x["rank"].cast("string"), x["ticker"], x["sector"], _figure(x["contribution"]))

    effects = ("avg_wp", "avg_wb", "allocation", "selection", "interaction")
    figures = ("twr", "bench_twr", "te", "ir", "max_drawdown")
    return detail.select(
        "portfolio_id",
        "name",
        listed("series", lambda x: _spelt(x["date"].cast("string"), _figure(x["rp"]))),
        _spelt(*(_figure(F.col("risk")[c]) for c in figures)).alias("risk"),
        listed("attribution", lambda x: _spelt(x["sector"], *(_figure(x[c]) for c in effects))),
        listed("top", ranked),
        listed("bottom", ranked),
    )


def _weekday_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weekdays from the first to the last date with returns."""
    span = stars.data_range(testdata.load(spark, sf_dir).star).first()
    days = (span.max_date - span.min_date).days
    return cal.weekday_calendar(spark, span.min_date, days).where(F.col("date") <= span.max_date)


REGISTRY["weekday_calendar"] = _weekday_calendar


@over_star("unexportable_sectors")
def unexportable_sectors(star: Star) -> DataFrame:
    """Zero bases leave NULL, and every third portfolio has infinite returns."""
    held = att.portfolio_sectors(inputs.sold_out(star))
    infinite = F.when(F.col("portfolio_id") % 3 == 0, float("inf")).otherwise(F.col("rp"))
    return quality.non_finite(held.withColumn("rp", infinite), ["wp", "rp"]).select("portfolio_id", "date", "sector")


@over_star("ordered_attribution")
def ordered_attribution(star: Star) -> DataFrame:
    """Period effects written in order, with the place each row has among all files."""
    path = new_path(star.portfolios.sparkSession, "ordered")
    effects = att.attribution_over_period(star).select("portfolio_id", "sector", "total")
    write_ordered(effects, path, F.desc("portfolio_id"), "sector")
    return read_places(star.portfolios.sparkSession, path)


# -- checks ---------------------------------------------------------------------------------


@over_star("invariant_check")
def invariant_check(star: Star) -> DataFrame:
    return quality.invariant_gaps(att.attribution_daily(inputs.sparse_benchmark(star)))


@over_star("invariant_violations")
def invariant_violations(star: Star) -> DataFrame:
    return quality.invariant_violations(att.attribution_daily(inputs.sparse_benchmark(star)))


@over_star("uncovered_sectors")
def uncovered_sectors(star: Star) -> DataFrame:
    sparse = inputs.sparse_benchmark(star)
    return quality.uncovered_sectors(att.portfolio_sectors(sparse), att.benchmark_sectors(sparse))


@over_star("return_gap")
def return_gap(star: Star) -> DataFrame:
    return quality.return_gap(returns.valuations(star), att.held_sectors(star, within_lifespan=True))


@over_star("return_gap_holes")
def return_gap_holes(star: Star) -> DataFrame:
    return return_gap(inputs.benchmark_holes(star))


@over_star("attribution_diff")
def attribution_diff(star: Star) -> DataFrame:
    """All portfolios against the tilted ones, of which every other is left out."""
    full = att.attribution_period(att.attribution_daily(star))
    part = att.attribution_period(att.attribution_daily(inputs.tilted(star)))
    effects = ["allocation", "selection", "interaction"]
    return quality.max_abs_diff(
        full, part.where(F.col("portfolio_id") % 2 == 0), ["portfolio_id", "sector"], effects
    )


@over_star("bad_valuations", 4)
def bad_valuations(star: Star) -> DataFrame:
    """Portfolios that pay out their whole value once a year."""
    valued = returns.valuations(star)
    paid_out = F.when(F.month("date") == 12, -F.col("mv_begin")).otherwise(F.col("cf"))
    return quality.bad_valuations(valued.withColumn("cf", paid_out))


@over_star("unlinkable_days")
def unlinkable_days(star: Star) -> DataFrame:
    """A short portfolio with twenty-five times the benchmark's loss."""
    days = returns.market_value_days(star).select("portfolio_id", "date", "rp", "rb")
    return quality.unlinkable_days(days.withColumn("rp", F.col("rp") * 25))


# -- holdings import ------------------------------------------------------------------------


_imports: dict[tuple, imp.ImportBatch] = {}


def _good_import(spark: SparkSession, sf_dir: str) -> imp.ImportBatch:
    """The import of all good holdings; its stored stages serve all queries of an application."""
    key = (spark.sparkContext.applicationId, inputs.holdings_path(spark, sf_dir))
    if key not in _imports:
        star = testdata.load(spark, sf_dir).star
        _imports[key] = imp.import_holdings(
            inputs.holdings(spark, sf_dir), star, sectors=inputs.sector_names(star)
        )
    return _imports[key]


def over_import(name: str, digits: int = 9, **special: int):
    """Register a function of the import of all good holdings."""

    def register(build: Callable[[imp.ImportBatch], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(build(_good_import(spark, sf_dir)), digits, **special)

        REGISTRY[name] = query
        return build

    return register


@over_import("import_security_map")
def import_security_map(batch: imp.ImportBatch) -> DataFrame:
    return batch.security_map.select(
        "ticker", "sector", "security_id", "first_account", F.col("existing_id").isNull().alias("is_new")
    )


@over_import("import_positions", 4)
def import_positions(batch: imp.ImportBatch) -> DataFrame:
    return batch.deltas["positions_daily"]


@over_import("import_returns")
def import_returns(batch: imp.ImportBatch) -> DataFrame:
    return batch.deltas["benchmark_returns"]


@over_import("import_flows", 4)
def import_flows(batch: imp.ImportBatch) -> DataFrame:
    return batch.deltas["transactions"].drop("security_id")


@over_import("import_securities")
def import_securities(batch: imp.ImportBatch) -> DataFrame:
    return batch.deltas["securities"]


@over_import("import_portfolios")
def import_portfolios(batch: imp.ImportBatch) -> DataFrame:
    return batch.deltas["portfolios"]


def _broken_import(spark: SparkSession, sf_dir: str) -> imp.ImportBatch:
    star = testdata.load(spark, sf_dir).star
    return imp.import_holdings(
        inputs.broken_holdings(spark, sf_dir),
        star,
        accounts=inputs.account_names(spark, sf_dir),
        sectors=inputs.sector_names(star),
    )


REGISTRY["import_violations"] = lambda spark, sf_dir: _broken_import(spark, sf_dir).violations
REGISTRY["import_summary"] = lambda spark, sf_dir: _broken_import(spark, sf_dir).summary
REGISTRY["import_unknown_sectors"] = lambda spark, sf_dir: imp.unknown_sectors(
    inputs.broken_holdings(spark, sf_dir), inputs.sector_names(testdata.load(spark, sf_dir).star)
)


def _imported_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution of the imported accounts alone, over the star they were added to."""
    star = testdata.load(spark, sf_dir).star
    batch = _good_import(spark, sf_dir)
    daily = att.attribution_daily(star.append(batch.deltas).by_portfolio(), portfolios=batch.accounts)
    return rounded(att.attribution_period(daily))


REGISTRY["import_attribution"] = _imported_attribution


def _compacted_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribution of all portfolios over the star and an import, published one after the other and compacted."""
    root = new_path(spark, "compacted")
    buckets = testdata.n_buckets(spark, sf_dir)  # as many as the star's own, whose rows stay where they are
    batches.publish(spark, testdata.load(spark, sf_dir).star.tables(), root, "star", base=0, buckets=buckets)
    batches.publish(spark, _good_import(spark, sf_dir).deltas, root, "import", base=1)
    batches.compact(spark, root)
    return rounded(att.attribution_over_period(batches.read_published(spark, root)))


REGISTRY["compacted_attribution"] = _compacted_attribution


@over_import("published_positions", 4)
def published_positions(batch: imp.ImportBatch) -> DataFrame:
    """Positions and cash flows of the import, published and read back."""
    spark = batch.violations.sparkSession
    root = new_path(spark, "published")
    batches.publish(spark, batch.deltas, root, "import", base=0)
    star = batches.read_published(spark, root)
    flows = star.transactions.groupBy("portfolio_id", "date").agg(F.sum("amount").alias("cf"))
    return (
        star.positions_daily.groupBy("portfolio_id", "date")
        .agg(F.count("*").alias("n"), F.sum("market_value").alias("market_value"))
        .join(flows, ["portfolio_id", "date"], "left")
    )


def _holdings_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdings as delivered: written as CSV, a folder per account, and read with their types."""
    path = new_path(spark, "csv")
    rows = inputs.holdings_by_account(spark, sf_dir)
    rows.write.option("header", True).option("compression", "gzip").partitionBy("account").csv(path)
    return rounded(read_holdings(spark, path))


REGISTRY["holdings_from_csv"] = _holdings_from_csv


# -- models ---------------------------------------------------------------------------------


@over_star("eligible_securities")
def eligible_securities(star: Star) -> DataFrame:
    return models.eligible_securities(inputs.late_returns(star))


@over_star("model_violations")
def model_violations(star: Star) -> DataFrame:
    names = star.portfolios.select(F.format_string("M%08d", "portfolio_id").alias("model"))
    empty = star.portfolios.select(F.format_string("Z%08d", "portfolio_id").alias("model"))
    return models.target_violations(
        inputs.broken_targets(star), star, names.unionByName(empty), max_holdings=inputs.MAX_HOLDINGS
    )


@over_star("model_violations_late")
def model_violations_late(star: Star) -> DataFrame:
    return model_violations(inputs.late_returns(star))


@over_star("model_tickers")
def model_tickers(star: Star) -> DataFrame:
    typed = inputs.targets(star).withColumn("ticker", F.lower("ticker"))
    return models.canonical_tickers(typed, star.securities)


@over_star("model_weights", 10)
def model_weights(star: Star) -> DataFrame:
    return models.checked_weights(inputs.targets(star), star)[1]


@over_star("model_weights_late", 10)
def model_weights_late(star: Star) -> DataFrame:
    return model_weights(inputs.late_returns(star))


@over_star("model_index", 6)
def model_index(star: Star) -> DataFrame:
    return models.total_return_index(star)


@over_star("model_index_late", 6)
def model_index_late(star: Star) -> DataFrame:
    return model_index(inputs.late_returns(star))


def _model_positions(rebalance: str) -> Callable[[Star], DataFrame]:
    def build(star: Star) -> DataFrame:
        _, weights = models.checked_weights(inputs.targets(star, rebalance), star)
        return models.model_holdings(weights, star).select(
            "account", "date", "ticker", "sector", "quantity", "price"
        )

    return build


for _rule in models.REBALANCES:
    over_star(f"model_positions_{_rule.lower()}", 6, quantity=3)(_model_positions(_rule))


@over_star("model_flow_check", 4)
def model_flow_check(star: Star) -> DataFrame:
    """Import of all models: they finance themselves, so no flow days."""
    return models.build_models(inputs.targets(star), star, sectors=inputs.sector_names(star))[1].summary


@over_star("equal_weights", 4)
def equal_weights(star: Star) -> DataFrame:
    held = star.positions_daily.select("portfolio_id", "security_id").distinct()
    picks = held.join(star.securities.select("security_id", "ticker"), "security_id").select(
        F.col("portfolio_id").cast("string").alias("model"), "ticker"
    )
    return models.equal_weights(picks)
