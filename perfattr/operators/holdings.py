"""Import of holdings files: validation, id minting, derived returns and flows.

Holdings hold (account, date, ticker, sector, quantity, price, dividend), one
row per ticker and trading day.  All accounts are imported at once; the result
equals importing them one after the other in the order of their names.  An
account that breaks a rule contributes nothing and does not block the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.operators.calendar import date_array, trading_calendar
from perfattr.operators.common import join_spread, number_rows, over_time
from perfattr.operators.graph import connected
from perfattr.sources.schemas import GICS_SECTORS
from perfattr.sources.star import Star
from perfattr.sources.storage import stored

MIN_FLOW = 0.01


@dataclass(frozen=True)
class ImportBatch:
    violations: DataFrame  # account, rule, n
    accounts: DataFrame  # account, portfolio_id, from_date, to_date
    security_map: DataFrame  # ticker, sector, existing_id, security_id, first_account
    deltas: dict[str, DataFrame]  # rows to append per star table
    summary: DataFrame


# -- validation ---------------------------------------------------------------


def _violation(df: DataFrame, rule: str, n: Column) -> DataFrame:
    return df.select("account", F.lit(rule).alias("rule"), n.cast("long").alias("n")).where(F.col("n") > 0)


def sector_claims(holdings: DataFrame) -> DataFrame:
    """(account, ticker, sector) with the number of rows and of unusable rows and the first and last date."""
    missing = F.lit(False)
    for name in ("date", "ticker", "quantity", "price"):
        missing = missing | F.col(name).isNull()
    return holdings.groupBy("account", "ticker", "sector").agg(
        F.count("*").alias("rows"),
        F.count_if(missing | (F.col("price") <= 0)).alias("unusable"),
        F.min("date").alias("from_date"),
        F.max("date").alias("to_date"),
    )


def account_days(holdings: DataFrame, dated: DataFrame | None = None) -> DataFrame:
    """(account, date) with the number of rows and of tickers that are repeated.

    Given `dated`, a table with the dates of the calendar, an account without repeated rows is worked out of one
    bit per series and date; only accounts that repeat a row or leave the calendar have their rows told apart.
    """
    if dated is not None:
        return _account_days_by_bits(holdings, dated)
    rows = holdings.groupBy("account", "date", "ticker").agg(F.count("*").alias("n"))
    return rows.groupBy("account", "date").agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated")
    )


def _account_days_by_bits(holdings: DataFrame, dated: DataFrame) -> DataFrame:
    """A series has a word per 64 dates of the calendar; if it has as many bits as rows, none is repeated."""
    places = trading_calendar(dated).select(
        "date", F.floor(F.col("idx") / 64).cast("int").alias("word"), (F.col("idx") % 64).cast("int").alias("bit")
    )
    series = stored(
        holdings.select("account", "date", "ticker")
        .join(F.broadcast(places), "date", "left")  # a row per date
        .groupBy("account", "ticker", "word")
        .agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    )
    unclear = F.col("word").isNull() | (F.bit_count("bits") < F.col("n"))
    mixed = stored(series.where(unclear).select("account").distinct())
    words = places.groupBy("word").agg(F.collect_list(F.struct("bit", "date")).alias("days"))
    days = (
        series.join(mixed, series["account"].eqNullSafe(mixed["account"]), "left_anti")
        .groupBy("account", "word", "bits")
        .agg(F.count("*").alias("tickers"))
        .join(F.broadcast(words), "word")
        .select("account", "tickers", F.inline(F.expr("filter(days, d -> getbit(bits, d.bit) = 1)")))
        .groupBy("account", "date")
        .agg(F.sum("tickers").alias("rows"), F.lit(0).cast("long").alias("repeated"))
    )
    if mixed.isEmpty():
        return days
    told = holdings.join(mixed, holdings["account"].eqNullSafe(mixed["account"]), "left_semi")
    return days.unionByName(account_days(told))


def _by_rule(df: DataFrame, found: dict[str, Column]) -> DataFrame:
    """One row per account and rule with a positive count."""
    rules = F.array(
        *(F.struct(F.lit(rule).alias("rule"), n.cast("long").alias("n")) for rule, n in found.items())
    )
    return df.select("account", F.inline(rules)).where(F.col("n") > 0)


def row_violations(claims: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """unknown_sector and missing_field, counted in rows."""
    unknown = F.col("sector").isNull() | ~F.col("sector").isin(list(sectors))
    counts = claims.groupBy("account").agg(
        F.sum(F.when(unknown, F.col("rows")).otherwise(0)).alias("unknown"),
        F.sum("unusable").alias("unusable"),
    )
    return _by_rule(counts, {"unknown_sector": F.col("unknown"), "missing_field": F.col("unusable")})


def unknown_sectors(holdings: DataFrame, sectors: Sequence[str]) -> DataFrame:
    """Every sector name that broke the rule, per account, with its number of rows."""
    unknown = holdings.where(F.col("sector").isNull() | ~F.col("sector").isin(list(sectors)))
    return unknown.groupBy("account", F.coalesce("sector", F.lit("<null>")).alias("sector")).agg(
        F.count("*").alias("n")
    )


def duplicate_violations(days: DataFrame) -> DataFrame:
    return _violation(days.groupBy("account").agg(F.sum("repeated").alias("k")), "duplicate_row", F.col("k"))


def account_shape(days: DataFrame, claims: DataFrame, star: Star) -> DataFrame:
    """Per account: rows, tickers, dates and how the dates sit on the trading calendar."""
    known_dates = star.benchmark_returns.select("date").distinct().withColumn("on_calendar", F.lit(True))
    dates = (
        days.join(known_dates, "date", "left")
        .groupBy("account")
        .agg(
            F.sum("rows").alias("rows"),
            F.count("date").alias("n_dates"),
            F.count_if(F.col("on_calendar")).alias("n_on_calendar"),
            F.min("date").alias("from_date"),
            F.max("date").alias("to_date"),
        )
    )
    tickers = (
        claims.where(F.col("ticker").isNotNull())
        .groupBy("account", "ticker")
        .agg((F.min("sector") != F.max("sector")).alias("many_sectors"))
        .groupBy("account")
        .agg(F.count("*").alias("n_tickers"), F.count_if("many_sectors").alias("n_many_sectors"))
    )
    trading_days = F.filter(
        "dates", lambda d: (d >= F.col("from_date")) & (d <= F.col("to_date"))
    )
    return (
        dates.join(tickers, "account", "left")
        .fillna(0, ["n_tickers", "n_many_sectors"])
        .withColumn("dates", date_array(star.benchmark_returns).scalar())
        .withColumn("n_trading_days", F.coalesce(F.size(trading_days), F.lit(0)))
        .drop("dates")
    )


def shape_violations(shape: DataFrame) -> DataFrame:
    """off_calendar, calendar_gap, incomplete_matrix and many_sectors."""
    return _by_rule(
        shape,
        {
            "off_calendar": F.col("n_dates") - F.col("n_on_calendar"),
            "calendar_gap": F.col("n_trading_days") - F.col("n_on_calendar"),
            "incomplete_matrix": F.abs(F.col("rows") - F.col("n_dates") * F.col("n_tickers")),
            "many_sectors": F.col("n_many_sectors"),
        },
    )


def master_conflicts(claims: DataFrame, securities: DataFrame) -> DataFrame:
    """Tickers whose sector differs from the security master's."""
    known = securities.select("ticker", F.col("sector").alias("known_sector"))
    clashes = claims.join(known, "ticker").where(F.col("sector") != F.col("known_sector"))
    per_account = clashes.groupBy("account").agg(F.countDistinct("ticker").alias("k"))
    return _violation(per_account, "sector_conflict", F.col("k"))


def empty_accounts(accounts: DataFrame, claims: DataFrame) -> DataFrame:
    return accounts.select("account").distinct().join(
        claims.select("account").distinct(), "account", "left_anti"
    ).select("account", F.lit("no_rows").alias("rule"), F.lit(1).cast("long").alias("n"))


def repeated_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts that are named more than once; their name would be ambiguous."""
    counts = accounts.groupBy("account").agg((F.count("*") - 1).alias("k"))
    return _violation(counts, "repeated_account", F.col("k"))


def _contested(claims: DataFrame) -> DataFrame:
    """Tickers claimed with more than one sector."""
    sectors = claims.groupBy("ticker").agg(F.min("sector").alias("lo"), F.max("sector").alias("hi"))
    return sectors.where(F.col("lo") != F.col("hi")).select("ticker")


def _settled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Accounts that contradict an accepted earlier one, with the number of such tickers.

    Rows (component, account, claims) come in the order of component and account.  What is kept
    is one sector per contested ticker of the component at hand.
    """
    component, sectors = None, {}
    for batch in rows:
        lost = []
        for number, account, claims in zip(*(batch.column(c).to_pylist() for c in ("component", "account", "claims"))):
            if number != component:
                component, sectors = number, {}
            clashes = {c["ticker"] for c in claims if sectors.get(c["ticker"], c["sector"]) != c["sector"]}
            if clashes:
                lost.append((account, len(clashes)))
            else:
                sectors.update((c["ticker"], c["sector"]) for c in claims)
        accounts, counts = zip(*lost) if lost else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(accounts, pa.string()), pa.array(counts, pa.int64())], ["account", "k"]
        )


def _earlier_claim_conflicts(claims: DataFrame, found: DataFrame, securities: DataFrame) -> DataFrame:
    """Otherwise valid accounts that give a new ticker another sector than an accepted earlier account.

    Only tickers with more than one sector matter; usually there are none.
    Whether an account is accepted depends on the ones before it, but only on those it
    is linked to by contested tickers: the accounts are cut into connected components, and
    each is settled by one pass over its accounts in name order.  An account that
    gives one ticker two sectors breaks a rule of its own and takes no part.
    """
    unknown = claims.select("account", "ticker", "sector").join(
        securities.select("ticker"), "ticker", "left_anti"
    )
    if _contested(unknown).isEmpty():
        return _violation(claims.select("account").limit(0), "sector_conflict", F.lit(0))
    mine = unknown.join(found, "account", "left_anti")
    contested = stored(mine.join(_contested(mine), "ticker", "left_semi"))
    node = F.xxhash64("account")
    first = contested.groupBy("ticker").agg(F.min("account").alias("first"))
    links = contested.join(first, "ticker").select(node.alias("a"), F.xxhash64("first").alias("b"))
    own = contested.groupBy("account").agg(
        F.array_sort(F.collect_list(F.struct("ticker", "sector"))).alias("claims")
    )
    placed = own.withColumn("a", node).join(connected(links), "a", "left")
    placed = placed.select(F.coalesce("component", "a").alias("component"), "account", "claims")
    ordered = placed.repartition("component").sortWithinPartitions("component", "account")
    lost = ordered.mapInArrow(_settled, "account string, k long")
    return _violation(lost, "sector_conflict", F.col("k"))


def find_violations(
    holdings: DataFrame,
    star: Star,
    accounts: DataFrame | None = None,
    sectors: Sequence[str] = GICS_SECTORS,
    claims: DataFrame | None = None,
) -> DataFrame:
    """(account, rule, n) for every broken rule; `accounts` lists those expected to have rows.

    `claims` are the stored sector claims of the holdings, if the caller has them.
    """
    claims = stored(sector_claims(holdings)) if claims is None else claims
    days = stored(account_days(holdings, star.benchmark_returns))
    found = (
        row_violations(claims, sectors)
        .unionByName(duplicate_violations(days))
        .unionByName(shape_violations(account_shape(days, claims, star)))
        .unionByName(master_conflicts(claims, star.securities))
    )
    if accounts is not None:
        found = found.unionByName(empty_accounts(accounts, claims)).unionByName(repeated_accounts(accounts))
    found = stored(found)
    return found.unionByName(_earlier_claim_conflicts(claims, found, star.securities))


# -- rows to append -------------------------------------------------------------


def accepted_accounts(claims: DataFrame, violations: DataFrame, star: Star) -> DataFrame:
    """Accounts without violations with a new portfolio id each, in name order."""
    spans = claims.groupBy("account").agg(
        F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date")
    )
    valid = stored(spans.join(violations, "account", "left_anti"))
    last_id = star.portfolios.agg(F.coalesce(F.max("portfolio_id"), F.lit(0)).alias("last_id")).scalar()
    return number_rows(valid, ["account"], "place").select(
        "account", (last_id + F.col("place")).alias("portfolio_id"), "from_date", "to_date"
    )


def map_securities(claims: DataFrame, accounts: DataFrame, star: Star) -> DataFrame:
    """Id of every imported ticker: the known one, or the next free one.

    New tickers are numbered by the first account that has them, then by name.
    """
    tickers = (
        claims.join(accounts.select("account"), "account", "left_semi")
        .groupBy("ticker")
        .agg(F.min("account").alias("first_account"), F.min("sector").alias("sector"))
    )
    known = star.securities.select("ticker", F.col("security_id").alias("existing_id"))
    mapped = tickers.join(known, "ticker", "left")
    last_id = star.securities.agg(F.coalesce(F.max("security_id"), F.lit(0)).alias("last_id")).scalar()
    unnumbered = stored(mapped.where(F.col("existing_id").isNull()))
    fresh = number_rows(unnumbered, ["first_account", "ticker"], "place")
    columns = ("ticker", "sector", "existing_id", "security_id", "first_account")
    return (
        mapped.where(F.col("existing_id").isNotNull())
        .withColumn("security_id", F.col("existing_id"))
        .select(*columns)
        .unionByName(fresh.withColumn("security_id", last_id + F.col("place")).select(*columns))
    )


def imported_positions(holdings: DataFrame, accounts: DataFrame, security_map: DataFrame) -> DataFrame:
    """Both tables are stored; a ticker may have a large part of all rows.

    An account becomes one portfolio: holdings that lie by account stay there, the accounts come to them.
    """
    named = holdings.join(accounts.select("account", "portfolio_id").hint("shuffle_hash"), "account")
    return (
        join_spread(named, security_map.select("ticker", "security_id"), "ticker", "account")
        .select(
            "date",
            "portfolio_id",
            "security_id",
            "quantity",
            "price",
            (F.col("quantity") * F.col("price")).alias("market_value"),
        )
    )


def imported_returns(holdings: DataFrame, security_map: DataFrame) -> DataFrame:
    """Total returns of new tickers, taken from the first account that holds them.

    Those are few accounts; the rows of the others are left out before tickers are looked at.
    """
    fresh = security_map.where(F.col("existing_id").isNull()).select(
        "ticker", "security_id", F.col("first_account").alias("account")
    )
    prior = F.lag("price").over(over_time("security_id"))
    return (
        holdings.join(fresh.select("account").distinct(), "account", "left_semi")
        .join(fresh, ["account", "ticker"])
        .select(
            "date",
            "security_id",
            (F.try_divide(F.col("price") + F.coalesce("dividend", F.lit(0.0)), prior) - 1).alias("ret"),
        )
        .where(F.col("ret").isNotNull())
    )


def estimated_flows(holdings: DataFrame, accounts: DataFrame, min_flow: float = MIN_FLOW) -> DataFrame:
    """(portfolio_id, date, cf): share changes valued at the prior close.

    Amounts up to `min_flow` either way are rounding of the delivered figures and no flow.  An account becomes one
    portfolio, so changes are taken and summed by account: holdings that lie by account stay where they are.
    """
    series = over_time("account", "ticker")
    changes = holdings.join(accounts.select("account"), "account", "left_semi").select(
        "account",
        "date",
        (F.col("quantity") - F.lag("quantity").over(series)).alias("dq"),
        F.lag("price").over(series).alias("p_prev"),
    )
    return (
        changes.where(F.col("dq").isNotNull())
        .groupBy("account", "date")
        .agg(F.sum(F.col("dq") * F.col("p_prev")).alias("cf"))
        .where(F.abs("cf") > min_flow)
        .join(accounts.select("account", "portfolio_id"), "account")
        .select("portfolio_id", "date", "cf")
    )


def import_summary(
    claims: DataFrame, accounts: DataFrame, security_map: DataFrame, flows: DataFrame, names: DataFrame | None
) -> DataFrame:
    """One row per accepted account."""
    sizes = claims.groupBy("account", "ticker").agg(F.sum("rows").alias("rows")).groupBy("account").agg(
        F.sum("rows").alias("position_rows"), F.count("*").alias("tickers")
    )
    minted = (
        security_map.where(F.col("existing_id").isNull())
        .groupBy(F.col("first_account").alias("account"))
        .agg(F.count("*").alias("new_securities"))
    )
    flow_days = flows.groupBy("portfolio_id").agg(F.count("*").alias("flow_days"))
    return (
        _named(accounts, names)
        .join(sizes, "account")
        .join(minted, "account", "left")
        .join(flow_days, "portfolio_id", "left")
        .select(
            "account",
            "portfolio_id",
            "name",
            "position_rows",
            "tickers",
            F.coalesce("new_securities", F.lit(0)).alias("new_securities"),
            "from_date",
            "to_date",
            F.coalesce("flow_days", F.lit(0)).alias("flow_days"),
        )
    )


def _named(accounts: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return accounts.withColumn("name", F.col("account").cast("string"))
    return accounts.join(names.select("account", "name"), "account", "left").withColumn(
        "name", F.coalesce("name", F.col("account").cast("string"))
    )


def import_holdings(
    holdings: DataFrame,
    star: Star,
    accounts: DataFrame | None = None,
    sectors: Sequence[str] = GICS_SECTORS,
    min_flow: float = MIN_FLOW,
) -> ImportBatch:
    """Validate all accounts and build the rows to append for the accepted ones.

    `accounts` may give (account, name) of every expected account.  The import
    runs in stages: claims, violations, portfolio ids and security ids are stored, as
    each is used several times; the rows to append are left to the caller.  Ids and sizes
    are made of the claims, a row per account and ticker.
    """
    claims = stored(sector_claims(holdings))
    violations = stored(find_violations(holdings, star, accounts, sectors, claims))
    accepted = stored(accepted_accounts(claims, violations, star))
    security_map = stored(map_securities(claims, accepted, star))
    flows = estimated_flows(holdings, accepted, min_flow)
    deltas = {
        "securities": security_map.where(F.col("existing_id").isNull()).select(
            "security_id", "ticker", "sector", F.lit("EQUITY").alias("asset_class")
        ),
        "portfolios": _named(accepted, accounts).select(
            "portfolio_id", "name", F.col("from_date").alias("inception_date"), F.lit("USD").alias("base_currency")
        ),
        "positions_daily": imported_positions(holdings, accepted, security_map),
        "benchmark_returns": imported_returns(holdings, security_map),
        "transactions": flows.select(
            "date",
            "portfolio_id",
            F.lit(None).cast("int").alias("security_id"),
            F.lit("CASHFLOW").alias("type"),
            F.lit(0.0).alias("quantity"),
            F.col("cf").alias("amount"),
        ),
    }
    summary = import_summary(claims, accepted, security_map, flows, accounts)
    return ImportBatch(violations, accepted, security_map, deltas, summary)
