"""The star derived from order lines: the fact is unfolded where it is read, and nothing of it moves."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from perfattr.operators import attribution, contribution, holdings, linking, models, returns
from perfattr.operators.series import by_calendar
from perfattr.plans import inputs, marts
from perfattr.plans.queries import REGISTRY
from perfattr.sources import periods, testdata
from perfattr.sources.storage import list_names, stored

# (part, supplier, quantity, price, day); part 3 has no row in the parts table.
LINES = [
    (1, 1, 10.0, 100.0, "1995-01-10"),
    (1, 1, 5.0, 80.0, "1995-01-20"),
    (1, 1, 5.0, 20.0, "1995-04-02"),
    (2, 1, 4.0, 64.0, "1995-02-01"),
    (2, 2, 4.0, 32.0, "1995-05-01"),
    (1, 2, 1.0, 9.0, "1995-03-31"),
    (3, 2, 1.0, 9.0, "1995-06-30"),
]


@pytest.fixture
def raw(spark, tmp_path):
    """A folder of raw tables of its own."""
    lines = [(p, s, q, x, datetime.fromisoformat(d)) for p, s, q, x, d in LINES]
    tables = {
        "lineitem": (lines, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"),
        "part": ([(1, "Brand#1", "STEEL"), (2, "Brand#2", "TIN")], "p_partkey long, p_brand string, p_type string"),
        "nation": ([(1, "Land")], "n_nationkey int, n_name string"),
        "supplier": ([(1, "One"), (2, "Two")], "s_suppkey long, s_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_repeat_the_last_buy(spark, raw):
    star = testdata.load(spark, raw).star
    got = {(r.portfolio_id, r.security_id, r.date): (r.quantity, r.price) for r in star.positions_daily.collect()}
    months = [date(1995, m, 1) for m in range(1, 7)]
    held = {(1, 1): [15, 15, 15, 20, 20, 20], (1, 2): [None, 4, 4, 4, 4, 4], (2, 1): [None, None, 1, 1, 1, 1], (2, 2): [None] * 4 + [4, 4]}
    assert {k: v[0] for k, v in got.items()} == {
        (*series, months[i]): q for series, row in held.items() for i, q in enumerate(row) if q is not None
    }
    assert got[1, 1, months[0]][1] == 12.0 and got[1, 1, months[5]][1] == 9.9375  # 180 and 209 paid for 15 and 21
    orders = star.transactions.where("type = 'BUY'")
    assert orders.count() == 5 and orders.agg(F.sum("quantity")).first()[0] == 29.0


def test_positions_are_not_stored_and_do_not_move(spark, raw):
    star = testdata.load(spark, raw).star
    folder = star.securities.inputFiles()[0].split("/star/securities")[0]
    assert "positions_daily" not in list_names(spark, f"{folder}/star")
    assert "Exchange hashpartitioning" not in plan(attribution.weight_basis(star))
    values = star.positions_daily.groupBy("portfolio_id", "date").agg(F.sum("market_value"))
    assert "Exchange hashpartitioning" not in plan(values)
    assert returns.valuations(star).count() == 5 + 3


def test_days_and_sectors_of_a_portfolio_stay_in_place(spark, raw):
    """Neither the held sectors nor the spelt out ones move by date: they meet the calendar by portfolio."""
    star = testdata.load(spark, raw).star
    held = attribution.held_sectors(star, within_lifespan=True)
    detail = marts.portfolio_detail(star, held)
    for df in (attribution.attribution_period(attribution.attribution_daily(star)), linking.linked_attribution(held), detail):
        assert "Exchange hashpartitioning(portfolio_id" in plan(df)  # a row per portfolio
        moved = [line for line in plan(df).splitlines() if "Exchange hashpartitioning(portfolio_id" in line]
        assert not any("date#" in line for line in moved)


def test_contributions_store_and_move_nothing(spark, raw):
    star = testdata.load(spark, raw).star
    found = contribution.contributions(star)
    assert "Exchange hashpartitioning(portfolio_id" not in plan(found) and not any("series-" in x for x in found.inputFiles())
    got = {(r.portfolio_id, r.ticker): r.contribution for r in found.collect()}
    basis = {(r.portfolio_id, r.security_id, r.date): r.basis for r in attribution.weight_basis(star).collect()}
    rets = {(r.security_id, r.date): r.ret for r in star.benchmark_returns.collect()}
    tickers = {r.security_id: r.ticker for r in star.securities.collect()}
    want = {}
    for (p, s, day), value in basis.items():
        total = sum(v for (q, _, d), v in basis.items() if (q, d) == (p, day))
        want[p, tickers[s]] = want.get((p, tickers[s]), 0.0) + value * rets[s, day] / total
    assert got == pytest.approx(want)


def test_kept_sectors_spare_scans_of_the_fact(spark, raw):
    """A detail of kept sectors equals one of sectors that are not, and unfolds the fact for the contributions alone."""
    star = testdata.load(spark, raw).star
    kept = attribution.held_sectors(star, within_lifespan=True, keep=True)
    assert "Generate explode(sequence" not in plan(kept.rows) + plan(kept.spans)
    detail = marts.portfolio_detail(star, kept)
    assert plan(detail).count("Generate explode(sequence") == 1
    assert sorted(map(repr, detail.collect())) == sorted(
        map(repr, marts.portfolio_detail(star, attribution.held_sectors(star, within_lifespan=True)).collect())
    )
    found = contribution.contributions(star, totals=kept.totals)
    fact = plan(found).split("Generate explode(sequence")[0]
    assert "ShuffledHashJoin [portfolio_id" in fact and "Exchange hashpartitioning" not in fact
    assert attribution.held_sectors(star, "1995-03-01", keep=True).totals is None  # not those of the whole fact


def test_calendar_days_meet_their_own_rows(spark):
    """Days off the calendar are left out, days and portfolios without rows are null."""
    spans = spark.createDataFrame([(1,), (1,), (2,), (None,)], "portfolio_id int")
    day = [date(2024, 1, d) for d in (1, 2, 5)]
    calendar = spark.createDataFrame([([(d, float(i)) for i, d in enumerate(day)],)], "days array<struct<date: date, rb: double>>")
    rows = [(1, day[1], "b"), (1, date(2024, 1, 3), "off"), (1, date(2023, 1, 1), "off"), (1, None, "off"), (1, day[2], "c"), (None, day[0], "none")]
    own = spark.createDataFrame(rows, "portfolio_id int, date date, own string")
    got = by_calendar(spans, calendar, own).collect()
    full = [(1, 0, day[0], None), (1, 1, day[1], "b"), (1, 2, day[2], "c")]
    rest = [(p, i, d, None) for p in (2, None) for i, d in enumerate(day)]
    assert sorted(((r.portfolio_id, r.idx, r.day.date, r.own) for r in got), key=str) == sorted(full * 2 + rest, key=str)
    assert by_calendar(spans, calendar.select(F.filter("days", lambda d: d["rb"] > 9).alias("days")), own).isEmpty()


def test_buckets_grow_with_the_lines(spark, raw, monkeypatch):
    monkeypatch.setattr(testdata, "BUCKET_LINES", 1)
    assert testdata.n_buckets(spark, raw) == len(LINES)


def test_holdings_stay_in_place_by_account(spark, raw):
    rows = inputs.holdings(spark, raw)
    assert rows.count() == 4 * 5  # every series on every month but the first
    for df in (holdings.sector_claims(rows), holdings.account_days(rows), rows.groupBy("account", "date", "ticker").count()):
        assert "Exchange hashpartitioning" not in plan(df)
    accounts = stored(spark.createDataFrame([("A00000001", 7), ("A00000002", 8)], "account string, portfolio_id int"))
    flows = holdings.estimated_flows(rows, accounts)
    assert "Window" in plan(flows)
    assert "Exchange hashpartitioning(account" not in plan(flows).split("Window")[1]  # below the lag
    # Only the buy of April is after the first month of the matrix in portfolio 7's first series.
    prices = {(r.ticker, r.date): r.price for r in rows.collect()}
    cf = {(r.portfolio_id, r.date): r.cf for r in flows.collect()}
    first = "STEEL-Brand#1"
    assert cf[7, date(1995, 4, 1)] == 5.0 * prices[first if (first, date(1995, 3, 1)) in prices else f"N-{first}", date(1995, 3, 1)]


def test_import_equals_its_figures_by_account(spark, raw):
    """Repeated rows, days and spans out of one table of days and the claims."""
    day = lambda n: date(1995, n, 1)
    schema = "account string, date date, ticker string, sector string, quantity double, price double, dividend double"
    rows = spark.createDataFrame(
        [
            ("A", day(1), "X", "S", 1.0, 1.0, None),
            ("A", day(1), "X", "S", 1.0, 1.0, None),
            ("A", day(1), None, "S", 1.0, 1.0, None),
            ("A", None, None, "S", 1.0, 1.0, None),
            ("A", None, None, "S", 1.0, 1.0, None),
            ("B", day(2), "X", "S", 1.0, 1.0, None),
            (None, day(3), "X", "S", 1.0, 1.0, None),
            (None, day(3), "X", "S", 1.0, 1.0, None),
        ],
        schema,
    )
    days = holdings.account_days(rows)
    assert {(r.account, r.date): (r.rows, r.repeated) for r in days.collect()} == {
        ("A", day(1)): (3, 1), ("A", None): (2, 1), ("B", day(2)): (1, 0), (None, day(3)): (2, 1)
    }
    assert {r.account: r.n for r in holdings.duplicate_violations(days).collect()} == {"A": 2, None: 1}
    claims = {(r.account, r.ticker): (r.rows, r.from_date, r.to_date) for r in holdings.sector_claims(rows).collect()}
    assert claims["A", None] == (3, day(1), day(1)) and claims["B", "X"] == (1, day(2), day(2))


def test_days_by_bits_equal_those_of_told_rows(spark):
    """Accounts that are whole, thin, repeated, off the calendar or without a name, over more dates than a word has bits."""
    days = [date(1990 + n // 12, n % 12 + 1, 1) for n in range(130)]
    dated = spark.createDataFrame([(d,) for d in days[:128]] + [(days[0],)], "date date")
    rows = [(a, d, t) for a in ("whole", "thin", "twice", "later", "off", None) for d in days[:128] for t in ("X", "Y", None)]
    rows = [r for r in rows if r[0] != "thin" or (r[1].month + len(r[2] or "")) % 4]
    rows += [("twice", days[63], "X"), ("twice", days[63], "X"), (None, days[64], None), ("off", days[129], "X")]
    rows += [("off", None, "X"), ("off", None, "X"), ("later", days[127], "Z")]
    table = spark.createDataFrame(rows, "account string, date date, ticker string")

    def found(df):
        return sorted((str(r.account), str(r.date), r.rows, r.repeated) for r in df.collect())

    assert found(holdings.account_days(table, dated)) == found(holdings.account_days(table))
    whole = table.where("account in ('whole', 'thin', 'later')")
    assert found(holdings.account_days(whole, dated)) == found(holdings.account_days(whole))
    assert found(holdings.account_days(whole.limit(0), dated)) == []
    by_bits = plan(holdings.account_days(whole, dated))
    assert "ticker#" not in by_bits  # nothing is grouped by date and ticker once the words are stored


def test_returns_unfold_the_first_accounts_alone(spark, raw):
    rows = inputs.holdings(spark, raw)
    known = stored(spark.createDataFrame([("N-STEEL-Brand#1", None, 9, "A00000001")], "ticker string, existing_id int, security_id int, first_account string"))
    assert "LeftSemi" in plan(holdings.imported_returns(rows, known)).split("Generate")[-1]  # below the unfolding


def test_csv_is_delivered_compressed(spark, raw):
    read = REGISTRY["holdings_from_csv"](spark, raw)
    assert all(f.endswith(".csv.gz") for f in read.inputFiles())
    assert sorted(map(repr, read.collect())) == sorted(map(repr, delivered(spark, raw)))


def delivered(spark, raw):
    return inputs.holdings(spark, raw).select("date", "ticker", "sector", "quantity", "price", F.round("dividend", 9).alias("dividend"), "account").collect()


def test_imported_rows_stay_by_account(spark, raw, monkeypatch):
    """Beyond the broadcast the accounts come to the holdings."""
    rows = inputs.holdings(spark, raw)
    accounts = stored(spark.createDataFrame([("A00000001", 7), ("A00000002", 8)], "account string, portfolio_id int"))
    tickers = [(t, n) for n, t in enumerate(sorted({r.ticker for r in rows.collect()}))]
    mapped = stored(spark.createDataFrame(tickers, "ticker string, security_id int"))
    monkeypatch.setattr("perfattr.operators.common.fits_broadcast", lambda small: "account" not in small.columns)
    found = holdings.imported_positions(rows, accounts, mapped)
    assert "Exchange hashpartitioning" not in plan(found).split("Generate explode(sequence")[0]
    assert found.count() == rows.count()


def test_days_of_a_model_are_not_stored(spark, raw):
    star = testdata.load(spark, raw).star
    _, weights = models.checked_weights(inputs.targets(star), star)
    rows = models.model_holdings(weights, star)
    flows = plan(holdings.estimated_flows(rows, stored(rows.select("account").distinct().withColumn("portfolio_id", F.lit(1)))))
    assert "Generate inline(path" in flows
    assert "Exchange hashpartitioning(account" not in flows.split("Window")[1]  # below the lag


def test_a_grown_star_moves_once(spark, raw):
    """Attribution of rows that lie by account and by portfolio: one move by portfolio, none by date."""
    star = testdata.load(spark, raw).star
    more = star.positions_daily.repartition(3, "date").withColumn("portfolio_id", F.col("portfolio_id") + 10)
    daily = attribution.portfolio_sectors(star.append({"positions_daily": more}).by_portfolio())
    moved = [line for line in plan(daily).splitlines() if "Exchange hashpartitioning(portfolio_id" in line]
    assert len(moved) == 1 and "REPARTITION_BY_COL" in moved[0]
    assert daily.count() == 2 * attribution.portfolio_sectors(star).count()


def test_periods_are_written_in_place(spark, raw, tmp_path, monkeypatch):
    star = testdata.load(spark, raw).star
    plans, write = [], periods._write

    def watched(rows, path):
        plans.append(plan(rows))
        write(rows, path)

    monkeypatch.setattr(periods, "_write", watched)
    periods.write_by_period(star.positions_daily, str(tmp_path / "p"), months=2)
    assert len(plans) == 2 and not any("Exchange hashpartitioning(portfolio_id" in p or "rangepartitioning" in p for p in plans)
    window = periods.read_window(spark, str(tmp_path / "p"), "1995-05-01", "1995-06-01")
    full = attribution.weight_basis(star, "1995-05-01", "1995-06-01").collect()
    assert sorted(attribution.weight_basis(star.with_positions(window), "1995-05-01", "1995-06-01").collect()) == sorted(full)
