"""Import of holdings: ids, derived rows, every rejection, many accounts at once."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import day, weekdays
from perfattr.operators import attribution, holdings, quality, returns
from perfattr.operators.common import number_rows
from perfattr.operators.graph import connected
from perfattr.operators.holdings import import_holdings, unknown_sectors
from perfattr.sources.schemas import GICS_SECTORS
from perfattr.sources.storage import stored

DAYS = weekdays(day("2024-01-02"), 60)
SCHEMA = "account string, date date, ticker string, sector string, quantity double, price double, dividend double"


def golden_rows(account="A", tech="AAPL"):
    """Two tickers over ten days; the first one's quantity jumps on the sixth."""
    rows = []
    for i, d in enumerate(DAYS[1:11]):
        rows.append((account, d, tech, "Information Technology", 150.0 if i >= 5 else 100.0, 100.0 + i, 0.0))
        rows.append((account, d, "XOM", "Energy", 200.0, 50.0 + 0.5 * i, 0.25 if i == 3 else None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rules(spark, universe, rows, accounts=None):
    found = import_holdings(frame(spark, rows), universe, accounts).violations.collect()
    return {(r.account, r.rule): r.n for r in found}


def test_golden_import(spark, universe):
    batch = import_holdings(frame(spark, golden_rows()), universe)
    assert batch.violations.count() == 0
    got = batch.summary.first()
    assert (got.portfolio_id, got.position_rows, got.tickers, got.new_securities, got.flow_days) == (2, 20, 2, 2, 1)
    assert (got.from_date, got.to_date) == (DAYS[1], DAYS[10])
    flow = batch.deltas["transactions"].first()
    assert flow.amount == pytest.approx(50 * 104.0, abs=1e-9) and flow.date == DAYS[6]
    assert flow.security_id is None and flow.type == "CASHFLOW"
    assert batch.deltas["benchmark_returns"].count() == 18
    ids = {r.ticker: r.security_id for r in batch.security_map.collect()}
    assert ids == {"AAPL": 7, "XOM": 8}
    paid = batch.deltas["benchmark_returns"].where((F.col("security_id") == 8) & (F.col("date") == DAYS[4])).first()
    assert paid.ret == pytest.approx((51.5 + 0.25) / 51.0 - 1, abs=1e-12)
    grown = universe.append(batch.deltas)
    assert returns.valuations(grown, portfolios=[2]).count() == 9
    daily = attribution.attribution_daily(grown, DAYS[2], DAYS[10], portfolios=[2])
    gaps = quality.invariant_gaps(daily).collect()
    assert len(gaps) == 9 and all(abs(g.effect_gap) < 1e-10 for g in gaps)


def test_import_again_reuses_ids(spark, universe):
    first = import_holdings(frame(spark, golden_rows()), universe)
    again = import_holdings(frame(spark, golden_rows("B")), universe.append(first.deltas))
    got = again.summary.first()
    assert (got.portfolio_id, got.new_securities) == (3, 0)
    assert again.deltas["benchmark_returns"].count() == 0 and again.deltas["securities"].count() == 0
    ids = {r.ticker: r.security_id for r in again.security_map.collect()}
    assert ids == {"AAPL": 7, "XOM": 8}


def test_every_rule_rejects(spark, universe):
    def changed(account, change):
        return [r for old in golden_rows(account) for r in change(old)]

    gap_day = DAYS[5]
    rows = (
        golden_rows("good")
        + changed("sector", lambda r: [(*r[:3], "Petroleum" if r[2] == "XOM" else r[3], *r[4:])])
        + changed("gap", lambda r: [] if r[1] == gap_day else [r])
        + changed("hole", lambda r: [] if r[1] == gap_day and r[2] == "XOM" else [r])
        + changed("price", lambda r: [(*r[:5], -5.0 if r[5] == 109.0 else r[5], r[6])])
        + changed("null", lambda r: [(*r[:4], None if r[1] == gap_day else r[4], *r[5:])])
        + changed("twice", lambda r: [r, r] if r[1] == gap_day and r[2] == "XOM" else [r])
        + changed("weekend", lambda r: [(r[0], day("2024-01-13") if r[1] == DAYS[10] else r[1], *r[2:])])
        + changed("two", lambda r: [(*r[:3], "Utilities" if r[1] == gap_day and r[2] == "XOM" else r[3], *r[4:])])
        + [(*r[:2], "SEC001" if r[2] == "XOM" else r[2], "Utilities" if r[2] == "XOM" else r[3], *r[4:])
           for r in golden_rows("master")]
    )
    accounts = spark.createDataFrame([("good", "Good one"), ("empty", "Nothing")], "account string, name string")
    batch = import_holdings(frame(spark, rows), universe, accounts)
    found = {(r.account, r.rule): r.n for r in batch.violations.collect()}
    assert found == {
        ("sector", "unknown_sector"): 10,
        ("gap", "calendar_gap"): 1,
        ("hole", "incomplete_matrix"): 1,
        ("price", "missing_field"): 1,
        ("null", "missing_field"): 2,
        ("twice", "duplicate_row"): 1,
        ("twice", "incomplete_matrix"): 1,
        ("weekend", "off_calendar"): 1,
        ("two", "many_sectors"): 1,
        ("master", "sector_conflict"): 1,
        ("empty", "no_rows"): 1,
    }
    assert [(r.account, r.name) for r in batch.summary.collect()] == [("good", "Good one")]
    assert batch.deltas["positions_daily"].count() == 20 and batch.deltas["portfolios"].count() == 1
    found = unknown_sectors(frame(spark, rows), GICS_SECTORS).collect()
    assert [(r.account, r.sector) for r in found] == [("sector", "Petroleum")]


def one_ticker(account, claims):
    return [(account, DAYS[t], ticker, sector, 1.0, 10.0 + t, None) for t in (1, 2, 3) for ticker, sector in claims]


def test_accounts_as_if_imported_one_by_one(spark, universe):
    """A conflict with an account that was itself rejected does not count."""
    rows = (
        one_ticker("a", [("P", "Energy"), ("Q", "Energy")])
        + one_ticker("b", [("P", "Utilities"), ("R", "Utilities")])  # loses P to a
        + one_ticker("c", [("R", "Materials")])  # R is free, as b was rejected
        + one_ticker("d", [("R", "Utilities"), ("Q", "Energy")])  # loses R to c
        + one_ticker("e", [("Q", "Energy"), ("S", "Energy")])
    )
    batch = import_holdings(frame(spark, rows), universe)
    assert {(r.account, r.rule, r.n) for r in batch.violations.collect()} == {
        ("b", "sector_conflict", 1),
        ("d", "sector_conflict", 1),
    }
    ids = {r.account: r.portfolio_id for r in batch.accounts.collect()}
    assert ids == {"a": 2, "c": 3, "e": 4}
    mapped = {r.ticker: (r.security_id, r.first_account, r.sector) for r in batch.security_map.collect()}
    assert mapped == {
        "P": (7, "a", "Energy"), "Q": (8, "a", "Energy"), "R": (9, "c", "Materials"), "S": (10, "e", "Energy"),
    }
    assert batch.deltas["benchmark_returns"].count() == 4 * 2


def test_many_accounts_equal_sequential_imports(spark, universe):
    rows = golden_rows("A") + golden_rows("B", "MSFT") + golden_rows("C")
    batch = import_holdings(frame(spark, rows), universe)
    star = universe
    for account in "ABC":
        star = star.append(import_holdings(frame(spark, [r for r in rows if r[0] == account]), star).deltas)
    merged = universe.append(batch.deltas)
    for name, table in merged.tables().items():
        other = star.tables()[name]
        assert table.exceptAll(other).count() == 0 and other.exceptAll(table).count() == 0, name


def test_number_rows_is_dense_and_ordered(spark):
    keys = spark.range(5000).select(F.format_string("K%06d", (F.col("id") * 7919) % 100003).alias("key"))
    rows = number_rows(keys, ["key"], "n", splitters=16).orderBy("key").collect()
    assert [r.n for r in rows] == list(range(1, 5001))
    assert number_rows(keys.limit(0), ["key"], "n").count() == 0


def settled(claims):
    """Accounts in order: the first claim of a ticker by an accepted account holds."""
    known, lost = {}, {}
    for account in sorted({a for a, _, _ in claims}):
        own = [(t, s) for a, t, s in claims if a == account]
        clashes = sum(known.get(t, s) != s for t, s in own)
        if clashes:
            lost[account] = clashes
        else:
            known.update(own)
    return lost


def conflicts(spark, universe, claims):
    rows = spark.createDataFrame(claims, "account string, ticker string, sector string")
    found = spark.createDataFrame([], "account string, rule string, n long")
    got = holdings._earlier_claim_conflicts(rows, found, universe.securities).collect()
    assert all(r.rule == "sector_conflict" for r in got)
    return {r.account: r.n for r in got}


def test_a_chain_of_a_thousand_accounts_is_settled_in_few_jobs(spark, universe):
    """Every account contradicts the one before it, so every other one is accepted."""
    claims = [(f"A{k:04d}", f"T{k}", "Energy") for k in range(1000)] + [(f"A{k:04d}", f"T{k - 1}", "Utilities") for k in range(1, 1000)]
    spark.sparkContext.setJobGroup("chain", "chain")
    got = conflicts(spark, universe, claims)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert got == settled(claims) == {f"A{k:04d}": 1 for k in range(1, 1000, 2)}
    assert jobs < 200


def test_many_contested_tickers(spark, universe):
    draw = random.Random(4)
    claims = sorted({(f"A{draw.randrange(40):02d}", f"T{draw.randrange(60)}"): draw.choice(["Energy", "Energy", "Utilities"]) for _ in range(160)}.items())
    claims = [(a, t, s) for (a, t), s in claims] + [("A00", "SEC001", "Energy"), ("A01", "SEC001", "Utilities")]
    expected = settled([c for c in claims if c[1] != "SEC001"])
    assert conflicts(spark, universe, claims) == expected and 3 < len(expected) < 35


def test_connected_components(spark):
    draw = random.Random(9)
    label = [draw.getrandbits(60) for _ in range(400)]
    pairs = [(label[k], label[k + 1]) for k in range(0, 299) if k % 100 != 99] + [(label[350], label[351]), (label[360], label[360])]
    found = {r.a: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(found) == 302 and len(set(found.values())) == 4
    assert all(found[a] == found[b] for a, b in pairs if a != b)


def test_positions_of_a_hot_ticker_are_spread(spark, universe):
    """Beyond the broadcast the tasks that share a ticker have copies of its row."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    rows = [(f"A{k}", DAYS[1], "HOT", "Energy", 1.0, 2.0, None) for k in range(300)]
    accounts = stored(spark.createDataFrame([(f"A{k}", k) for k in range(300)], "account string, portfolio_id int"))
    mapped = stored(spark.createDataFrame([("HOT", 7)], "ticker string, security_id int"))
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    try:
        got = holdings.imported_positions(frame(spark, rows), accounts, mapped)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(ticker" in plan and "_salt" in plan.split("hashpartitioning(ticker")[1][:60]
        assert got.count() == 300 and got.where("security_id = 7").count() == 300
        placed = got.groupBy(F.spark_partition_id().alias("p")).count()
        assert placed.agg(F.max("count")).first()[0] < 200
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
