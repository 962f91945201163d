"""The hand-worked star end to end, and the edge rules."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import day, make_star
from perfattr.operators import attribution, contribution, linking, quality, returns
from perfattr.operators.series import basis_returns
from perfattr.plans import marts
from perfattr.sources import star as stars
from perfattr.sources.periods import read_window, write_by_period


def test_valuations_and_twr(golden):
    rows = returns.sub_period_returns(returns.valuations(golden)).orderBy("date").collect()
    assert [r.rp for r in rows] == pytest.approx([0.01, 90 / 5060, 35 / 5150], abs=1e-12)
    assert [str(r.begin_date) for r in rows] == ["2024-01-02", "2024-01-03", "2024-01-04"]
    got = returns.twr(returns.valuations(golden)).first()
    assert got.twr == pytest.approx(3537 / 101200, abs=1e-12)
    assert got.twr_annualised is None


def test_valuation_window_keeps_prior_close(golden):
    rows = returns.valuations(golden, start="2024-01-04").orderBy("date").collect()
    assert str(rows[0].begin_date) == "2024-01-03" and len(rows) == 2


def test_benchmark_day(golden):
    assert returns.benchmark_days(golden).first().rb == pytest.approx(0.023, abs=1e-12)


def test_daily_effects(golden):
    rows = {r.sector: r for r in attribution.attribution_daily(golden).collect()}
    tech, energy = rows["Tech"], rows["Energy"]
    names = ("wp", "wb", "rp", "rb_i", "rb_total", "allocation", "selection", "interaction")
    assert [tech[c] for c in names] == pytest.approx([0.5, 0.6, 0, 0.025, 0.023, -0.0002, -0.015, 0.0025], abs=1e-12)
    assert [energy[c] for c in names] == pytest.approx([0.5, 0.4, 0.02, 0.02, 0.023, -0.0003, 0, 0], abs=1e-12)
    period = attribution.attribution_period(attribution.attribution_daily(golden))
    assert period.agg(F.sum("total")).first()[0] == pytest.approx(-0.013, abs=1e-12)


def test_contributions(golden):
    got = {r.ticker: r.contribution for r in contribution.contributions(golden).collect()}
    assert got == pytest.approx({"AAA": 0.0125, "BBB": -0.0125, "CCC": 0.005, "DDD": 0.005}, abs=1e-12)


def test_waterfall(golden):
    linked = linking.linked_attribution(attribution.held_sectors(golden))
    rows = marts.waterfall(linked).orderBy("step").collect()
    assert [r.label for r in rows] == ["Energy", "Tech", "Active return"]
    assert [r.bar_start for r in rows] == pytest.approx([0, -3, 0], abs=1e-9)
    assert [r.bar_end for r in rows] == pytest.approx([-3, -130, -130], abs=1e-9)


def test_linked_effects_reconcile(universe):
    held = attribution.held_sectors(universe, within_lifespan=True)
    total = linking.attribution_totals(linking.linked_attribution(held)).first()
    active = returns.active_returns(returns.day_returns(held)).first()
    assert total.total == pytest.approx(active.active_return, abs=1e-12)
    assert total.avg_wp == pytest.approx(1, abs=1e-12)


def test_window_of_periods_equals_full_scan(spark, universe, tmp_path):
    """Series with gaps, one of them over a whole period, another that ends before the window."""
    gone = "(security_id = 2 and date between '2024-01-10' and '2024-02-20') or (security_id = 3 and date > '2024-01-20')"
    star = universe.with_positions(universe.positions_daily.where(f"not ({gone})"))
    write_by_period(star.positions_daily, str(tmp_path / "p"), months=1)
    for args in (("2024-02-01", "2024-03-01"), ("2024-02-15", None), (None, "2024-02-10"), ("2025-01-01", "2025-02-01")):
        window = star.with_positions(read_window(spark, str(tmp_path / "p"), *args))
        full, short = (attribution.attribution_daily(s, *args) for s in (star, window))
        diff = quality.max_abs_diff(full, short, ["portfolio_id", "date", "sector"], ["wp", "rp", "allocation"]).first()
        assert diff.only_left == diff.only_right == 0 and (diff.max_abs_diff or 0) < 1e-15
    window = read_window(spark, str(tmp_path / "p"), "2024-02-15", "2024-03-01")
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(period") == 2 and len(window.inputFiles()) > 0
    assert window.where("date < '2024-02-01'").count() == 6  # one row per series


def test_windowed_attribution_equals_part_of_full(universe):
    full = attribution.attribution_daily(universe).where("date between '2024-02-01' and '2024-03-01'")
    part = attribution.attribution_daily(universe, "2024-02-01", "2024-03-01")
    diff = quality.max_abs_diff(full, part, ["portfolio_id", "date", "sector"], ["wp", "rp", "rb_total"]).first()
    assert diff.only_left == diff.only_right == 0 and diff.max_abs_diff < 1e-14


def test_unheld_and_sold_out_sectors(universe):
    """Without a basis of its own a sector has weight 0 and the benchmark's return."""
    sold = universe.positions_daily.withColumn(
        "market_value", F.when(F.col("security_id") > 4, 0.0).otherwise(F.col("market_value"))
    )
    unheld = universe.positions_daily.where("security_id <= 4")
    keys = ["portfolio_id", "date", "sector"]
    a = attribution.attribution_daily(universe.with_positions(sold))
    b = attribution.attribution_daily(universe.with_positions(unheld))
    diff = quality.max_abs_diff(a, b, keys, ["wp", "rp", "allocation", "selection", "interaction"]).first()
    assert diff.only_left == diff.only_right == 0 and diff.max_abs_diff < 1e-15
    row = b.where("sector = 'Utilities'").first()
    assert row.wp == 0 and row.rp == row.rb_i and row.selection == 0 and row.interaction == 0
    assert quality.invariant_violations(b).count() == 0


def test_sector_outside_benchmark_is_reported(universe):
    bare = replace(universe, benchmark_weights=universe.benchmark_weights.where("security_id > 2"))
    held, bench = attribution.portfolio_sectors(bare), attribution.benchmark_sectors(bare)
    missing = quality.uncovered_sectors(held, bench)
    assert {r.sector for r in missing.select("sector").distinct().collect()} == {"Energy"}
    assert quality.invariant_violations(attribution.attribution_daily(bare)).count() == 60


def test_holdings_without_return_leave_the_weights(universe):
    some = replace(universe, benchmark_returns=universe.benchmark_returns.where("security_id <> 1"))
    days = attribution.portfolio_sectors(some).groupBy("date").agg(F.sum("wp").alias("w")).collect()
    assert all(r.w == pytest.approx(1, abs=1e-12) for r in days)
    assert contribution.contributions(some).where("ticker = 'SEC001'").count() == 0


def test_lifespan_trims_fabricated_days(spark, universe):
    cut = universe.with_positions(universe.positions_daily.where("date between '2024-01-15' and '2024-02-15'"))
    daily = attribution.attribution_daily(cut, within_lifespan=True)
    first, last = daily.agg(F.min("date"), F.max("date")).first()
    assert (str(first), str(last)) == ("2024-01-16", "2024-02-15")
    assert attribution.attribution_daily(cut).select("date").distinct().count() == 60


def test_top_bottom_do_not_overlap(spark):
    few = spark.createDataFrame(
        [(1, f"T{i:02d}", "S", float(i)) for i in range(10)] + [(2, f"T{i:02d}", "S", float(i)) for i in range(4)]
        + [(3, f"T{i:02d}", "S", 1.0) for i in range(30)],
        "portfolio_id int, ticker string, sector string, contribution double",
    )
    rows = contribution.top_bottom(few).collect()
    side = {(p, s): sorted((r["rank"], r.ticker) for r in rows if r.portfolio_id == p and r.side == s)
            for p in (1, 2, 3) for s in ("top", "bottom")}
    assert [t for _, t in side[1, "top"]] == [f"T{i:02d}" for i in range(9, 1, -1)]
    assert [t for _, t in side[1, "bottom"]] == ["T00", "T01"]
    assert len(side[2, "top"]) == 4 and side[2, "bottom"] == []
    assert [t for _, t in side[3, "top"]] == [f"T{i:02d}" for i in range(8)]
    assert [t for _, t in side[3, "bottom"]] == [f"T{i:02d}" for i in range(29, 24, -1)]


def test_picked_portfolios(spark, golden):
    two = make_star(
        spark,
        securities=golden.securities.collect(),
        portfolios=[(1, "a", day("2024-01-02"), "USD"), (2, "b", day("2024-01-02"), "USD")],
        positions_daily=[tuple(r) for r in golden.positions_daily.collect()]
        + [(r.date, 2, r.security_id, r.quantity, r.price, r.market_value) for r in golden.positions_daily.collect()],
        benchmark_weights=golden.benchmark_weights.collect(),
        benchmark_returns=golden.benchmark_returns.collect(),
    )
    by_list = attribution.attribution_daily(two, portfolios=[2])
    by_table = attribution.attribution_daily(two, portfolios=spark.createDataFrame([(2,)], "portfolio_id int"))
    assert {r.portfolio_id for r in by_list.collect()} == {2} == {r.portfolio_id for r in by_table.collect()}
    assert attribution.attribution_daily(two).count() == 4


def test_plan_keeps_fact_out_of_single_task_and_cross_joins(universe):
    plan = attribution.attribution_daily(universe)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def without_broadcasts(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def test_beyond_the_broadcast_the_fact_moves_once(universe, tmp_path, spark, without_broadcasts):
    stars.write_star(universe, str(tmp_path / "star"))
    star = stars.read_star(spark, str(tmp_path / "star"))
    met = basis_returns(star)
    plan = plan_of(met)
    # One exchange between the fact's scan and the join, and that join is by security, not by date.
    joined = plan[plan.index("ShuffledHashJoin [security_id") :]
    joined = joined[: joined.index("FileScan")]
    assert joined.count("Exchange") == 1 and "date" not in joined.split("]")[0] and "BroadcastHashJoin" not in plan
    assert plan.count("ShuffledHashJoin") == 1 and "portfolio_id" not in plan.split("SortMergeJoin")[-1].split("]")[0]
    rows = attribution.attribution_over_period(star).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    assert "BroadcastHashJoin" in plan_of(basis_returns(star))
    assert len(rows) == 3
    for a, b in zip(sorted(rows), sorted(attribution.attribution_over_period(star).collect())):
        assert a.sector == b.sector and a.total == pytest.approx(b.total, abs=1e-14)


def test_linked_effects_make_no_row_per_portfolio_day_and_sector(universe):
    held = attribution.held_sectors(universe, within_lifespan=True)
    plan = linking.linked_attribution(held)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    keys = ("portfolio_id#", "sector#", "security_id#")
    by_date = [line for line in joins if "date#" in line and not any(key in line for key in keys)]
    assert joins and by_date == []
    spelt = linking.link_factors(returns.day_returns(held)).select("portfolio_id", "date", "factor")
    daily = attribution.attribution_daily(universe, within_lifespan=True).join(spelt, ["portfolio_id", "date"])
    effects = ["allocation", "selection", "interaction"]
    slow = daily.groupBy("portfolio_id", "sector").agg(
        *(F.sum(F.col("factor") * F.col(c)).alias(c) for c in effects), F.avg("wp").alias("avg_wp"), F.avg("wb").alias("avg_wb")
    )
    diff = quality.max_abs_diff(linking.linked_attribution(held), slow, ["portfolio_id", "sector"], [*effects, "avg_wp", "avg_wb"])
    assert diff.first().n_keys == 3 and diff.first().max_abs_diff < 1e-14


def test_unheld_sectors_and_days_are_linked(universe):
    """A portfolio that holds one sector for part of its life, next to days without any holding."""
    kept = "security_id in (1, 2) and date < '2024-02-01' or security_id = 5 and date > '2024-03-01'"
    star = universe.with_positions(universe.positions_daily.where(kept))
    held = attribution.held_sectors(star, within_lifespan=True)
    daily = attribution.attribution_daily(star, within_lifespan=True)
    days = daily.groupBy("portfolio_id", "date").agg(F.sum(F.col("wp") * F.col("rp")).alias("rp"), F.max("rb_total").alias("rb"))
    diff = quality.max_abs_diff(days, returns.day_returns(held), ["portfolio_id", "date"], ["rp", "rb"]).first()
    assert diff.n_keys > 30 and diff.only_left == diff.only_right == 0 and diff.max_abs_diff < 1e-15
    factors = linking.link_factors(days).select("portfolio_id", "date", "factor")
    slow = daily.join(factors, ["portfolio_id", "date"]).groupBy("portfolio_id", "sector").agg(
        F.sum(F.col("factor") * (F.col("allocation") + F.col("selection") + F.col("interaction"))).alias("total")
    )
    diff = quality.max_abs_diff(linking.linked_attribution(held), slow, ["portfolio_id", "sector"], ["total"]).first()
    assert diff.n_keys == 3 and diff.only_left == diff.only_right == 0 and diff.max_abs_diff < 1e-14
