"""Days without a figure are never passed over, and nothing is cut by size."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import day
from perfattr.functions import measures as m
from perfattr.operators import attribution, contribution, linking, models, quality, returns, risk
from perfattr.operators.common import number_rows
from perfattr.operators.holdings import find_violations, unknown_sectors
from perfattr.plans import marts
from perfattr.sources import batches
from perfattr.sources import star as stars
from perfattr.sources.schemas import GICS_SECTORS
from perfattr.sources.storage import application_folder, clear, exists, stored
from test_holdings import frame, golden_rows

DAYS = "portfolio_id int, date date, begin_date date, mv_begin double, mv_end double, cf double"


def test_full_withdrawal_leaves_no_linked_return(spark):
    rows = [
        (1, day("2024-01-03"), day("2024-01-02"), 100.0, 110.0, 0.0),
        (1, day("2024-01-04"), day("2024-01-03"), 110.0, 0.0, -110.0),
        (1, day("2024-01-05"), day("2024-01-04"), 100.0, 110.0, 0.0),
        (2, day("2024-01-03"), day("2024-01-02"), 100.0, 110.0, 0.0),
    ]
    found = {r.portfolio_id: r for r in returns.twr(spark.createDataFrame(rows, DAYS)).collect()}
    assert found[1].twr is None and (found[1].n_days, found[1].bad_days) == (3, 1)
    assert found[2].twr == pytest.approx(0.1) and found[2].bad_days == 0


def geared(universe, date, returns_):
    held = attribution.held_sectors(universe)
    rp = F.when(F.col("date") == date, returns_).otherwise(F.col("rp"))
    return replace(held, rows=held.rows.withColumn("rp", rp))


def test_unlinkable_day_leaves_no_linked_effects(universe):
    linked = linking.linked_attribution(geared(universe, "2024-02-01", F.lit(-2.5))).collect()
    assert len(linked) == 3 and all(r.selection is None and r.total is None and r.unlinked_days == 1 for r in linked)
    whole = linking.linked_attribution(attribution.held_sectors(universe)).collect()
    assert all(r.total is not None and r.unlinked_days == 0 for r in whole)


def test_risk_of_undefined_days_is_undefined(spark):
    rows = [(p, day(f"2024-01-{d:02d}"), None if (p, d) == (1, 4) else 0.01 * d, 0.01) for p in (1, 2) for d in range(2, 9)]
    days = spark.createDataFrame(rows, "portfolio_id int, date date, rp double, rb double")
    found = {r.portfolio_id: r for r in risk.risk_summary(days).collect()}
    assert [found[1][c] for c in ("twr", "te", "ir", "max_drawdown")] == [None] * 4
    assert None not in (found[2].twr, found[2].te, found[2].ir, found[2].max_drawdown)
    curve = [r.cum_rp for r in risk.curves(days).where("portfolio_id = 1").orderBy("date").collect()]
    assert [x is None for x in curve] == [False, False] + [True] * 5
    rolling = risk.rolling_tracking_error(days, window=3).where("portfolio_id = 1").orderBy("date").collect()
    assert [r.rolling_te is None for r in rolling] == [True, True, True, True, True, False, False]


def test_each_series_is_linked_over_its_own_days(universe):
    holes = replace(
        universe, benchmark_weights=universe.benchmark_weights.where("date not between '2024-02-01' and '2024-02-10'")
    )
    full, part = (marts.performance_summary(s).first() for s in (universe, holes))
    assert part.twr == pytest.approx(full.twr) and part.n_days == full.n_days == 60
    assert part.bench_twr != pytest.approx(full.bench_twr)
    days = returns.market_value_days(holes)
    assert returns.active_returns(days).first().twr == pytest.approx(full.twr)
    gaps = quality.return_gap(returns.valuations(holes), attribution.held_sectors(holes)).collect()
    assert len(gaps) == 60 and sum(r.only == "value" for r in gaps) == 7


@pytest.mark.parametrize("span", [(None, None), ("2024-02-01", "2024-03-01")])
def test_period_without_spine_equals_the_sum_of_days(universe, span):
    sold = universe.with_positions(
        universe.positions_daily.where("security_id <> 3").withColumn(
            "market_value", F.when(F.col("security_id") > 4, 0.0).otherwise(F.col("market_value"))
        )
    )
    for star in (universe, sold, universe.with_positions(universe.positions_daily.where("date < '2024-02-10'"))):
        slow = attribution.attribution_period(attribution.attribution_daily(star, *span))
        fast = attribution.attribution_over_period(star, *span)
        diff = quality.max_abs_diff(
            slow, fast, ["portfolio_id", "sector"], ["avg_wp", "avg_wb", "allocation", "selection", "interaction", "total"]
        ).first()
        assert diff.n_keys == 3 and diff.only_left == diff.only_right == 0 and diff.max_abs_diff < 1e-14


def test_contributions_have_no_window_over_the_fact(universe):
    plan = contribution.contributions(universe)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 2  # the prior close, once for each branch


def test_every_unknown_sector_is_reported(spark):
    rows = [("acc", day("2024-01-03"), f"T{k}", f"Sector {k % 9}", 1.0, 1.0, None) for k in range(18)]
    found = unknown_sectors(frame(spark, rows), GICS_SECTORS).collect()
    assert len(found) == 9 and all(r.n == 2 for r in found)


def test_an_account_named_twice_is_a_violation(spark, universe):
    names = spark.createDataFrame([("golden", "a"), ("golden", "b"), ("other", "c")], "account string, name string")
    rows = [("golden", *r[1:]) for r in golden_rows()]
    found = {(r.account, r.rule): r.n for r in find_violations(frame(spark, rows), universe, names).collect()}
    assert found[("golden", "repeated_account")] == 1 and ("other", "repeated_account") not in found


TARGETS = "model string, ticker string, weight double, rebalance string"


def test_models_of_any_size_and_every_rule(spark, universe):
    rows = [("a", f"SEC{k:03d}", 100 / 6, "NONE") for k in range(1, 7)]
    rows += [("b", "SEC001", 60.0, "YEARLY"), ("b", "SEC002", 40.0, "YEARLY")]
    rows += [("c", "SEC001", 60.0, "NONE"), ("c", "SEC002", 40.0, "MONTHLY")]
    rows += [("d", "sec001", 60.0, "MONTHLY"), ("d", "Sec002", 40.0, "MONTHLY")]
    targets = spark.createDataFrame(rows, TARGETS)
    found = {(r.model, r.rule): r.n for r in models.target_violations(targets, universe).collect()}
    assert found[("b", "unknown_rebalance")] == 2 and found[("c", "mixed_rebalance")] == 1
    assert not any(rule == "too_many_holdings" for _, rule in found) and ("a", "mixed_rebalance") not in found
    limited = models.target_violations(targets, universe, max_holdings=5).where("rule = 'too_many_holdings'").collect()
    assert [(r.model, r.n) for r in limited] == [("a", 1)]
    sectors = [r.sector for r in universe.securities.select("sector").distinct().collect()]
    violations, batch = models.build_models(targets, universe, sectors=sectors)
    assert {r.model for r in violations.collect()} == {"b", "c"}
    assert sorted(r.account for r in batch.summary.collect()) == ["a", "d"]


def test_undefined_figures_are_not_exported(universe, tmp_path):
    spoilt = replace(universe, benchmark_returns=universe.benchmark_returns.withColumn("ret", F.lit(float("nan"))))
    with pytest.raises(ValueError, match="not finite"):
        marts.export_marts(spoilt, str(tmp_path / "marts"))
    assert not (tmp_path / "marts").exists()


def test_stale_imports_are_refused(spark, universe, tmp_path):
    root = str(tmp_path / "lake")
    batches.publish(spark, universe.tables(), root, "base", base=0)
    few = {"securities": universe.securities.limit(1)}
    read = batches.version(spark, root)
    batches.publish(spark, few, root, "one", base=read)
    with pytest.raises(ValueError, match="made against version 1"):
        batches.publish(spark, few, root, "two", base=read)
    # A star's own files are ranges of series; published ones are buckets.
    stars.write_star(universe, str(tmp_path / "star"))
    files = [f for f in (tmp_path / "star" / "positions_daily").iterdir() if f.suffix == ".parquet"]
    spans = []
    for f in files:
        r = spark.read.parquet(str(f)).agg(F.min("security_id"), F.max("security_id")).first()
        spans.append(tuple(r))
    spans.sort()
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_rows_are_numbered_in_order(spark):
    rows = stored(spark.range(1000).selectExpr("(id * 37) % 1000 as k"))
    for splitters in (None, 1, 50):
        assert all(r.n == r.k + 1 for r in number_rows(rows, ["k"], "n", splitters).collect())


def test_linked_needs_every_return(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.1), (2, None)], "k int, r double")
    found = {r.k: (r.a, r.b) for r in df.groupBy("k").agg(
        m.linked(F.col("r")).alias("a"), m.linked_present(F.col("r")).alias("b")).collect()}
    assert found[1] == pytest.approx((0.32, 0.32)) and found[2][0] is None and found[2][1] == pytest.approx(0.1)


def test_intermediate_tables_lie_in_the_applications_folder(spark):
    """The folder is registered for removal at the end; clearing removes it at once."""
    other = spark.newSession()
    path = application_folder(other)
    assert path.endswith(spark.sparkContext.applicationId)
    kept = stored(other.range(3).toDF("k"))
    assert exists(spark, path) and kept.count() == 3
    clear(spark)
    assert not exists(spark, path) and stored(other.range(3)).count() == 3
