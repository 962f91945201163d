"""Formulas on columns: hand-worked values and random identities."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import day, weekdays
from perfattr.functions import measures as m
from perfattr.operators import attribution, calendar, linking, quality, returns, risk


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def days_frame(spark, series):
    """(portfolio_id, date, rp, rb) of lists of (rp, rb)."""
    dates = weekdays(day("2024-01-01"), max(len(s) for s in series.values()))
    rows = [(pid, dates[t], rp, rb) for pid, s in series.items() for t, (rp, rb) in enumerate(s)]
    return spark.createDataFrame(rows, "portfolio_id int, date date, rp double, rb double")


def by_id(df):
    return {r.portfolio_id: r for r in df.collect()}


def test_annualised_boundaries(spark):
    assert value(spark, m.annualised(F.lit(0.10), F.lit(364))) is None
    assert value(spark, m.annualised(F.lit(0.10), F.lit(365))) is not None
    assert value(spark, m.annualised(F.lit(0.21), F.lit(731))) == pytest.approx(1.21 ** (365.25 / 731) - 1, abs=1e-12)


def test_sub_period_return(spark):
    ok = m.sub_period_return(F.lit(4000.0), F.lit(4040.0), F.lit(0.0))
    assert value(spark, ok) == pytest.approx(0.01, abs=1e-15)
    assert value(spark, m.sub_period_return(F.lit(100.0), F.lit(0.0), F.lit(-100.0))) is None
    with pytest.raises(Exception, match="non-positive basis"):
        value(spark, m.sub_period_return(F.lit(100.0), F.lit(0.0), F.lit(-100.0), strict=True))


@pytest.mark.parametrize("gap, tolerance", [(0.0, 1e-12), (1e-15, 1e-9), (-1e-15, 1e-9), (1e-8, 1e-7)])
def test_coefficient_limit(spark, gap, tolerance):
    got = value(spark, m.carino_coefficient(F.lit(0.05), F.lit(0.05 + gap)))
    assert got == pytest.approx(1 / 1.05, abs=tolerance)


def test_coefficient_needs_returns_above_total_loss(spark):
    assert value(spark, m.carino_coefficient(F.lit(-1.0), F.lit(0.1))) is None
    assert value(spark, m.carino_coefficient(F.lit(0.1), F.lit(-1.2))) is None


def test_link_factors_worked_example(spark):
    days = days_frame(spark, {1: [(0.10, 0.05), (-0.02, 0.01)]})
    rows = linking.link_factors(days).orderBy("date").collect()
    assert [r.k_day for r in rows] == pytest.approx([0.930400312698, 1.005101272356], abs=1e-12)
    assert rows[0].k_period == pytest.approx(0.935255855097, abs=1e-12)
    assert [r.factor for r in rows] == pytest.approx([0.994808327183, 1.074680545305], abs=1e-12)


def test_linked_actives_sum_to_difference_of_cumulative_returns(spark):
    rng = random.Random(5)
    series = {
        pid: [(rng.uniform(-0.08, 0.08), rng.uniform(-0.08, 0.08)) for _ in range(rng.randint(2, 120))]
        for pid in range(60)
    }
    series[60] = [(0.01, 0.01)] * 10
    got = by_id(
        linking.link_factors(days_frame(spark, series))
        .groupBy("portfolio_id")
        .agg(F.sum(F.col("factor") * (F.col("rp") - F.col("rb"))).alias("linked"))
    )
    for pid, s in series.items():
        active = math.prod(1 + p for p, _ in s) - math.prod(1 + b for _, b in s)
        assert got[pid].linked == pytest.approx(active, abs=1e-12)


def test_risk_worked_examples(spark):
    series = {
        1: [(a, 0.0) for a in (0.01, -0.01, 0.01, -0.01)],
        2: [(a, 0.0) for a in (0.002, 0.001, 0.003, 0.000)],
        3: [(0.0, 0.0)] * 3,
        4: [(0.10, 0.0), (-0.10, 0.0), (0.0606060606060606, 0.0)],
        5: [(0.01, 0.0), (0.02, 0.0), (0.0, 0.0)],
        6: [(0.01, 0.0)],
    }
    got = by_id(risk.risk_summary(days_frame(spark, series)))
    assert got[1].te == pytest.approx(0.183303027798, abs=1e-12)
    assert got[2].te == pytest.approx(0.020493901532, abs=1e-12)
    assert got[2].ir == pytest.approx(18.444511378727, abs=1e-9)
    assert got[3].ir is None and got[3].te == 0
    assert got[4].max_drawdown == pytest.approx(-0.10, abs=1e-12)
    assert got[5].max_drawdown == 0.0
    assert got[6].te is None and got[6].ir is None


def test_drawdown_bounds_and_curves(spark):
    rng = random.Random(9)
    series = {p: [(rng.uniform(-0.08, 0.08), 0.01) for _ in range(rng.randint(2, 90))] for p in range(40)}
    days = days_frame(spark, series)
    got = by_id(risk.risk_summary(days))
    ends = by_id(risk.curves(days).groupBy("portfolio_id").agg(F.max_by("cum_rp", "date").alias("end")))
    for pid, s in series.items():
        growth = peak = 1.0
        worst = 0.0
        for rp, _ in s:
            growth *= 1 + rp
            peak = max(peak, growth)
            worst = min(worst, growth / peak - 1)
        assert got[pid].max_drawdown == pytest.approx(worst, abs=1e-12)
        assert -1 < got[pid].max_drawdown <= 0
        assert ends[pid].end == pytest.approx(growth - 1, abs=1e-12)


def test_rolling_tracking_error(spark):
    rng = random.Random(3)
    series = {1: [(rng.uniform(-0.02, 0.02), 0.0) for _ in range(70)], 2: [(0.01, 0.0), (0.02, 0.0)], 3: [(0.01, 0.0)]}
    rows = risk.rolling_tracking_error(days_frame(spark, series)).orderBy("portfolio_id", "date").collect()
    te = {p: [r.rolling_te for r in rows if r.portfolio_id == p] for p in series}
    assert te[1][:62] == [None] * 62 and None not in te[1][62:]
    window = [rp for rp, _ in series[1][7:70]]
    mean = sum(window) / 63
    expected = math.sqrt(sum((x - mean) ** 2 for x in window) / 62) * math.sqrt(252)
    assert te[1][69] == pytest.approx(expected, abs=1e-12)
    assert te[2][0] is None and te[2][1] is not None
    assert te[3] == [None]


def test_effects_sum_to_active_return(spark):
    """Random sectors: the three effects add up to the active return of every day."""
    rng = random.Random(1)
    rows = []
    for case in range(80):
        n = rng.randint(2, 11)
        wp = [rng.uniform(0.01, 1) for _ in range(n)]
        wb = [rng.uniform(0.01, 1) for _ in range(n)]
        rb = [rng.uniform(-0.1, 0.1) for _ in range(n)]
        total = sum(w * r for w, r in zip(wb, rb)) / sum(wb)
        for i in range(n):
            rows.append((case, day("2024-01-02"), f"S{i}", wp[i] / sum(wp), wb[i] / sum(wb),
                         rng.uniform(-0.1, 0.1), rb[i], total))
    names = "wp wb rp rb_i rb_total".split()
    wp, wb, rp, rb_i, rb = (F.col(c) for c in names)
    daily = spark.createDataFrame(
        rows, "portfolio_id int, date date, sector string, " + ", ".join(f"{c} double" for c in names)
    ).select(
        "*",
        m.allocation_effect(wp, wb, rb_i, rb).alias("allocation"),
        m.selection_effect(wb, rp, rb_i).alias("selection"),
        m.interaction_effect(wp, wb, rp, rb_i).alias("interaction"),
    )
    assert quality.invariant_violations(daily).count() == 0
    broken = daily.withColumn("allocation", F.when(F.col("portfolio_id") == 7, 0.5).otherwise(F.col("allocation")))
    assert {r.portfolio_id for r in quality.invariant_violations(broken).collect()} == {7}


def test_unlinkable_and_non_finite(spark):
    days = days_frame(spark, {1: [(0.1, 0.1)], 2: [(-1.0, 0.1)]})
    assert [r.portfolio_id for r in quality.unlinkable_days(days).collect()] == [2]
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert quality.non_finite(odd, ["x"]).count() == 3


def test_short_labels_and_units(spark):
    assert value(spark, m.short_sector(F.lit("Information Technology"))) == "Info Tech"
    assert value(spark, m.short_sector(F.lit("Energy"))) == "Energy"
    assert value(spark, m.basis_points(F.lit(0.5))) == 5000.0
    assert value(spark, m.export_weight(F.lit(0.1234567))) == 0.12346


def test_weekday_calendar(spark):
    got = [r.date for r in calendar.weekday_calendar(spark, day("2024-01-02"), 15).orderBy("idx").collect()]
    assert got == weekdays(day("2024-01-02"), 15)
    saturday = calendar.weekday_calendar(spark, day("2024-01-06"), 2).orderBy("idx").collect()
    assert [str(r.date) for r in saturday] == ["2024-01-06", "2024-01-08", "2024-01-09"]


def test_period_starts(spark):
    dates = weekdays(day("2023-01-02"), 400)
    frame = spark.createDataFrame([(d,) for d in dates if d <= day("2024-02-29")], "date date")
    got = {r.period: str(r.start_date) for r in calendar.period_starts(frame).collect()}
    assert got == {"MTD": "2024-02-01", "QTD": "2024-01-01", "YTD": "2024-01-01", "1Y": "2023-03-01", "SI": "2023-01-02"}


def test_rebalance_flags_compare_year_and_month(spark):
    frame = spark.createDataFrame([(day(d),) for d in ("2023-01-31", "2024-01-02", "2024-01-03", "2024-02-01")], "date date")
    rows = calendar.rebalance_flags(calendar.trading_calendar(frame)).orderBy("date").collect()
    assert [r.month_start for r in rows] == [False, True, False, True]
    assert [r.quarter_start for r in rows] == [False, True, False, False]


def test_zero_flow_twr_is_value_ratio(spark, universe):
    valued = returns.valuations(universe)
    ends = valued.orderBy("date").collect()
    got = returns.twr(valued).first()
    assert got.twr == pytest.approx(ends[-1].mv_end / ends[0].mv_begin - 1, abs=1e-10)
    assert got.n_days == 60


def test_return_gap_is_zero_for_constant_quantities(spark, universe):
    gap = quality.return_gap(returns.valuations(universe), attribution.held_sectors(universe))
    assert gap.count() == 60
    assert gap.agg(F.max(F.abs("gap"))).first()[0] < 1e-12
