"""Model portfolios: targets, price paths, rebalancing, import."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import day, weekdays
from perfattr.operators import attribution, models, returns
from perfattr.operators.holdings import import_holdings

DAYS = weekdays(day("2024-01-02"), 60)
SCHEMA = "model string, ticker string, weight double, rebalance string"


def targets(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


THREE = [("SEC001", 0.5), ("SEC003", 0.3), ("SEC005", 0.2)]


def walk(star, picks, starts):
    """Quantities by going through the days one by one."""
    dates = DAYS[1:]
    ids = {r.ticker: r.security_id for r in star.securities.collect()}
    ret = {(r.security_id, r.date): r.ret for r in star.benchmark_returns.collect()}
    px = {t: [100.0] for t, _ in picks}
    for t, _ in picks:
        for d in dates[1:]:
            px[t].append(px[t][-1] * (1 + ret[ids[t], d]))
    held = {t: w * 1_000_000 / 100 for t, w in picks}
    path = {}
    for k, d in enumerate(dates):
        if k and starts(dates[k - 1], d):
            worth = sum(held[t] * px[t][k - 1] for t, _ in picks)
            held = {t: w * worth / px[t][k - 1] for t, w in picks}
        path |= {(t, d): (held[t], px[t][k]) for t, _ in picks}
    return path


@pytest.mark.parametrize(
    "rule, starts",
    [
        ("NONE", lambda a, b: False),
        ("MONTHLY", lambda a, b: a.month != b.month),
        ("QUARTERLY", lambda a, b: a.month != b.month and b.month in (1, 4, 7, 10)),
    ],
)
def test_quantities_equal_daily_walk(spark, universe, rule, starts):
    _, weights = models.checked_weights(targets(spark, [("m", t, w, rule) for t, w in THREE]), universe)
    rows = models.model_holdings(weights, universe).collect()
    expected = walk(universe, THREE, starts)
    assert len(rows) == len(expected) == 180
    for r in rows:
        quantity, px = expected[r.ticker, r.date]
        assert r.quantity == pytest.approx(quantity, rel=1e-12)
        assert r.price == pytest.approx(px, rel=1e-12)


def test_single_ticker_model_is_the_security(spark, universe):
    violations, batch = models.build_models(targets(spark, [("m", "SEC001", 1.0, "NONE")]), universe)
    assert violations.count() == 0
    got = batch.summary.first()
    assert (got.position_rows, got.flow_days, got.new_securities) == (60, 0, 0)
    grown = universe.append(batch.deltas)
    days = returns.day_returns(attribution.held_sectors(grown, DAYS[2], portfolios=[2]))
    rets = universe.benchmark_returns.where("security_id = 1").select("date", "ret")
    worst = days.join(rets, "date").agg(F.max(F.abs(F.col("rp") - F.col("ret"))), F.count("*")).first()
    assert worst[0] < 1e-12 and worst[1] == 59


def test_many_models_finance_themselves(spark, universe):
    rows = [("m1", t, w, "MONTHLY") for t, w in THREE]
    rows += [("m2", "SEC004", 60.0, "QUARTERLY"), ("m2", "SEC005", 40.0, "QUARTERLY"), ("m3", "SEC002", 1.0, "NONE")]
    violations, batch = models.build_models(targets(spark, rows), universe)
    assert violations.count() == 0
    assert {(r.account, r.tickers, r.flow_days) for r in batch.summary.collect()} == {("m1", 3, 0), ("m2", 2, 0), ("m3", 1, 0)}
    assert batch.deltas["transactions"].count() == 0


def test_target_rules(spark, universe):
    rows = (
        [("unknown", "NOPE", 1.0, "NONE")]
        + [("sum", "SEC001", 0.4, "NONE"), ("sum", "SEC002", 0.2, "NONE")]
        + [("twice", "SEC001", 0.5, "NONE"), ("twice", "SEC001", 0.5, "NONE")]
        + [("negative", "SEC001", 1.5, "NONE"), ("negative", "SEC002", -0.5, "NONE")]
        + [("many", f"T{i}", 1 / 51, "NONE") for i in range(51)]
        + [("good", "SEC001", 99.95, "NONE")]
    )
    known = spark.createDataFrame([(m,) for m in ("empty", "good")], "model string")
    violations, weights = models.checked_weights(targets(spark, rows), universe, known, max_holdings=50)
    found = {(r.model, r.rule) for r in violations.collect()}
    assert found == {
        ("unknown", "unknown_ticker"), ("sum", "weights_off_sum"), ("twice", "duplicate_ticker"),
        ("negative", "weight_not_positive"), ("many", "too_many_holdings"), ("many", "unknown_ticker"),
        ("empty", "no_holdings"),
    }
    assert [(r.model, r.weight) for r in weights.collect()] == [("good", 1.0)]


def test_partial_history_is_not_eligible(spark, universe):
    part = [("p", d, "PART", "Energy", 10.0, 100.0 + i, None) for i, d in enumerate(DAYS[5:10])]
    schema = "account string, date date, ticker string, sector string, quantity double, price double, dividend double"
    grown = universe.append(import_holdings(spark.createDataFrame(part, schema), universe).deltas)
    assert {r.ticker for r in models.eligible_securities(grown).collect()} == {f"SEC{i:03d}" for i in range(1, 7)}
    found = models.target_violations(targets(spark, [("m", "PART", 1.0, "NONE")]), grown).collect()
    assert [(r.rule, r.n) for r in found] == [("partial_history", 1)]


def test_equal_weights_and_spelling(spark, universe):
    picks = spark.createDataFrame([("m", t) for t in ("c", "a", "b")], "model string, ticker string")
    got = {r.ticker: r.weight for r in models.equal_weights(picks).collect()}
    assert got == {"a": 33.34, "b": 33.33, "c": 33.33}
    typed = targets(spark, [("m", "sec001", 1.0, "NONE"), ("m", "nope", 1.0, "NONE")])
    fixed = {r.ticker for r in models.canonical_tickers(typed, universe.securities).collect()}
    assert fixed == {"SEC001", "nope"}


def test_targets_are_worked_out_once_and_spelt_out_in_many_tasks(spark, universe):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(ticker):
        made.add(1)
        return ticker

    rows = [(f"m{k}", t, w, "MONTHLY") for k in range(8) for t, w in THREE]
    given = targets(spark, rows).withColumn("ticker", counted.asNondeterministic()("ticker"))
    violations, weights = models.checked_weights(given, universe)
    assert violations.isEmpty() and weights.count() == len(rows)
    assert made.value == len(rows)
    assert models.model_holdings(weights, universe).rdd.getNumPartitions() == 4  # not merged for their few bytes
