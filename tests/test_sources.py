"""Reading, writing, publishing; marts as files; the registered queries."""

from __future__ import annotations

import json
import os
import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import day
from perfattr.operators import attribution, quality, returns
from perfattr.operators.holdings import import_holdings
from perfattr.operators.series import basis_returns
from perfattr.plans import marts
from perfattr.plans.oracle import oracle
from perfattr.plans.queries import REGISTRY
from perfattr.sources import batches, commits, schemas, star as stars
from perfattr.sources.holdings_csv import read_holdings
from perfattr.sources.ordered import ordered_files, read_places, write_ordered
from test_holdings import frame, golden_rows

DATA = "/root/testdata/sf0.001"


def test_star_round_trip(spark, universe, tmp_path):
    stars.write_star(universe, str(tmp_path / "star"))
    back = stars.read_star(spark, str(tmp_path / "star"))
    for name, table in universe.tables().items():
        assert back.tables()[name].exceptAll(table).count() == 0, name
    counts = {r.table_name: r.n_rows for r in stars.row_counts(back).collect()}
    assert counts["positions_daily"] == 61 * 6 and counts["transactions"] == 0
    assert stars.data_range(back).first().min_date == day("2024-01-03")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        stars.write_star(universe, str(tmp_path / "star"))


def test_bucketed_positions_need_no_shuffle(spark, universe, tmp_path):
    stars.write_bucketed_positions(universe.positions_daily, "bucketed_positions", 4, str(tmp_path / "b"))
    try:
        stored = universe.with_positions(spark.table("bucketed_positions"))
        basis = attribution.weight_basis(stored)
        plan = basis._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        diff = quality.max_abs_diff(
            attribution.attribution_daily(stored), attribution.attribution_daily(universe),
            ["portfolio_id", "date", "sector"], ["wp", "rp", "selection"],
        ).first()
        assert diff.only_left == diff.only_right == 0 and diff.max_abs_diff < 1e-14
    finally:
        spark.sql("DROP TABLE bucketed_positions")


def test_names_fall_back(spark, universe):
    ids = spark.createDataFrame([(1,), (9,)], "portfolio_id int")
    got = {r.portfolio_id: r.name for r in stars.portfolio_names(universe, ids).collect()}
    assert got == {1: "Portfolio 001", 9: "Portfolio 9"}


def test_holdings_csv(spark, universe, tmp_path):
    folder = tmp_path / "account=A"
    folder.mkdir()
    lines = ["date,ticker,sector,quantity,price,dividend"]
    for _, d, ticker, sector, q, p, div in golden_rows():
        lines.append(f"{d},{ticker},{sector},{q},{p},{'' if div is None else div}")
    (folder / "holdings.csv").write_text("\n".join(lines) + "\n")
    read = read_holdings(spark, str(tmp_path))
    assert read.select(*frame(spark, []).columns).exceptAll(frame(spark, golden_rows())).count() == 0
    assert read.count() == 20
    single = read_holdings(spark, str(folder / "holdings.csv"), account="mine")
    assert single.select("account").distinct().first()[0] == "mine"
    assert import_holdings(single, universe).summary.first().flow_days == 1
    (folder / "holdings.csv").write_text("\n".join([*lines, "2024-01-03,AAPL,Energy,many,1,0"]) + "\n")
    with pytest.raises(Exception):
        read_holdings(spark, str(tmp_path)).collect()


def test_publishing_is_all_or_nothing(spark, universe, tmp_path):
    root = str(tmp_path / "lake")
    batches.publish(spark, universe.tables(), root, "base", buckets=3)
    batch = import_holdings(frame(spark, golden_rows()), universe)
    # A job that stopped after its first table: rows are there but not published.
    batch.deltas["positions_daily"].write.parquet(f"{root}/positions_daily/batch=lost")
    assert batches.read_published(spark, root).positions_daily.count() == 61 * 6
    assert batches.publish(spark, batch.deltas, root, "import1") == 2
    after = batches.read_published(spark, root)
    assert after.positions_daily.count() == 61 * 6 + 20 and after.securities.count() == 8
    assert after.positions_daily.schema.fieldNames() == schemas.POSITIONS_DAILY.fieldNames()
    with pytest.raises(ValueError, match="already published"):
        batches.publish(spark, batch.deltas, root, "import1")


def test_one_of_two_writers_on_the_same_base_loses(spark, universe, tmp_path, monkeypatch):
    """The second writer commits between the check and the commit of the first."""
    root = str(tmp_path / "lake")
    batches.publish(spark, universe.tables(), root, "base", buckets=2)
    batch = import_holdings(frame(spark, golden_rows()), universe)
    write, other = batches._write, []

    def interleaved(tables, *args):
        write(tables, *args)
        if not other:
            other.append("on its way")
            batches.publish(spark, batch.deltas, root, "second", base=1)

    monkeypatch.setattr(batches, "_write", interleaved)
    with pytest.raises(commits.Conflict):
        batches.publish(spark, batch.deltas, root, "first", base=1)
    assert batches.published(spark, root).batches == ("base", "second") and batches.version(spark, root) == 2
    assert batches.read_published(spark, root).positions_daily.count() == 61 * 6 + 20
    assert len(os.listdir(f"{root}/positions_daily")) == 2  # the loser's files are gone
    # Without a base the batch goes on top of the other one.
    other.clear()

    def again(tables, *args):
        write(tables, *args)
        if not other:
            other.append("on its way")
            batches.publish(spark, {}, root, "third")

    monkeypatch.setattr(batches, "_write", again)
    assert batches.publish(spark, {}, root, "fourth") == 4
    assert batches.published(spark, root).batches == ("base", "second", "third", "fourth")


def test_a_commit_is_made_once_by_link_and_by_rename(spark, tmp_path):
    root = str(tmp_path / "log")
    commits.commit(spark, root, 1, {"a": 1})
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, 1, {"a": 2})
    assert commits.entries(spark, root) == [{"a": 1, "version": 1}]
    assert [n for n in os.listdir(f"{root}/_commits") if "draft" in n and not n.startswith(".")] == []
    jvm = spark.sparkContext._jvm
    (tmp_path / "from").write_text("x")
    (tmp_path / "to").write_text("y")
    paths = [jvm.org.apache.hadoop.fs.Path(f"file:{tmp_path}/{n}") for n in ("from", "to")]
    with pytest.raises(Exception, match="AlreadyExists|exists"):
        commits._rename(spark, *paths)
    (tmp_path / "to").unlink()
    commits._rename(spark, *paths)
    assert (tmp_path / "to").read_text() == "x"


def test_imports_stay_bucketed_and_compact(spark, universe, tmp_path):
    root = str(tmp_path / "lake")
    batches.publish(spark, universe.tables(), root, "base", buckets=4)
    for k in range(3):
        star = batches.read_published(spark, root)
        rows = [(f"A{k}", d, f"{t}{k}", *rest) for _, d, t, *rest in golden_rows()]
        batch = import_holdings(frame(spark, rows), star)
        batches.publish(spark, batch.deltas, root, f"import{k}", base=k + 1)
    grown = batches.read_published(spark, root)
    assert grown.positions_daily.count() == 61 * 6 + 3 * 20
    assert "Exchange" not in attribution.weight_basis(grown)._jdf.queryExecution().executedPlan().toString()
    before = attribution.attribution_over_period(grown).collect()
    assert batches.compact(spark, root) == 5
    small = batches.read_published(spark, root)
    (folder,) = batches.published(spark, root).folders
    assert sum(f.endswith(".parquet") for f in os.listdir(f"{root}/positions_daily/batch={folder}")) <= 4  # one per bucket
    after = attribution.attribution_over_period(small)
    met = basis_returns(small).groupBy("portfolio_id", "date", "sector").agg(F.sum("basis"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    lag = plan.index("Window")
    below = plan[plan.rindex("HashAggregate", 0, lag) : plan.index("FileScan", lag)]  # from the partial one to the scan
    assert "Exchange hashpartitioning" not in below
    assert sorted(map(repr, after.collect())) == sorted(map(repr, before)) and len(before) > 3
    assert batches.published(spark, root).batches == ("base", "import0", "import1", "import2")
    assert grown.positions_daily.count() == 61 * 6 + 3 * 20  # readers of the earlier version go on
    assert batches.remove_replaced(spark, root) == 4 and batches.remove_replaced(spark, root) == 0
    assert batches.read_published(spark, root).positions_daily.count() == 61 * 6 + 3 * 20


def test_compaction_and_sums_by_portfolio_move_nothing(spark, universe, tmp_path, monkeypatch):
    root, plans, write = str(tmp_path / "lake"), [], batches._write

    def watched(tables, root, folder, buckets, *keys):
        placed = tables["positions_daily"].repartition(buckets, "portfolio_id")
        plans.append(placed._jdf.queryExecution().executedPlan().toString())
        write(tables, root, folder, buckets, *keys)

    batches.publish(spark, universe.tables(), root, "base", buckets=4)
    star = batches.read_published(spark, root)
    batches.publish(spark, import_holdings(frame(spark, golden_rows()), star).deltas, root, "import", base=1)
    grown = batches.read_published(spark, root)
    met = basis_returns(grown).groupBy("portfolio_id", "date", "sector").agg(F.sum("basis"))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(portfolio_id" not in plan and "Bucketed: true" in plan
    before = sorted(map(repr, grown.positions_daily.collect()))
    monkeypatch.setattr(batches, "_write", watched)
    batches.compact(spark, root)
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Bucketed: true" in plans[0]
    assert spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled") == "true"
    assert sorted(map(repr, batches.read_published(spark, root).positions_daily.collect())) == before


def test_batches_bucketed_by_series_are_read_and_compacted(spark, universe, tmp_path, monkeypatch):
    """Commits of before name no keys."""
    root, commit = str(tmp_path / "lake"), commits.commit

    def without_keys(spark, root, version, entry):
        commit(spark, root, version, {k: v for k, v in entry.items() if k != "keys"})

    monkeypatch.setattr(batches, "published", lambda *_: batches.Published(0, (), {}, 4, stars.FACT_KEYS))
    monkeypatch.setattr(commits, "commit", without_keys)
    batches.publish(spark, universe.tables(), root, "base")
    monkeypatch.undo()
    star = batches.read_published(spark, root)
    assert batches.published(spark, root).keys == stars.FACT_KEYS
    batches.publish(spark, import_holdings(frame(spark, golden_rows()), star).deltas, root, "import", base=1)
    grown = batches.read_published(spark, root)
    assert batches.published(spark, root).keys == stars.FACT_KEYS and grown.positions_daily.count() == 61 * 6 + 20
    before = sorted(map(repr, attribution.weight_basis(grown).collect()))
    batches.compact(spark, root)
    assert batches.published(spark, root).keys == stars.BUCKET_KEYS
    after = attribution.weight_basis(batches.read_published(spark, root))
    assert sorted(map(repr, after.collect())) == before


def test_exported_marts(spark, universe, tmp_path):
    path = str(tmp_path / "marts")
    assert marts.export_marts(universe, path) == 1
    found = marts.read_marts(spark, path)
    doc = found["portfolio"].first()
    assert doc.name == "Portfolio 001" and len(doc.series) == 60 and len(doc.attribution) == 3
    assert len(doc.top) == 6 and doc.bottom == []
    held = attribution.held_sectors(universe, within_lifespan=True)
    twr = returns.active_returns(returns.day_returns(held)).first().twr
    assert doc.risk.twr == pytest.approx(twr, abs=1e-7)
    weights = found["weights"].first()
    assert len(weights.sectors) == 3 and len(weights.sectors[0].weights) == 12
    assert sum(s.weights[0] for s in weights.sectors) == pytest.approx(1, abs=1e-4)
    assert found["market"].count() == 60
    labels = {r.sector: r.label for r in found["sectors"].collect()}
    assert labels["Information Technology"] == "Info Tech"


def test_a_failed_export_leaves_the_one_before(spark, universe, tmp_path, monkeypatch):
    path = str(tmp_path / "marts")
    with pytest.raises(ValueError, match="nothing is exported"):
        marts.read_marts(spark, path)
    marts.export_marts(universe, path)

    def fails(*args):
        raise RuntimeError("the log is not there")

    monkeypatch.setattr(marts.commits, "commit", fails)
    with pytest.raises(RuntimeError):
        marts.export_marts(universe, path)
    monkeypatch.undo()
    assert marts.read_marts(spark, path)["market"].count() == 60
    assert sum(n.startswith("export=") for n in os.listdir(path)) == 1
    infinite = F.when(F.col("date") == "2024-02-01", float("inf")).otherwise(F.col("rb"))
    context = marts.market_context
    monkeypatch.setattr(marts, "market_context", lambda star: context(star).withColumn("rb", infinite))
    with pytest.raises(ValueError, match="market holds figures"):
        marts.export_marts(universe, path)
    assert len(commits.entries(spark, path)) == 1


def test_figures_that_are_not_finite_are_found_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [(1.0, [0.5])], 2.0), (2, [(1.0, [0.5, nan])], 2.0), (3, [(-inf, [])], 2.0), (4, None, inf), (5, [(None, None)], None)]
    df = spark.createDataFrame(rows, "k int, a array<struct<x: double, y: array<double>>>, z double")
    assert {r.k for r in quality.not_finite_inside(df).collect()} == {2, 3, 4}
    assert quality.not_finite_inside(df.select("k")).count() == 0


def test_ordered_result_is_sorted_over_its_files(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.randrange(500), draw.choice(["a", "b", None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "n int, s string").repartition(5)
    path = str(tmp_path / "sorted")
    write_ordered(df, path, F.desc("n"), "s", files=6)
    files = ordered_files(spark, path)
    assert len(files) > 3
    read = [tuple(r) for f in files for r in pq.read_table(f).to_pylist() for r in [(r["n"], r["s"])]]
    assert read == sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    places = {r.place: (r.n, r.s) for r in read_places(spark, path).collect()}
    assert [places[k + 1] for k in range(len(rows))] == read
    text = str(tmp_path / "text")
    write_ordered(df, text, "n", files=3, kind="json")
    values = [json.loads(line)["n"] for f in ordered_files(spark, text) for line in open(f)]
    assert values == sorted(r[0] for r in rows)


def test_performance_summary_counts_days_to_the_requested_end(universe):
    got = marts.performance_summary(universe, end="2025-06-30").first()
    assert got.n_days == 60 and got.calendar_days == (day("2025-06-30") - day("2024-01-02")).days
    assert got.twr_annualised is not None
    assert marts.performance_summary(universe).first().twr_annualised is None


def test_period_kpis_keep_two_days(spark, universe):
    days = returns.day_returns(attribution.held_sectors(universe, within_lifespan=True))
    early = days.where("date <= '2024-01-12'")
    got = {r.period: r for r in marts.period_kpis(early, universe.benchmark_returns).collect()}
    assert got["SI"].n_days == 8 and got["MTD"].n_days == 2 and got["MTD"].te is not None
    whole = {r.period: r.n_days for r in marts.period_kpis(days, universe.benchmark_returns).collect()}
    assert whole["SI"] == whole["YTD"] == 60 and whole["MTD"] == 18


def test_week_readout(universe):
    weekly = marts.weekly_weights(attribution.attribution_daily(universe, within_lifespan=True), universe)
    latest = marts.week_readout(weekly).collect()
    assert {r.week for r in latest} == {11} and len(latest) == 3
    assert {r.week for r in marts.week_readout(weekly, 0).collect()} == {0}




def test_every_query_has_sql():
    assert set(REGISTRY) == set(oracle())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
@pytest.mark.parametrize("name", ["attribution_period", "attribution_zero_basis", "performance_summary", "model_positions_monthly", "import_summary"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "part", "supplier", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    theirs = con.execute(oracle()[name]).df()
    ours = REGISTRY[name](spark, DATA).toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    numbers = [c for c in ours.columns if ours[c].dtype.kind == "f"]
    keys = [c for c in ours.columns if c not in numbers]
    for c in keys:
        ours[c], theirs[c] = ours[c].astype(str).str[:24], theirs[c].astype(str).str[:24]
        if c.endswith("date"):
            ours[c], theirs[c] = ours[c].str[:10], theirs[c].str[:10]
    ours = ours.sort_values(keys).reset_index(drop=True)
    theirs = theirs.sort_values(keys).reset_index(drop=True)
    assert ours[keys].equals(theirs[keys])
    for c in numbers:
        assert (ours[c] - theirs[c]).abs().max() < 1e-9
