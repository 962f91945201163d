"""The six star tables: reading, writing, counting."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfattr.sources import schemas

FACT_KEYS = ("portfolio_id", "security_id")
#: What a bucketed fact is placed by: prior closes and sums by portfolio need no shuffle then.
BUCKET_KEYS = ("portfolio_id",)


@dataclass(frozen=True)
class Star:
    securities: DataFrame
    portfolios: DataFrame
    positions_daily: DataFrame
    transactions: DataFrame
    benchmark_weights: DataFrame
    benchmark_returns: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def with_positions(self, positions: DataFrame) -> Star:
        """Same star over another source of the fact table."""
        return replace(self, positions_daily=positions)

    def by_portfolio(self) -> Star:
        """Same star with the fact moved by portfolio once, so prior closes and sums by portfolio move it no more."""
        return self.with_positions(self.positions_daily.repartition("portfolio_id"))

    def append(self, deltas: dict[str, DataFrame]) -> Star:
        """Star with the given rows added to the named tables."""
        grown = {
            name: table.unionByName(deltas[name]) if name in deltas else table
            for name, table in self.tables().items()
        }
        return Star(**grown)


def read_star(spark: SparkSession, path: str) -> Star:
    """Star stored as one Parquet directory per table."""
    return Star(
        **{
            name: spark.read.schema(schema).parquet(f"{path}/{name}")
            for name, schema in schemas.STAR.items()
        }
    )


def write_table(table: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """Write one table as ZSTD Parquet, the fact clustered by its series."""
    table = table.select(*schemas.STAR[name].fieldNames())
    if name == "positions_daily":
        table = table.repartitionByRange(*FACT_KEYS).sortWithinPartitions(*FACT_KEYS, "date")
    table.write.mode(mode).option("compression", "zstd").parquet(path)


def write_star(star: Star, path: str, mode: str = "errorifexists") -> None:
    for name, table in star.tables().items():
        write_table(table, name, f"{path}/{name}", mode)


def write_bucketed_positions(
    positions: DataFrame,
    table: str,
    buckets: int,
    path: str | None = None,
    mode: str = "errorifexists",
    keys: tuple[str, ...] = BUCKET_KEYS,
) -> None:
    """Save the fact as a table bucketed by portfolio, with the series of a bucket sorted by date.

    Prior-close windows and sums per portfolio over such a table need no shuffle, and no sort either if the session
    trusts a bucket's single file to be sorted (`spark.sql.legacy.bucketedTableScan.outputOrdering`).  Choose
    `buckets` so that one bucket fits a task; rows are first moved to their bucket so every bucket is a single
    file, unless they lie in as many buckets of the same keys already.
    """
    writer = (
        positions.select(*schemas.POSITIONS_DAILY.fieldNames())
        .repartition(buckets, *keys)
        .write.mode(mode)
        .format("parquet")
        .option("compression", "zstd")
        .bucketBy(buckets, *keys)
        .sortBy(*FACT_KEYS, "date")
    )
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def row_counts(star: Star) -> DataFrame:
    """One (table_name, n_rows) row per table."""
    counts = [
        table.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, table in star.tables().items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def data_range(star: Star) -> DataFrame:
    """First and last date that has security returns."""
    return star.benchmark_returns.agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date")
    )


def portfolio_names(star: Star, ids: DataFrame) -> DataFrame:
    """Display name of each `portfolio_id` in `ids`, known to the master or not."""
    fallback = F.concat(F.lit("Portfolio "), F.col("portfolio_id").cast("string"))
    return ids.join(star.portfolios.select("portfolio_id", "name"), "portfolio_id", "left").withColumn(
        "name", F.coalesce("name", fallback)
    )
