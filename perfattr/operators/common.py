"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from perfattr.sources.storage import fits_broadcast

Day = date | str | None
Portfolios = DataFrame | Iterable[int] | None


def as_date(day: date | str) -> Column:
    return F.lit(day).cast("date")


def in_range(df: DataFrame, start: Day = None, end: Day = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("date") >= as_date(start))
    if end is not None:
        df = df.where(F.col("date") <= as_date(end))
    return df


def pick_portfolios(df: DataFrame, portfolios: Portfolios) -> DataFrame:
    """Keep the given portfolios: all, a few ids, or the `portfolio_id` values of a table."""
    if portfolios is None:
        return df
    if isinstance(portfolios, DataFrame):
        return df.join(portfolios.select("portfolio_id").distinct(), "portfolio_id", "left_semi")
    return df.where(F.col("portfolio_id").isin([int(p) for p in portfolios]))


def over_time(*keys: str) -> W:
    return W.partitionBy(*keys).orderBy("date")


def running(*keys: str) -> W:
    return over_time(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)


def join_spread(rows: DataFrame, small: DataFrame, key: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Inner join with a stored table that has one row per key, however many rows share a key.

    Broadcast if its files are small enough; else rows of a key are dealt to `salts` tasks by another column, and the
    other table has a copy of its row in each.
    """
    if fits_broadcast(small):
        return rows.join(F.broadcast(small), key)
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"]).drop("_salt")


def number_rows(df: DataFrame, order_by: list[str], column: str, splitters: int | None = None) -> DataFrame:
    """Number rows 1, 2, ... in the order of a unique key without sorting them in one task.

    By default there are as many splitters as shuffle partitions.

    The rows with the smallest key hashes split the key range into at most
    `splitters + 1` even buckets; a row's number is its place in its bucket
    plus the size of the buckets before.  `df` is read three times: give a
    stored table.
    """
    if splitters is None:
        splitters = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order_by)
    cuts = (
        df.select(key.alias("key"), F.xxhash64(*order_by).alias("hash"))
        .orderBy("hash", "key")
        .limit(splitters)
        .agg(F.sort_array(F.collect_list("key")).alias("cuts"))
    )
    bucketed = (
        df.withColumn("_cuts", cuts.scalar())
        .withColumn("_bucket", F.size(F.filter("_cuts", lambda cut: cut <= key)))
        .drop("_cuts")
    )
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    )
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*order_by))
    return (
        bucketed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bucket", "left")  # at most splitters + 1 rows
        .withColumn(column, (F.col("_before") + F.col("_place")).cast("int"))
        .drop("_bucket", "_place", "_before")
    )
