"""The fact in coarse periods of time, for reading a window of dates without the rest.

Every period is a partition, clustered by series within.  Next to it lies what each series carries into the period: its
last row before it, however long ago.  A window therefore reads the periods it touches and one
partition of carried rows, and prior closes over these are right for series with gaps too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from perfattr.operators.common import Day, in_range
from perfattr.sources import schemas
from perfattr.sources.star import FACT_KEYS
from perfattr.sources.storage import list_names

_ROW = schemas.POSITIONS_DAILY.fieldNames()


def write_by_period(positions: DataFrame, path: str, months: int = 12) -> None:
    """Write the fact below `path` in periods of so many months, counted from the year 0.

    Rows stay in the task they are in, which writes a file per period; what is carried is worked out of the same rows, so a
    fact that lies by portfolio is neither moved nor stored in between.
    """
    spark = positions.sparkSession
    month = F.year("date") * 12 + F.month("date") - 1
    dated = positions.select(*_ROW, (month - month % months).alias("period"))
    _write(dated, f"{path}/positions")
    end = F.lit(max(_periods(spark, path), default=None)).cast("int")
    others = [c for c in _ROW if c not in (*FACT_KEYS, "date")]
    lasts = dated.groupBy(*FACT_KEYS, "period").agg(F.max("date").alias("date"), *(F.max_by(c, "date").alias(c) for c in others))
    until = F.coalesce(F.lead("period").over(W.partitionBy(*FACT_KEYS).orderBy("period")), end)
    next_period = F.col("period") + months
    carried = lasts.withColumn("until", until).where(F.col("until") >= next_period)
    carried = carried.select(*_ROW, F.explode(F.sequence(next_period, "until", F.lit(months))).alias("period"))
    _write(carried, f"{path}/carried")


def _write(rows: DataFrame, path: str) -> None:
    rows = rows.sortWithinPartitions("period", *FACT_KEYS, "date")
    rows.write.partitionBy("period").option("compression", "zstd").parquet(path)


def _periods(spark: SparkSession, path: str) -> list[int]:
    names = [n.split("=")[1] for n in list_names(spark, f"{path}/positions") if n.startswith("period=")]
    return sorted(int(n) for n in names if n.lstrip("-").isdigit())


def read_window(spark: SparkSession, path: str, start: Day = None, end: Day = None) -> DataFrame:
    """Positions from `start` to `end`, preceded by rows that hold the prior close of every series.

    Take it as the fact of a star whose prior closes or attributions are wanted for these dates.  The rows before `start`
    are not all there are, so a portfolio's first position is not to be read from it.
    """
    periods = _periods(spark, path)
    first = periods[0] if periods else 0
    if start is not None:
        first = max([p for p in periods if p <= _month(start)], default=first)
    last = max(periods, default=0) if end is None else _month(end)
    inside = F.col("period").between(first, last)
    rows = in_range(_read(spark, f"{path}/positions").where(inside), end=end)
    carried = _read(spark, f"{path}/carried").where(F.col("period") == first)
    return rows.select(*_ROW).unionByName(carried.select(*_ROW))


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType(list(schemas.POSITIONS_DAILY.fields)).add("period", T.IntegerType())).parquet(path)


def _month(day: Day) -> int:
    year, month = str(day).split("-")[:2]
    return int(year) * 12 + int(month) - 1
