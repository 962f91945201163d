"""Holdings files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perfattr.sources import schemas


def read_holdings(spark: SparkSession, path: str, account: str | None = None) -> DataFrame:
    """Typed holdings rows of CSV files with a header; a malformed value fails the read.

    Without `account`, files lie in `account=<name>` folders below `path`.
    """
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    if account is None:
        schema = T.StructType(schemas.HOLDINGS_CSV.fields).add("account", "string")
        return reader.schema(schema).csv(path)
    return reader.schema(schemas.HOLDINGS_CSV).csv(path).withColumn("account", F.lit(account))
