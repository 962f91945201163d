"""Writing a result in order without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfattr.sources.storage import list_names


def write_ordered(rows: DataFrame, path: str, *order: str | Column, files: int | None = None, kind: str = "parquet") -> None:
    """Write rows sorted over all files: rows of a file come before those of the next file by name.

    Rows are dealt to files by ranges of the order, as many as Spark finds fit or `files`, and sorted within each.
    """
    placed = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    placed.sortWithinPartitions(*order).write.format(kind).save(path)


def ordered_files(spark: SparkSession, path: str) -> list[str]:
    """The files of an ordered result, first to last; a reader of text takes them in this order."""
    return [f"{path}/{name}" for name in sorted(list_names(spark, path)) if name.startswith("part-")]


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """An ordered Parquet result with each row's `place` (from 1), by its file and its position there."""
    rows = spark.read.parquet(path).select("*", "_metadata.file_name", "_metadata.row_index")
    sizes = rows.groupBy("file_name").agg(F.count("*").alias("n"))
    # One row per file: a prefix sum of these is all that has to be known in one place.
    every = sizes.agg(F.array_sort(F.collect_list(F.struct("file_name", "n"))).alias("files"))
    earlier = F.filter("files", lambda f: f["file_name"] < F.col("file_name"))
    before = F.aggregate(earlier, F.lit(0).cast("long"), lambda total, f: total + f["n"])
    offsets = sizes.withColumn("files", every.scalar()).select("file_name", before.alias("before"))
    placed = rows.join(offsets, "file_name").withColumn("place", F.col("before") + F.col("row_index") + 1)
    return placed.drop("file_name", "row_index", "before")
