"""What the operators share: shipping code, stored steps, Arrow columns."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfattr.sources.storage import application_folder
from perfattr.sources.storage import new_path as scratch
from perfattr.sources.storage import stored

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    What `--py-files` does, for callers that only put the folder on their own path. Arrow
    batches are kept small unless the session says otherwise, as texts may be long.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "1000")
    if getattr(context, "_perfattr_shipped", False):
        return
    packed = io.BytesIO()
    root = os.path.dirname(_PACKAGE)
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    # In the shared folder, beside the intermediate tables: executors may come and go as long as the application runs.
    jvm = context._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{application_folder(spark)}-code/perfattr_llm.zip")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    files.deleteOnExit(path.getParent())
    context.addPyFile(str(files.makeQualified(path).toUri()))
    context._perfattr_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`row` (all columns in one), `id` and `key` (a hash of the text): no column of the table can clash."""
    return documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.xxhash64(F.col(f"`{text_column}`")).alias("key"),
    )


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of `row` again, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """A repeatable sample of at most about `most` rows, spread evenly by a hash of the key.

    All rows, if there are no more than `most`. For fitting models only.
    """
    n = rows.count()
    if n <= most:
        return rows
    grain = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(grain)) < int(grain * most / n))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no slice has much more than `most` bytes in the column, whole rows only."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_bytes(batch.column(column))[1]
        first = 0
        while first < batch.num_rows:
            after = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
            after = min(max(after, first + 1), batch.num_rows)
            yield batch.slice(first, after - first)
            first = after
