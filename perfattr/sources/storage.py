"""Folders for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; removed when the application ends."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    files, path = _file_system(spark, folder)
    files.deleteOnExit(path)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; DataFrames that read them end with it."""
    files, path = _file_system(spark, application_folder(spark))
    files.delete(path, True)


def stored(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from there; `codec` if it should take less room."""
    path = new_path(df.sparkSession, name)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made of them has been stored itself."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove(table.sparkSession, folder)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop_path = _file_system(spark, path)
    return files.exists(hadoop_path)


def modification_stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """(size, modification time) of a file or folder."""
    files, hadoop_path = _file_system(spark, path)
    size = files.getContentSummary(hadoop_path).getLength()
    return size, files.getFileStatus(hadoop_path).getModificationTime()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, hadoop_path = _file_system(spark, path)
    files.delete(hadoop_path, True)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which the session broadcasts one side of a join; negative if it never does."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def fits_broadcast(table: DataFrame) -> bool:
    """Whether the files of a stored table are small enough for the session to broadcast it.

    Files are compressed, so a quarter of the threshold is allowed.
    """
    size = sum(modification_stamp(table.sparkSession, path)[0] for path in table.inputFiles())
    return size <= broadcast_limit(table.sparkSession) // 4


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below a folder."""
    files, hadoop_path = _file_system(spark, path)
    return [status.getPath().getName() for status in files.listStatus(hadoop_path)]
