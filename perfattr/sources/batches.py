"""Appending rows to a stored star, all tables or none, and compacting what has been appended.

A batch is written below a folder of its own (`batch=<folder>`) in every table; then a commit names the folder.
Readers take committed folders only, so a job that dies halfway, or loses against another writer, leaves nothing
visible.  Every batch of the fact is bucketed by portfolio into the same number of buckets and all of them
are read as one bucketed table, so prior-close windows and sums per portfolio need no shuffle however many imports
there were.  Compaction rewrites all batches into one, a file per bucket, under a new commit; it goes bucket by bucket, so
nothing is shuffled for it.  Batches whose commits name no keys were bucketed by series; the next compaction places
them by portfolio.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perfattr.sources import commits, schemas
from perfattr.sources.star import BUCKET_KEYS, FACT_KEYS, Star, write_bucketed_positions, write_table
from perfattr.sources.storage import exists, remove

_FACT = "positions_daily"


@dataclass(frozen=True)
class Published:
    """What the commits add up to."""

    version: int
    batches: tuple[str, ...]  # ids of all batches, also of compacted ones
    folders: dict[str, list[str]]  # live folders and the tables each has
    buckets: int | None
    keys: tuple[str, ...] = BUCKET_KEYS  # what the fact is bucketed by


def published(spark: SparkSession, root: str) -> Published:
    version, names, folders, buckets, keys = 0, [], {}, None, BUCKET_KEYS
    for entry in commits.entries(spark, root):
        version, buckets = entry["version"], entry["buckets"]
        keys = tuple(entry.get("keys", FACT_KEYS))
        names += entry["batches"]
        for folder in entry["replaces"]:
            del folders[folder]
        folders[entry["folder"]] = entry["tables"]
    return Published(version, tuple(names), folders, buckets, keys)


def version(spark: SparkSession, root: str) -> int:
    """Number of the last commit: what an import is made against."""
    return published(spark, root).version


def publish(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    root: str,
    batch_id: str,
    base: int | None = None,
    buckets: int | None = None,
) -> int:
    """Store a full star or the rows of an import as one batch; returns the version it made.

    Ids are minted against what was published, so an import gives the `version` it read as `base`;
    it is refused if anything has been committed since, be it while its rows are written.  Without a base
    the batch goes on top of whatever is there.  `buckets` is set by the first batch (by default the session's shuffle
    partitions) and kept by the others.
    """
    state = published(spark, root)
    _check(state, batch_id, base)
    buckets = state.buckets or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = uuid.uuid4().hex
    try:
        _write(tables, root, folder, buckets, state.keys)
        entry = {"batches": [batch_id], "folder": folder, "tables": sorted(tables), "replaces": []}
        entry |= {"buckets": buckets, "keys": list(state.keys)}
        keys = state.keys
        while True:
            try:
                commits.commit(spark, root, state.version + 1, entry)
                return state.version + 1
            except commits.Conflict:
                state = published(spark, root)
                _check(state, batch_id, base)
                if (state.buckets, state.keys) != (buckets, keys):
                    raise
    except Exception:
        _forget(spark, root, folder)
        raise


def _check(state: Published, batch_id: str, base: int | None) -> None:
    if batch_id in state.batches:
        raise ValueError(f"batch {batch_id} is already published")
    if base is not None and state.version != base:
        raise commits.Conflict(f"the batch was made against version {base}, but {state.version} is published")


def _write(tables: dict[str, DataFrame], root: str, folder: str, buckets: int, keys: tuple[str, ...]) -> None:
    for name, table in tables.items():
        path = f"{root}/{name}/batch={folder}"
        if name != _FACT:
            write_table(table, name, path)
            continue
        written = f"batch_{folder}"
        write_bucketed_positions(table, written, buckets, path, keys=keys)
        table.sparkSession.sql(f"DROP TABLE {written}")  # the files stay; `_facts` names them


def _forget(spark: SparkSession, root: str, folder: str) -> None:
    for name in schemas.STAR:
        remove(spark, f"{root}/{name}/batch={folder}")


def read_published(spark: SparkSession, root: str) -> Star:
    """The star of all live batches."""
    state = published(spark, root)
    if not state.version:
        raise ValueError(f"nothing is published in {root}")
    tables = {}
    for name, schema in schemas.STAR.items():
        folders = [f for f, names in state.folders.items() if name in names]
        if not folders:  # no batch has had rows for it
            tables[name] = spark.createDataFrame([], schema)
        elif name == _FACT:
            tables[name] = _facts(spark, root, state, folders)
        else:
            tables[name] = _files(spark, root, name, folders)
    return Star(**tables)


def _files(spark: SparkSession, root: str, name: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(schemas.STAR[name]).parquet(*[f"{root}/{name}/batch={f}" for f in folders])


def _facts(spark: SparkSession, root: str, state: Published, folders: list[str]) -> DataFrame:
    """The live batches of the fact as partitions of one bucketed table.

    The session's catalog gets an external table per version; its files are the batches themselves.
    """
    name = f"facts_{sha256(root.encode()).hexdigest()[:16]}_{state.version}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.POSITIONS_DAILY.fields)
        keys, order = ", ".join(state.keys), ", ".join(FACT_KEYS)
        spark.sql(
            f"CREATE TABLE {name} ({columns}, batch string) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY ({keys}) SORTED BY ({order}, date) INTO {state.buckets} BUCKETS LOCATION '{root}/{_FACT}'"
        )
        spark.catalog.recoverPartitions(name)
    rows = spark.table(name).where(F.col("batch").isin(folders))
    return rows.select(*schemas.POSITIONS_DAILY.fieldNames())


@contextmanager
def _whole_buckets(spark: SparkSession) -> Iterator[None]:
    """Bucketed tables are read a bucket per task, also where Spark sees no join or window that asks for it."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def compact(spark: SparkSession, root: str, buckets: int | None = None) -> int:
    """Rewrite all live batches as one, with a single sorted file per bucket; returns the version it made.

    It is refused if anything is published meanwhile.  Readers of the earlier version keep their files;
    `remove_replaced` deletes these once nobody reads them.
    """
    state = published(spark, root)
    buckets, folder = buckets or state.buckets, uuid.uuid4().hex
    names = sorted({n for names in state.folders.values() for n in names})
    live = {n: [f for f, has in state.folders.items() if n in has] for n in names}
    tables = {n: _files(spark, root, n, live[n]) for n in names}
    if _FACT in names:
        tables[_FACT] = _facts(spark, root, state, live[_FACT])
    try:
        with _whole_buckets(spark):
            _write(tables, root, folder, buckets, BUCKET_KEYS)
        entry = {"batches": [], "folder": folder, "tables": names, "replaces": list(state.folders)}
        entry |= {"buckets": buckets, "keys": list(BUCKET_KEYS)}
        commits.commit(spark, root, state.version + 1, entry)
    except Exception:
        _forget(spark, root, folder)
        raise
    return state.version + 1


def remove_replaced(spark: SparkSession, root: str) -> int:
    """Delete the files of batches that compaction has replaced; returns how many batches they were."""
    live = published(spark, root).folders
    replaced = {f for entry in commits.entries(spark, root) for f in entry["replaces"]} - set(live)
    gone = [f for f in sorted(replaced) if any(exists(spark, f"{root}/{n}/batch={f}") for n in schemas.STAR)]
    for folder in gone:
        _forget(spark, root, folder)
    return len(gone)
