"""Token-id files with fixed-width bit packing.

A shard file holds ids of whole documents, each id in the fewest bits that the vocabulary
needs. Ids are packed in blocks of 4096, so every block starts on a byte; the footer has the
blocks' byte offsets and the documents' first ids, and the last 40 bytes say where it is.
A reader unpacks any run of ids from the blocks that hold it, with numpy only.

    blocks | block offsets u64 | doc ids i64 | doc id is present u8 | doc starts u64 | trailer

Files are written by the tasks through Arrow's file systems (local or mounted paths, s3, gs,
hdfs) under names of their own; the manifest, written by Spark, names those that count, so
files of lost or repeated task attempts are never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfattr.llm.common import scratch, ship, slices
from perfattr.llm.tokens import encoder

BLOCK = 4096
_MAGIC = b"FWPK"
_TRAILER = struct.Struct("<4sIQQQQ")
_RUN = 256 * BLOCK

MANIFEST = "part long, seq int, name string, n_docs long, n_ids long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string, shard_start long"


def width_of(vocabulary: int) -> int:
    """Fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as a little-endian bit string, padded to a whole byte."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id needs more than {width} bits")
    if width == 16:
        return ids.astype("<u2").view(np.uint8)
    groups = -(-len(ids) // 8)
    padded = np.zeros(groups * 8, np.uint64)
    padded[: len(ids)] = ids
    padded = padded.reshape(groups, 8)
    out = np.zeros((groups, width + 8), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        value = padded[:, k] << np.uint64(shift)
        for j in range((shift + width + 7) // 8):
            out[:, byte + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out[:, :width].ravel()[: (len(ids) * width + 7) // 8]


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    """The first n ids of a bit string."""
    if width == 16:
        return data[: 2 * n].view("<u2").astype(np.uint32)
    groups = -(-n // 8)
    padded = np.zeros(groups * width + 8, np.uint8)
    padded[: min(len(data), groups * width)] = data[: groups * width]
    out = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        value = np.zeros(groups, np.uint64)
        for j in range((shift + width + 7) // 8):
            column = padded[byte + j : byte + j + groups * width : width][:groups]
            value |= column.astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.ravel()[:n]


class ShardWriter:
    """Writes one shard, block by block."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.offsets, self.doc_ids, self.starts = [0], [], [0]
        self.rest = np.zeros(0, np.uint32)

    def add(self, doc_ids: list, texts: list[np.ndarray]) -> None:
        self.doc_ids += doc_ids
        for ids in texts:
            self.starts.append(self.starts[-1] + len(ids))
        ids = np.concatenate([self.rest, *texts])
        whole = len(ids) // BLOCK * BLOCK
        self._write(ids[:whole])
        self.rest = ids[whole:]

    def _write(self, ids: np.ndarray) -> None:
        if len(ids):
            self.out.write(pack(ids, self.width).tobytes())
            size = BLOCK * self.width // 8
            for first in range(0, len(ids), BLOCK):
                n = min(BLOCK, len(ids) - first)
                self.offsets.append(self.offsets[-1] + (size if n == BLOCK else (n * self.width + 7) // 8))

    @property
    def n_ids(self) -> int:
        return self.starts[-1]

    def close(self) -> None:
        self._write(self.rest)
        self.out.write(np.asarray(self.offsets, "<u8").tobytes())
        self.out.write(np.asarray([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.out.write(np.asarray([x is not None for x in self.doc_ids], np.uint8).tobytes())
        self.out.write(np.asarray(self.starts, "<u8").tobytes())
        self.out.write(
            _TRAILER.pack(_MAGIC, self.width, self.offsets[-1], len(self.offsets) - 1, len(self.doc_ids), self.n_ids)
        )
        self.out.close()


class Shard:
    """Reads a shard: the documents' table at once, ids as asked for."""

    def __init__(self, path: str):
        files, place = pa.fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(place)
        size = self.file.size()
        magic, self.width, footer, blocks, docs, self.n_ids = _TRAILER.unpack(
            self.file.read_at(_TRAILER.size, size - _TRAILER.size)
        )
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a shard of packed ids")
        table = np.frombuffer(self.file.read_at(size - _TRAILER.size - footer, footer), np.uint8)
        ends = np.cumsum([8 * (blocks + 1), 8 * docs, docs, 8 * (docs + 1)])
        self.offsets = table[: ends[0]].view("<u8")
        doc_ids = np.frombuffer(table[ends[0] : ends[1]].tobytes(), "<i8")
        present = table[ends[1] : ends[2]]
        self.doc_ids = [int(x) if p else None for x, p in zip(doc_ids, present)]
        self.starts = np.frombuffer(table[ends[2] : ends[3]].tobytes(), "<u8").astype(np.int64)

    def read(self, first: int, after: int) -> np.ndarray:
        """Ids first to after - 1 of the shard, from the blocks that hold them."""
        after = min(after, self.n_ids)
        if first >= after:
            return np.zeros(0, np.uint32)
        low, high = first // BLOCK, -(-after // BLOCK)
        at, to = int(self.offsets[low]), int(self.offsets[high])
        data = np.frombuffer(self.file.read_at(to - at, at), np.uint8)
        return unpack(data, self.width, after - low * BLOCK)[first - low * BLOCK :]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def write_ids(
    documents: DataFrame,
    folder: str,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 2,
    ids_per_shard: int = 1 << 24,
    by_word: bool = True,
) -> DataFrame:
    """Encode all texts and write them in ascending order of the id; returns the stored manifest.

    Null text is empty, so a document has `end_id` at least. A null id comes first; equal ids are
    ordered by a hash of their text, then as read. An empty table gives an empty manifest. Other
    columns are not read. A task holds 1 MB of texts and one shard's document table.
    """
    spark = documents.sparkSession
    ship(spark)
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    target = f"{folder}/shards"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, shard, name = TaskContext.get().partitionId(), 0, None, ""
        codec = encoder(tokenizer, by_word)
        width = width_of(max(codec.size, end_id + 1))
        files, place = pa.fs.FileSystem.from_uri(target)
        done = []
        for batch in slices(batches, "text", 1 << 20):
            every, bounds = codec.encode(batch.column("text"), end_id)
            texts = np.split(every, bounds[1:-1])
            ids = batch.column("doc_id").to_pylist()
            if shard is None:
                name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                files.create_dir(place, recursive=True)
                shard = ShardWriter(files.open_output_stream(f"{place}/{name}"), width)
            shard.add(ids, texts)
            if shard.n_ids >= ids_per_shard:
                shard.close()
                done.append((part, seq, name, len(shard.doc_ids), shard.n_ids))
                seq, shard = seq + 1, None
        if shard is not None:
            shard.close()
            done.append((part, seq, name, len(shard.doc_ids), shard.n_ids))
        columns = list(zip(*done)) or [()] * 5
        types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["part", "seq", "name", "n_docs", "n_ids"]
        )

    rows.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards in order, each with the ids of all shards before it (`shard_start`).

    One row a shard of 32 MB or so: the running sum is over a small table.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: id, place among all ids, number of ids, checksum."""
    ship(spark)
    manifest = read_manifest(spark, folder)
    tasks = max(1, spark.read.parquet(f"{folder}/manifest").count())
    target = f"{folder}/shards"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(f"{target}/{row['name']}")
                starts = shard.starts
                crcs, run, low, high = [], np.zeros(0, "<u4"), 0, 0
                for k in range(len(shard.doc_ids)):
                    first, after = int(starts[k]), int(starts[k + 1])
                    if after > high:
                        low, high = first, max(after, min(first + _RUN, shard.n_ids))
                        run = shard.read(low, high)
                    crcs.append(zlib.crc32(run[first - low : after - low].astype("<u4", copy=False).tobytes()))
                shard.close()
                n = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts[:-1] + row["shard_start"], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(crcs, pa.int64()),
                        pa.array([row["name"]] * n, pa.string()),
                        pa.array([row["shard_start"]] * n, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_start"],
                )

    return manifest.select("name", "shard_start").repartition(tasks).mapInArrow(read, DOCUMENTS)


def token_id_files(documents: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files (in the shared folder unless `folder` is given) and read them back."""
    spark = documents.sparkSession
    folder = folder or scratch(spark, "ids")
    write_ids(documents, folder, tokenizer, **options)
    return read_documents(spark, folder)
