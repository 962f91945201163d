"""Bounded-space online best-fit packing of token sequences.

A packer keeps a fixed number of bins open. Which free spaces occur among them is a bitset, so
the tightest bin that still takes a piece is the lowest set bit from the piece's length on. If no
bin takes it, a new one opens, and the fullest closes first once the number is reached.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm.common import ship, slices
from perfattr.llm.tokens import encoder

LENGTH = 4096
OPEN_BINS = 2048

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids binary"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"


class BestFit:
    """Places lengths one after another; a place is (bin number, offset in the bin)."""

    def __init__(self, capacity: int = LENGTH, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces = 0
        self.open = 0
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} does not fit {self.capacity}")
        wide = self.spaces >> length
        if wide:
            free = length + (wide & -wide).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.spaces |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.spaces ^= 1 << free
        self.open -= 1
        return number


def pieces(
    documents: DataFrame,
    tokenizer: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 1,
    length: int = LENGTH,
    with_ids: bool = False,
    by_word: bool = True,
) -> DataFrame:
    """The documents' token sequences, cut only where longer than `length`.

    Null text is empty and has the end id alone. `row` numbers the input rows, so repeated
    documents stay apart. `ids` (little-endian unsigned 32 bit) is filled with `with_ids` only.
    """
    ship(documents.sparkSession)
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer, by_word)
        size = 4 * length
        for batch in slices(batches, "text", 1 << 20):
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist())
            out = []
            every, bounds = codec.encode(batch.column("text"), end_id)
            every, bounds = every.astype("<u4").tobytes(), (4 * bounds).tolist()
            for (doc_id, row), first, after in zip(keys, bounds[:-1], bounds[1:]):
                ids = every[first:after]
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    out.append(
                        (doc_id, row, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                    )
            columns = zip(*out)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.mapInArrow(cut, PIECES)


def pack(cut: DataFrame, *, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Give every piece a sequence and an offset in it.

    Pieces are dealt by a hash of their row into partitions of Spark's advisory size, which it
    splits or joins as needed; each is packed on its own in hashed order, which best-fit with
    few bins needs (sorted lengths would close the wide bins too early). Each partition leaves
    at most `open_bins` sequences that are not full.
    """
    ship(cut.sparkSession)
    key = F.xxhash64("row", "piece")
    dealt = cut.withColumn("key", key).hint("rebalance", "key").sortWithinPartitions("key", "row", "piece").drop("key")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        packer = BestFit(length, open_bins)
        for batch in batches:
            places = [packer.place(n) for n in batch.column("length").to_pylist()]
            kept = batch.drop_columns(["row"])
            yield pa.RecordBatch.from_arrays(
                [
                    *kept.columns,
                    pa.array([base + number for number, _ in places], pa.int64()),
                    pa.array([offset for _, offset in places], pa.int64()),
                ],
                [*kept.schema.names, "sequence_id", "offset"],
            )

    return dealt.mapInArrow(place, PACKED)


def pack_documents(documents: DataFrame, tokenizer: str, *, with_ids: bool = False, **options) -> DataFrame:
    """Encode, cut and pack all documents; one row per piece.

    An empty table gives no rows; null and empty texts take one place; repeated rows are packed
    each; extra columns are not read.
    """
    packed = pack(pieces(documents, tokenizer, with_ids=with_ids, **options))
    return packed if with_ids else packed.drop("ids")
