"""Repeated passages by content-defined chunking.

A gear hash of the last 32 bytes rolls over the text; where its high bits are zero a chunk may
end. A cut closer than 8 bytes to the possible cut before it is left out. Whether a place is cut
depends on the 40 bytes before it only, so an insertion moves no cut beyond it. Chunks whose
digest occurs more than once in the corpus are repeated; runs of them of some length are passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm import words
from perfattr.llm.common import ship, slices, stored, text_bytes

GEAR_BITS = 5
LEAST_CHUNK = 8
MOST_CHUNK = 256
LEAST_PASSAGE = 80
_WINDOW = 32

_GEAR = (words.mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of G[byte] << age over the last 32 bytes, modulo 2^32.

    The sum over 2k bytes is that over k bytes plus the one k bytes before, shifted by k.
    """
    rolled = _GEAR[data]
    age = 1
    while age < _WINDOW:
        older = rolled[:-age] << np.uint32(age)
        rolled = rolled.copy()
        rolled[age:] += older
        age *= 2
    return rolled


def chunk_ends(
    data: np.ndarray, offsets: np.ndarray, bits: int = GEAR_BITS, least: int = LEAST_CHUNK, most: int = MOST_CHUNK
) -> np.ndarray:
    """Ends of the chunks of all rows, ascending; every row's end is one (of empty rows, none).

    They lie between characters.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    places = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1
    row = np.searchsorted(offsets, places, side="left") - 1
    inside = places - offsets[row] >= _WINDOW
    places, row = places[inside], row[inside]
    near = np.zeros(len(places), bool)
    near[1:] = (np.diff(places) < least) & (row[1:] == row[:-1])
    cuts = np.unique(np.concatenate([_at_characters(data, places[~near]), offsets[1:][np.diff(offsets) > 0]]))
    gaps = np.diff(cuts, prepend=0)
    more = (gaps - 1) // most
    if more.any():
        extra = np.repeat(np.arange(len(cuts)), more)
        step = np.arange(len(extra)) - np.repeat(np.cumsum(more) - more, more) + 1
        forced = _at_characters(data, cuts[extra] - gaps[extra] + step * most)
        cuts = np.unique(np.concatenate([cuts, forced]))
    return cuts


def _at_characters(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places, moved behind the UTF-8 character that they are in."""
    for _ in range(3):
        inside = places < len(data)
        inside[inside] = data[places[inside]] & 0xC0 == 0x80
        places = places + inside
    return places


_CHUNKS = "row long, doc_id long, digests array<long>, ends array<int>"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        data, offsets = text_bytes(batch.column("text"))
        ends = chunk_ends(data, offsets)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        digests = words.hashes(data, starts, ends).view(np.int64)
        bounds = np.searchsorted(ends, offsets, side="right")
        lists = pa.array(bounds, pa.int32())
        own = ends - np.repeat(offsets[:-1], np.diff(bounds))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                pa.ListArray.from_arrays(lists, pa.array(digests, pa.int64())),
                pa.ListArray.from_arrays(lists, pa.array(own, pa.int32())),
            ],
            ["row", "doc_id", "digests", "ends"],
        )


_SPANS = "array<struct<start:long,length:long>>"
_PASSAGES = (
    "row long, doc_id long, n_bytes long, n_chunks long, n_repeated_bytes long, n_removed_bytes long, "
    f"repeated boolean, passages {_SPANS}, removed {_SPANS}"
)


def _runs(flags: np.ndarray) -> np.ndarray:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])


def _passages(least: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("row", "doc_id", "digests", "ends", "marks")]
            for row, doc_id, digests, ends, marks in zip(*columns):
                row, doc_id = row.as_py(), doc_id.as_py()
                ends = ends.values.to_numpy()
                starts = np.concatenate([[0], ends]).astype(np.int64)
                size, n = int(starts[-1]), len(ends)
                if not marks.is_valid:
                    rows.append((row, doc_id, size, n, 0, 0, False, [], []))
                    continue
                at = marks.values.field("k").to_numpy()
                order = np.argsort(at)
                at = at[order]
                first_row = marks.values.field("first_row").to_numpy()[order]
                repeated = np.zeros(n, bool)
                repeated[at] = True
                kept = np.zeros(n, bool)
                _, first = np.unique(digests.values.to_numpy()[at], return_index=True)
                kept[at[first]] = first_row[first] == row
                found, gone = [], []
                for a, b in _runs(repeated).tolist():
                    if starts[b] - starts[a] >= least:
                        found.append((int(starts[a]), int(starts[b] - starts[a])))
                        for x, y in (_runs(~kept[a:b]) + a).tolist():
                            gone.append((int(starts[x]), int(starts[y] - starts[x])))
                rows.append(
                    (row, doc_id, size, n, sum(x[1] for x in found), sum(x[1] for x in gone), bool(found), found, gone)
                )
            columns = list(zip(*rows)) or [()] * 9
            types = [pa.int64()] * 6 + [pa.bool_(), span, span]
            columns[7:] = [[[{"start": a, "length": b} for a, b in x] for x in c] for c in columns[7:]]
            names = [c.split()[0] for c in _PASSAGES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return find


def repeated_passages(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_passage: int = LEAST_PASSAGE,
) -> DataFrame:
    """One row per document: sizes, repeated passages and what of them to remove (byte spans of the UTF-8 text).

    A chunk is repeated if its digest occurs again, in any document or the same. Runs of
    `least_passage` bytes or more of repeated chunks are passages; of every chunk in one, the first
    occurrence stays (the earliest row read, there the earliest place) and the others are to be removed.
    A passage found is up to 40 bytes and a chunk shorter than the repeated text at its front and a
    chunk at its end. Null and empty texts have no chunks. Repeated rows count as documents of their
    own. An empty table gives no rows; extra columns are not read.
    """
    ship(documents.sparkSession)
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).alias("text"),
    )
    chunks = stored(rows.mapInArrow(_chunked, _CHUNKS), "chunks")
    each = chunks.select("row", F.posexplode("digests").alias("k", "digest"))
    counts = each.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    again = stored(counts.where("n > 1").select("digest", "first_row"), "again")
    marks = each.join(again, "digest").groupBy("row").agg(F.collect_list(F.struct("k", "first_row")).alias("marks"))
    return chunks.join(marks, "row", "left").mapInArrow(_passages(least_passage), _PASSAGES)


def without_spans(text, spans):
    """SQL: the text without the byte spans, which begin and end between characters."""
    data = F.encode(text, "UTF-8")
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s.start + s.length))
    tos = F.concat(F.transform(spans, lambda s: s.start), F.array(F.octet_length(text).cast("long")))
    parts = F.transform(
        F.arrays_zip(froms.alias("a"), tos.alias("b")),
        lambda p: F.substring(data, (p.a + 1).cast("int"), (p.b - p.a).cast("int")),
    )
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return F.decode(joined, "UTF-8")
