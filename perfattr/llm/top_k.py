"""Exact top-k inner products with block-at-a-time pruning.

A vector's components are integer weights of terms (its dimensions). Vectors are laid out in
blocks of similar ones; a block has its terms' greatest and least weights and a forward index,
the matrix of its rows. For each query the sum of its terms' maxima over a block (of the minima,
where the query's weight is negative) bounds every score in it. A task visits its blocks in the
order of the bounds and scores a block by its forward index, until the bounds fall below the
k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfattr.llm.common import scratch, ship, stored

SCALE = 256
BLOCK = 256
K = 5
#: Queries that are sent to the tasks at a time.
QUERIES = 4096
_PLANES = 10


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor empty and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), width)


def _keys(vectors: np.ndarray) -> np.ndarray:
    """A short key that similar vectors share: their signs on fixed random planes, as a Gray code's rank."""
    random = np.random.default_rng(7)
    signs = vectors @ random.normal(size=(vectors.shape[1], _PLANES)) > 0
    rank = np.bitwise_xor.accumulate(signs, axis=1)
    return rank @ (1 << np.arange(_PLANES - 1, -1, -1))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vector")
        widths = np.asarray(lists.value_lengths())
        keys = np.zeros(len(widths), np.int64)
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            keys[own] = _keys(_matrix(lists.take(pa.array(own)), width).astype(float))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "near"])


_BLOCKS = "width int, n int, ids binary, rows binary, most binary, least binary"


def _blocks(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("vector").value_lengths())
            for width in np.unique(widths).tolist():
                own = batch.take(pa.array(np.flatnonzero(widths == width)))
                ids = np.asarray(own.column("vec_id"), np.int64)
                rows = _matrix(own.column("vector"), width)
                parts = [(ids[a : a + size], rows[a : a + size]) for a in range(0, len(ids), size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([width] * len(parts), pa.int32()),
                        pa.array([len(i) for i, _ in parts], pa.int32()),
                        pa.array([i.tobytes() for i, _ in parts], pa.binary()),
                        pa.array([x.tobytes() for _, x in parts], pa.binary()),
                        pa.array([x.max(axis=0).tobytes() for _, x in parts], pa.binary()),
                        pa.array([x.min(axis=0).tobytes() for _, x in parts], pa.binary()),
                    ],
                    ["width", "n", "ids", "rows", "most", "least"],
                )

    return cut


def index(vectors: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Blocks of the rows (vec_id, vector of longs), similar vectors together; stored."""
    ship(vectors.sparkSession)
    keyed = vectors.mapInArrow(_ordered, "vec_id long, vector array<long>, near long")
    # The id is part of the range key, so vectors with the same signs are dealt to many tasks.
    spread = keyed.repartitionByRange("near", F.xxhash64("vec_id")).sortWithinPartitions("near", "vec_id")
    return stored(spread.mapInArrow(_blocks(block), _BLOCKS), "blocks")


def scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products (queries x rows), exact: as floats while they stay below 2^53."""
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    if largest < 2.0**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


def best_of_blocks(blocks: list[tuple], queries: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple]:
    """The task's k best (query, score, id) of each query; blocks are (ids, rows, most, least).

    All queries take their next block in the order of their own bounds; those that want the same block
    in a round are scored together.
    """
    most, least = (np.array([b[j] for b in blocks]) for j in (2, 3))
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = scores(most, positive) + scores(least, negative)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    lowest = -(1 << 62)  # its negative is a long too
    top = np.full((n, k), lowest)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    live = np.arange(n)
    for turn in range(len(blocks)):
        wanted = order[live, turn]
        # A block whose bound equals the k-th score may hold a tie with a smaller id.
        open_ = (bounds[live, wanted] >= top[live, k - 1]) | (top[live, k - 1] == lowest)
        live, wanted = live[open_], wanted[open_]
        if not len(live):
            break
        by = np.argsort(wanted, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(wanted[by])) + 1):
            block_ids, rows = blocks[wanted[own[0]]][:2]
            who = live[own]
            found = scores(rows, queries[who])
            found = np.where(block_ids[None, :] == query_ids[who][:, None], lowest, found)
            both = np.concatenate([top[who], found], axis=1)
            names = np.concatenate([ids[who], np.broadcast_to(block_ids, found.shape)], axis=1)
            names = np.where(both == lowest, np.iinfo(np.int64).max, names)
            pick = np.lexsort((names, -both), axis=1)[:, :k]
            top[who] = np.take_along_axis(both, pick, axis=1)
            ids[who] = np.take_along_axis(names, pick, axis=1)
    q, place = np.nonzero(top > lowest)
    return list(zip(q.tolist(), top[q, place].tolist(), ids[q, place].tolist()))


_FOUND = "query_id long, score long, vec_id long"


def _searcher(known, k: int, width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = known.value

        def result(blocks):
            found = best_of_blocks(blocks, queries, query_ids, k)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(query_ids[[f[0] for f in found]] if found else [], pa.int64()),
                    pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                ],
                ["query_id", "score", "vec_id"],
            )

        blocks, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["width"] == width:
                    rows = np.frombuffer(r["rows"], np.int64).reshape(r["n"], width)
                    ids, most, least = (np.frombuffer(r[c], np.int64) for c in ("ids", "most", "least"))
                    blocks.append((ids, rows, most, least))
                    held += rows.nbytes
            if held > 64 << 20:
                yield result(blocks)
                blocks, held = [], 0
        if blocks:
            yield result(blocks)

    return search


def top_k(
    queries: DataFrame,
    candidates: DataFrame,
    *,
    k: int = K,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    queries_at_once: int = QUERIES,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates but its own id, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null, empty or hold null or non-finite
    components, and rows with a null id, take no part; vectors of different lengths do not meet. Every row of the
    candidates takes a rank of its own, also one that repeats another; repeated queries count once. The queries
    are a stated set; they are sent in groups of `queries_at_once`. A group runs over all blocks and its
    results are stored before the next one is sent, so the driver and the tasks hold one group at a time.
    """
    spark = candidates.sparkSession
    ship(spark)

    def prepared(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select(
            "vec_id", quantised(F.col("vector"), scale).alias("vector")
        )

    blocks = index(prepared(candidates), block=block)
    asked = stored(prepared(queries).distinct().withColumn("width", F.size("vector")), "queries")
    sizes = asked.groupBy("width").count().collect()
    found = scratch(spark, "found")
    for width, n in sorted((r.width, r["count"]) for r in sizes):
        groups = -(-n // queries_at_once)
        group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
        for g in range(groups):
            rows = asked.where((F.col("width") == width) & (group == g)).orderBy("vec_id").collect()
            ids = np.array([r.vec_id for r in rows], np.int64)
            some = np.array([r.vector for r in rows], np.int64).reshape(len(rows), width)
            known = spark.sparkContext.broadcast((ids, some))
            best = blocks.mapInArrow(_searcher(known, k, width), _FOUND)
            best.write.mode("append").parquet(found)
            known.destroy()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = spark.read.schema(_FOUND).parquet(found)
    # k rows a query and task: few.
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
