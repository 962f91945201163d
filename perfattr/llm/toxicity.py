"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings, hashed. Those that tell the labels apart best become
features; the machine adds to their weights the products of their factors for every pair that
meets in a document, so that two terms may mean together what neither does alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm.common import bounded_sample, held_out, ship, slices, stored, text_bytes
from perfattr.llm.hashed import terms

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
FEATURES = 2048
FACTORS = 8
#: Labelled documents that the model is fitted on, at most.
MOST_LABELLED = 20_000
#: Squared surplus of toxic documents with a term over its expectation, at least.
LEAST_SURPLUS = 30.0


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of the products of their factors, in a sigmoid."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, feature: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents; each (feature, row) pair once."""
        total = np.bincount(row, weights=self.weights[feature], minlength=n) + self.bias
        for k in range(self.factors.shape[1]):
            own = self.factors[feature, k]
            both = np.bincount(row, weights=own, minlength=n)
            total += 0.5 * (both**2 - np.bincount(row, weights=own**2, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(feature: np.ndarray, first: np.ndarray, toxic: np.ndarray, features: int, seed: int = 0) -> Machine:
    """Logistic loss by Adam; document k has the features feature[first[k]:first[k + 1]]."""
    random = np.random.default_rng(seed)
    share = np.clip(toxic.mean() if len(toxic) else 0.5, 1e-3, 1 - 1e-3)
    # Parameters in one row per feature: weight, then factors; the last row's weight is the bias.
    table = np.zeros((features + 1, 1 + FACTORS))
    table[:features, 1:] = random.normal(0, 0.05, (features, FACTORS))
    table[features, 0] = np.log(share / (1 - share))
    if not len(toxic) or toxic.all() or not toxic.any():
        return Machine(float(table[features, 0]), table[:features, 0], table[:features, 1:] * 0)
    mean, square = np.zeros_like(table), np.zeros_like(table)
    sizes = np.diff(first)
    step, batch = 0, 256
    epochs = max(8, min(200, 400_000 // len(toxic)))
    for _ in range(epochs):
        order = random.permutation(len(toxic))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            row = np.repeat(np.arange(len(docs)), sizes[docs])
            inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes[docs]) - sizes[docs], sizes[docs])
            own = feature[np.repeat(first[docs], sizes[docs]) + inside]
            v = table[own, 1:]
            both = np.stack([np.bincount(row, weights=v[:, k], minlength=len(docs)) for k in range(FACTORS)], 1)
            total = table[features, 0] + np.bincount(row, weights=table[own, 0], minlength=len(docs))
            pairs = 0.5 * ((both**2).sum(1) - np.bincount(row, weights=(v**2).sum(1), minlength=len(docs)))
            score = 1 / (1 + np.exp(-np.clip(total + pairs, -30, 30)))
            error = (score - toxic[docs]) / len(docs)
            gradient = 1e-4 * table
            gradient[features] = 0
            gradient[features, 0] = error.sum()
            gradient[:features, 0] += np.bincount(own, weights=error[row], minlength=features)
            slope = error[row][:, None] * (both[row] - v)
            for k in range(FACTORS):
                gradient[:features, 1 + k] += np.bincount(own, weights=slope[:, k], minlength=features)
            step += 1
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient**2 - square)
            table -= 0.02 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Machine(float(table[features, 0]), table[:features, 0].copy(), table[:features, 1:].copy())


def _distinct(found: np.ndarray, row: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(row * buckets + found)
    return both % buckets, both // buckets


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        found, row = _distinct(*terms(*text_bytes(batch.column("text")), BUCKETS, PREFIXES), BUCKETS)
        bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), lists], ["doc_id", "toxic", "terms"]
        )


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, machine = model.value
        for batch in slices(batches, "text", 1 << 20):
            found, row = terms(*text_bytes(batch.column("text")), BUCKETS, PREFIXES)
            found = number[found]
            known = found >= 0
            found, row = _distinct(found[known].astype(np.int64), row[known], max(1, len(machine.weights)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(machine.scores(found, row, batch.num_rows), pa.float64()),
                ],
                ["doc_id", "held_out", "score"],
            )

    return score


def train(documents: DataFrame, labels: DataFrame, *, most_labelled: int = MOST_LABELLED) -> tuple[np.ndarray, Machine]:
    """(feature number of each bucket or -1, machine), from documents (doc_id, text) not held out.

    The sample is bounded by `most_labelled`; of it the features' numbers alone reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.dropna().where(~held_out(F.col("doc_id")))
    known = bounded_sample(known, "doc_id", most_labelled)
    known = stored(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labelled")
    sample = documents.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text")  # bounded as above
    sample = stored(sample.mapInArrow(_terms, "doc_id long, toxic int, terms array<int>"), "terms")
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    each = sample.select((F.col("toxic") == 1).cast("long").alias("toxic"), F.explode("terms").alias("term"))
    seen = each.groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("a"))
    # Squared surplus of toxic documents over its expectation: chi-square of one cell.
    share = positive / n if n else 0.0
    surplus = (F.col("a") - F.col("n") * share) ** 2 / (F.col("n") * (share * (1 - share) + 1e-9))
    apart = seen.withColumn("surplus", surplus).where(F.col("surplus") >= LEAST_SURPLUS)
    best = apart.orderBy(F.desc("surplus"), "term").limit(FEATURES).select("term")
    chosen = np.array(sorted(r[0] for r in best.collect()), np.int64)
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    rows = sample.mapInArrow(_only(chosen), "toxic int, terms array<int>").collect()
    first = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int64)
    feature = number[np.array([x for r in rows for x in r[1]], np.int64)].astype(np.int64)
    toxic = np.array([r[0] == 1 for r in rows], float)
    return number, fit(feature, first, toxic, len(chosen))


def _only(chosen: np.ndarray):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("terms")
            values = lists.flatten().to_numpy()
            sizes = np.asarray(lists.value_lengths())
            kept = np.isin(values, chosen)
            row = np.repeat(np.arange(len(lists)), sizes)[kept]
            bounds = np.searchsorted(row, np.arange(len(lists) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values[kept], pa.int32())),
                ],
                ["toxic", "terms"],
            )

    return cut


def toxicity(
    documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """One row per document: doc_id, held_out, score from 0 to 1, predicted.

    Labels are learned from documents whose crc32(id) mod 5 is not 0. Null and empty texts score as
    the bias alone; a null id is not held out and never labelled. Several labels of one id: toxic if
    any says so. Repeated rows get a row each. Without labels of both kinds the score is their share.
    Extra columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    model = spark.sparkContext.broadcast(train(rows, labels, **options))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        _scorer(model), "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
