"""Importance resampling towards text of good quality.

Two generative models over hashed tokens and pairs of tokens, one of documents labelled good (the
target) and one of all documents (raw), give each document an importance weight: the mean log
ratio of its n-grams, taken for a piece of `LENGTH` n-grams so that documents of any length compare.
Weights perturbed by Gumbel noise are a sample without replacement; the k largest stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm.common import bounded_sample, keyed, ship, slices, stored, text_bytes, unpacked
from perfattr.llm.hashed import grams

BUCKETS = 1 << 14
#: Labelled documents that the target model and the threshold are fitted on, at most.
MOST_LABELLED = 20_000
LENGTH = 100
_SMOOTH = 0.5


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each bucket: in all documents, in good ones, in those labelled otherwise."""
    total = np.zeros((3, BUCKETS), np.int64)
    for batch in slices(batches, "text", 1 << 20):
        found, row = grams(*text_bytes(batch.column("text")), BUCKETS)
        label = np.asarray(batch.column("quality").fill_null(-1))[row]
        for k, some in enumerate((found, found[label == 1], found[label == 0])):
            total[k] += np.bincount(some, minlength=BUCKETS)
    used = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), *(pa.array(x[used], pa.int64()) for x in total)], ["bucket", "raw", "good", "bad"]
    )


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the target's share of each bucket over its raw share, with additive smoothing."""
    share = [(x + _SMOOTH) / (x.sum() + _SMOOTH * len(x)) for x in (target, raw)]
    return np.log(share[0]) - np.log(share[1])


def weights(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log ratio and number of the n-grams of each row; 0 for rows without any."""
    found, row = grams(data, offsets, len(ratios))
    n = np.bincount(row, minlength=len(offsets) - 1)
    total = np.bincount(row, weights=ratios[found], minlength=len(offsets) - 1)
    return total / np.maximum(n, 1), n


def cut_between(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the fewest labelled documents on the wrong side; 0 if one kind is missing.

    Documents of one score stay on one side. Of equally good thresholds, the middle of the widest gap.
    """
    if not len(scores) or good.all() or not good.any():
        return 0.0
    levels, at = np.unique(scores, return_inverse=True)
    n_good, n_bad = np.bincount(at, good), np.bincount(at, ~good)
    wrong = np.concatenate([[0], np.cumsum(n_good)]) + np.concatenate([np.cumsum(n_bad[::-1])[::-1], [0]])
    edges = np.concatenate([[levels[0] - 1], levels, [levels[-1] + 1]])
    best = np.flatnonzero(wrong == wrong.min())
    gaps = edges[best + 1] - edges[best]
    k = best[np.argmax(gaps)]
    return float((edges[k] + edges[k + 1]) / 2)


_SCORED = "doc_id long, text_key long, n_grams long, log_ratio double, quality int"


def _scorer(ratios):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            mean, n = weights(*text_bytes(batch.column("text")), ratios.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(n, pa.int64()),
                    pa.array(mean, pa.float64()),
                    batch.column("quality"),
                ],
                ["doc_id", "text_key", "n_grams", "log_ratio", "quality"],
            )

    return score


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a column of non-negative longs, 16 bits at a time.

    Each round counts rows by the next 16 bits: 65,536 counts at most reach the driver.
    """
    prefix, shift = 0, 48
    while True:
        part = rows.where(F.shiftright(column, shift + 16) == prefix) if shift < 48 else rows
        digit = F.shiftright(column, shift).bitwiseAND(0xFFFF).alias("digit")
        counts = sorted(part.groupBy(digit).count().collect(), reverse=True)
        for digit, n in counts:
            if k <= n:
                break
            k -= n
        prefix = prefix << 16 | digit
        if not shift:
            return prefix
        shift -= 16


def selection(
    documents: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int | None = None,
    most_labelled: int = MOST_LABELLED,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, n_grams, log_ratio, key and kept.

    The raw model counts all documents; the target model and the threshold use a sample of at
    most `most_labelled` labelled ones. `k` documents with the largest keys stay (ties with the last
    all stay); by default as many as have a log ratio above the threshold, so noise decides near the
    threshold only. Null and empty texts have no n-grams and are never kept. Several labels of one id:
    the least counts; a null label is none. Without good labels all ratios are 0 and every text with
    words is kept. Repeated rows share their noise. Extra columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna()
    known = bounded_sample(known, "doc_id", most_labelled)
    known = stored(known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), "labelled")
    rows = documents.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_key"),
        F.col(text_column).alias("text"),
    ).join(F.broadcast(known), "doc_id", "left")  # at most `most_labelled` rows of 12 bytes

    counts = rows.select("text", "quality").mapInArrow(_counted, "bucket int, raw long, good long, bad long")
    total = np.zeros((3, BUCKETS), np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("good"), F.sum("bad")).collect():
        total[:, r[0]] = r[1:]
    ratios = log_ratios(total[0], total[1]) if total[1].any() else np.zeros(BUCKETS)
    shared = spark.sparkContext.broadcast(ratios)

    scored = stored(rows.select("doc_id", "text_key", "text", "quality").mapInArrow(_scorer(shared), _SCORED), "scored")
    sample = scored.where("quality is not null and n_grams > 0").select("log_ratio", "quality").collect()
    values = np.array([r[0] for r in sample], float)
    threshold = cut_between(values, np.array([r[1] == 1 for r in sample], bool))
    # Uniform in (0, 1) by a hash of the document; -log(-log(u)) is Gumbel noise.
    uniform = (F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    keyed = scored.where("n_grams > 0").withColumn(
        "key", F.col("log_ratio") * LENGTH - F.log(-F.log(uniform))
    )
    # The key as a non-negative long in the same order: keys lie far within +-2^21.
    place = F.round((F.col("key") + (1 << 21)) * (1 << 40)).cast("long")
    if k is None:
        k = keyed.where(F.col("log_ratio") >= threshold).count()
    else:
        k = min(k, keyed.count())
    least = kth_largest(keyed.select(place.alias("place")), "place", k) if k else None
    key = F.when(F.col("n_grams") > 0, F.col("log_ratio") * LENGTH - F.log(-F.log(uniform)))
    kept = (F.round((key + (1 << 21)) * (1 << 40)).cast("long") >= least) if k else F.lit(False)
    return scored.select(
        "doc_id", "n_grams", "log_ratio", key.alias("key"), F.coalesce(kept, F.lit(False)).alias("kept"), "text_key"
    )


def selected(documents: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options):
    """The documents that stay, with all their columns."""
    found = selection(documents, labels, id_column=id_column, text_column=text_column, **options)
    kept = stored(found.where("kept").select("doc_id", "text_key").distinct(), "kept")
    rows = keyed(documents, id_column, text_column)
    same = (rows.key == kept.text_key) & rows.id.eqNullSafe(kept.doc_id)
    return unpacked(rows.join(kept, same, "left_semi"), documents.columns)
