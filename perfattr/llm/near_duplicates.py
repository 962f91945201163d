"""Near duplicates by MinHash with odd sketches.

Each document's set of word shingles gives 128 MinHash samples. Bands of four samples are the
buckets in which candidates meet; the parity bitmap of all samples (an odd sketch) tells from a
population count of two bitmaps' XOR whether a candidate is worth comparing; links are confirmed
on the full sets. Two documents at a similarity of 0.75 share none of the 32 bands with
probability 5e-6, and the sketch, cut 0.3 below the threshold, loses fewer.

Copies of a set are one node. No bucket's pairs are enumerated: its nodes are compared with its
pivot first, the node that shares the largest buckets, which is the one that a family of near copies
was made from if that is there. Groups are joined, and only nodes outside their bucket's main group
are compared with the bucket, where finer sketches of these nodes decide inside the join.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfattr.llm import words
from perfattr.llm.common import keyed, ship, slices, stored, text_bytes, unpacked
from perfattr.llm.components import components, merged

SHINGLE = 5
#: The threshold as a fraction of whole numbers, so that it is exact.
THRESHOLD = (75, 100)
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: How far below the threshold a sketch's estimate may lie: over five standard deviations.
SLACK = 0.3
#: Finer sketches for nodes that a pivot did not settle. Up to this many shingles the parity bitmap is of the set
#: itself: its XOR count never exceeds the number of shingles in which two sets differ, so no link is lost by it.
FINE_BITS, WHOLE_SET = 4096, 2048
#: Larger sets: as above, with more samples.
FINE_SAMPLES, FINE_SLACK = 1024, 0.1
#: Pairs of one node that a task compares in a row.
PART = 128

_PERMUTED = 1 << 18


def _odd(n: int, seed: int) -> np.ndarray:
    return words.mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)


def shingle_set(found: np.ndarray, first: int, after: int, n: int = SHINGLE) -> np.ndarray:
    return np.unique(words.shingles(found, first, after, n))


def samples(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least value of the set under each of n permutations."""
    factors = _odd(n, 0xA0761D6478BD642F)[:, None]
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = _PERMUTED // n
    for at in range(0, len(shingles), step):
        np.minimum(out, (shingles[at : at + step] * factors).min(axis=1), out=out)
    return out


def odd_sketch(least: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the samples that fall on each bit, as signed 64-bit words."""
    return parity_bits(least + _odd(len(least), 0xE7037ED1A0B428DB), bits)


def parity_bits(values: np.ndarray, bits: int) -> np.ndarray:
    place = words.mixed(values) % np.uint64(bits)
    parity = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(bool), bitorder="little").view("<i8")


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit key of each band and its samples."""
    bands = least.reshape(-1, rows)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = words.mixed(key + bands[:, k])
    return key.view(np.int64)


def most_different_bits(similarity: float, n: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """XOR population count at which the estimate 1 + bits / 4n * ln(1 - 2 * count / bits) is `similarity`."""
    return math.ceil(bits / 2 * (1 - math.exp((similarity - 1) * 4 * n / bits)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        data, offsets = text_bytes(batch.column("text"))
        data = words.lower(data)
        starts, ends = words.spans(data, offsets, words.NOT_SPACE)
        found = words.hashes(data, starts, ends)
        bounds = words.rows_of(starts, offsets)
        sizes, keys, bands, sketches = [], [], [], []
        for first, after in zip(bounds[:-1], bounds[1:]):
            own = shingle_set(found, first, after)
            sizes.append(len(own))
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            least = samples(own) if len(own) else None
            bands.append(band_keys(least) if len(own) else None)
            sketches.append(odd_sketch(least) if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(sizes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(sketches, pa.list_(pa.int64())),
            ],
            ["row", "doc_id", "text_key", "n_shingles", "set_key", "bands", "sketch"],
        )


_SETS = "row long, doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, sketch array<long>"


def _fine_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        data, offsets = text_bytes(batch.column("text"))
        data = words.lower(data)
        starts, ends = words.spans(data, offsets, words.NOT_SPACE)
        found = words.hashes(data, starts, ends)
        bounds = words.rows_of(starts, offsets)
        sizes, sketches = [], []
        for first, after in zip(bounds, bounds[1:]):
            own = shingle_set(found, first, after)
            sizes.append(len(own))
            if len(own) <= WHOLE_SET:
                sketches.append(parity_bits(own, FINE_BITS))
            else:
                sketches.append(odd_sketch(samples(own, FINE_SAMPLES), FINE_BITS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
            ["node", "n", "fine"],
        )


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar; the rows of a pivot follow its own, which has no `a`."""
    least, of = THRESHOLD
    pivot = np.zeros(0, np.uint64)
    for batch in batches:
        pairs = []
        for part in slices([batch], "text", 1 << 20):
            data, offsets = text_bytes(part.column("text"))
            data = words.lower(data)
            starts, ends = words.spans(data, offsets, words.NOT_SPACE)
            found = words.hashes(data, starts, ends)
            bounds = words.rows_of(starts, offsets)
            nodes = zip(part.column("a").to_pylist(), part.column("b").to_pylist())
            for (a, b), first, after in zip(nodes, bounds, bounds[1:]):
                own = shingle_set(found, first, after)
                if a is None:
                    pivot = own
                    continue
                both = len(np.intersect1d(own, pivot, assume_unique=True))
                if of * both >= least * (len(own) + len(pivot) - both):
                    pairs.append((a, b))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[j] for p in pairs], pa.int64()) for j in range(2)], ["a", "b"]
        )


def _spread(row: Column) -> Column:
    """Row numbers in no meaningful order (a bijection by shifts)."""
    x = row + F.lit(0x2545F4914F6CDD1D)
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def _different_bits(a: str, b: str, bits: int) -> Column:
    counts = [F.bit_count(F.col(a).getItem(k).bitwiseXOR(F.col(b).getItem(k))) for k in range(bits // 64)]
    return sum(counts[1:], counts[0])


def _may_be_linked() -> Column:
    """Whether the sizes a_n and b_n and the finer sketches of two nodes allow a link.

    With s shingles in both sets, counted twice where shared, and d in which they differ, the similarity is
    (s - d) / (s + d), so d is at most s * (of - least) / (of + least).
    """
    least, of = THRESHOLD
    a, b = F.col("a_n"), F.col("b_n")
    bits = _different_bits("a_fine", "b_fine", FINE_BITS)
    most = most_different_bits(least / of - FINE_SLACK, FINE_SAMPLES, FINE_BITS)
    by_sketch = (
        F.when((a <= WHOLE_SET) & (b <= WHOLE_SET), bits * (of + least) <= (a + b) * (of - least))
        .when((a > WHOLE_SET) & (b > WHOLE_SET), bits <= most)
        .otherwise(True)
    )
    return (F.least(a, b) * of >= F.greatest(a, b) * least) & by_sketch


def _texts(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """`node` and `text` of nodes with a `text_key`."""
    # Equal keys are equal texts. Grouped by another hash, copies are reduced before the next
    # shuffle, and a key with many copies can be split in this one.
    # The same plan at every size: how many nodes share a bucket follows the corpus.
    texts = documents.join(nodes.select("text_key").hint("merge"), "text_key", "left_semi")
    texts = texts.groupBy(F.xxhash64("text_key", F.lit("text"))).agg(
        F.any_value("text_key").alias("text_key"), F.any_value("text").alias("text")
    )
    return stored(nodes.join(texts, "text_key").select("node", "text"), "texts")


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The stored pairs (a, b) of nodes whose full sets are similar; b may be the same in many pairs.

    Pairs are dealt by b in parts of about `PART`; the text of b goes to each part once.
    """
    parts = F.ceil(F.count("*") / PART).cast("long").alias("parts")
    sizes = stored(pairs.groupBy("b").agg(parts), "sizes")
    members = pairs.join(sizes, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    members = members.select("a", "b", "part").join(texts.toDF("a", "text"), "a")
    pivots = sizes.join(texts.toDF("b", "text"), "b")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = members.select("a", "b", "part", "text").unionByName(
        pivots.select(F.lit(None).cast("long").alias("a"), "b", "part", "text")
    )
    dealt = both.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    return stored(dealt.select("a", "b", "text").mapInArrow(_confirmed, "a long, b long"), "links")


def classes(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and its text's key.

    Documents are linked when 100 * intersection >= 75 * union of their distinct 5-word shingles
    (lower-cased A-Z, words apart by ASCII blanks; fewer words are one shingle).
    `component_id` is the smallest id that links lead to. Null, empty and blank texts have an empty set and no link.
    Repeated rows and equal texts share a class; an id that is null never is the smallest, and
    a component of such rows alone has a null id and is kept. Extra columns are not read.
    """
    return _labelled(documents, id_column, text_column).drop("component")


def _labelled(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """`classes` with `component`, which tells apart components without an id and those that repeat an id; it is null
    for empty sets."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_column).cast("long").alias("doc_id"),
        F.xxhash64(text_column).alias("text_key"),
        F.col(text_column).alias("text"),
    )
    sets = stored(rows.mapInArrow(_sketches, _SETS), "sets")

    filled = sets.where("n_shingles > 0")
    copies = stored(
        filled.groupBy("set_key").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id")), "copies"
    )
    nodes = stored(
        copies.join(filled.drop("set_key", "doc_id"), "row").withColumn("node", _spread(F.col("row"))), "nodes"
    )
    sketches = nodes.select("node", "sketch")
    texts = rows.select("text_key", "text")
    most = most_different_bits(THRESHOLD[0] / THRESHOLD[1] - SLACK)
    banded = nodes.select("node", F.explode("bands").alias("bucket"))

    # Every node with its bucket's pivot, the node whose buckets hold the most nodes in all.
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n"))
    sizes = stored(sizes.where("n > 1"), "sizes")
    shared = stored(banded.join(sizes, "bucket"), "shared")
    weights = stored(shared.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    pivots = shared.join(weights, "node").groupBy("bucket").agg(F.max_by("node", "weight").alias("pivot"))
    pivots = stored(pivots, "pivots")
    near = shared.join(pivots, "bucket").where("node != pivot")
    near = near.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = near.join(sketches.toDF("a", "a_sketch"), "a").join(sketches.toDF("b", "b_sketch"), "b")
    near = stored(near.where(_different_bits("a_sketch", "b_sketch", SKETCH_BITS) <= most).select("a", "b"), "near")
    texts = _texts(stored(nodes.select("node", "text_key").join(weights, "node", "left_semi"), "ends"), texts)
    edges = _links(near, texts)
    labels = components(edges)

    # Nodes outside the main group of a bucket, with that bucket's nodes of other groups.
    placed = shared.select("bucket", "node").join(labels, "node", "left")
    placed = stored(placed.select("bucket", "node", F.coalesce("component", "node").alias("component")), "placed")
    groups = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = groups.groupBy("bucket").agg(F.max_by("component", "n").alias("main"), F.count("*").alias("groups"))
    main = stored(main.where("groups > 1").select("bucket", "main"), "main")
    members = stored(placed.join(main, "bucket"), "members")
    open_ = stored(members.select("node").distinct(), "open")
    fine = texts.join(open_, "node", "left_semi").mapInArrow(_fine_sketches, "node long, n long, fine array<long>")
    fine = stored(fine, "fine")
    members = stored(members.join(fine, "node"), "members")
    columns = {"node": "", "component": "_group", "n": "_n", "fine": "_fine"}
    left = members.where("component != main")
    left = left.select("bucket", *[F.col(c).alias(f"a{name}") for c, name in columns.items()])
    right = members.select("bucket", "main", *[F.col(c).alias(f"b{name}") for c, name in columns.items()])
    rest = left.join(right, "bucket").where(
        (F.col("a_group") != F.col("b_group"))
        & ((F.col("b_group") == F.col("main")) | (F.col("a") < F.col("b")))
        & _may_be_linked()
    )
    rest = stored(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
    if not rest.isEmpty():
        labels = merged(labels, _links(rest, texts))

    known = copies.select("set_key", "least_id", _spread(F.col("row")).alias("node"))
    known = known.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stored(known, "known")
    smallest = stored(known.groupBy("component").agg(F.min("least_id").alias("component_id")), "smallest")
    named = stored(known.join(smallest, "component").select("set_key", "component", "component_id"), "named")
    found = sets.select("text_key", "doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    found = found.withColumn("component_id", own)
    return found.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_key",
        "component",
    )


def deduplicated(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, one of each group of linked texts: a row of the smallest id.

    Documents without words are linked with nothing and all stay. Of rows that repeat the id and
    the text of a group's smallest, one stays. Texts that are not linked all stay, also if they
    share an id or have none. All columns stay.
    """
    found = _labelled(documents, id_column, text_column)
    # The smallest id of a group, or null if it has no other, may have several texts there: the least key.
    first = found.where("n_shingles > 0 and kept").groupBy("component").agg(
        F.min(F.struct("text_key", F.col("doc_id").alias("component_id"))).alias("least"), F.count("*").alias("n")
    )
    first = stored(first.select("least.component_id", "least.text_key", "n"), "first")
    empty = stored(found.where("n_shingles = 0").select(F.col("text_key").alias("key")).distinct(), "empty")
    rows = keyed(documents, id_column, text_column)
    same = (rows.key == first.text_key) & rows.id.eqNullSafe(first.component_id)
    single = rows.join(first.where("n = 1"), same, "left_semi")
    several = rows.join(first.where("n > 1"), same, "left_semi").dropDuplicates(["id", "key"])
    blank = rows.join(empty, "key", "left_semi")
    return unpacked(single.unionByName(several).unionByName(blank), documents.columns)
