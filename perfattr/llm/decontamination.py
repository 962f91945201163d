"""Passages of a benchmark in training text, found with an FM-index of each shard of text.

A shard is a run of whole documents of a few MB. Its words become numbers: those of the
benchmark's vocabulary from 1 on, any other word is a barrier (0), as is the end of a document.
Barriers differ from each other, so a suffix ends at the first one, and runs of words between
barriers that are shorter than the shortest phrase cannot hold one and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm import words
from perfattr.llm.common import ship, slices, text_bytes

WINDOW = 10
#: Bytes of benchmark text that are searched for in one pass over the documents.
BLOCK_BYTES = 32 << 20
_SAMPLED = 8


class Bits:
    """A bit vector with constant-time counts of set bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Counts of any symbol before any position, a level for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.depth = max(1, (alphabet - 1).bit_length())
        self.levels, self.zeros = [], []
        for shift in range(self.depth - 1, -1, -1):
            bit = (symbols >> shift) & 1 != 0
            self.levels.append(Bits(bit))
            self.zeros.append(len(symbols) - int(np.count_nonzero(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(alphabet)
        self.first = self._descend(every, np.zeros(alphabet, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            bit = (symbols >> (self.depth - 1 - level)) & 1 != 0
            at = np.where(bit, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._descend(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its count before it."""
        symbols = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            bit = bits.get(at)
            ones = bits.rank(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbols = symbols << 1 | bit
        return symbols, at - self.first[symbols]


def suffix_ranks(text: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Place of each suffix among all, by doubling the compared length of those still tied.

    0 is a barrier, ordered by position; the text ends with one. counts: of each symbol.
    """
    n = len(text)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    rank = before[text]
    barriers = text == 0
    rank[barriers] = np.arange(int(counts[0]))
    tied = np.flatnonzero(~barriers & (counts[text] > 1))
    length = 1
    while len(tied):
        key = rank[tied] * n + rank[tied + length]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        old = rank[tied]
        place = np.arange(len(tied))
        apart = np.ones(len(tied) + 1, bool)
        apart[1:-1] = key[1:] != key[:-1]
        group = np.ones(len(tied), bool)
        group[1:] = old[1:] != old[:-1]
        in_new = np.maximum.accumulate(np.where(apart[:-1], place, 0))
        in_old = np.maximum.accumulate(np.where(group, place, 0))
        rank[tied] = old + in_new - in_old
        tied = tied[~(apart[:-1] & apart[1:])]
        length *= 2
    return rank


class FMIndex:
    """Counts and places of phrases in a text of small integers whose barriers are 0."""

    def __init__(self, text: np.ndarray, alphabet: int):
        n = len(text)
        counts = np.bincount(text, minlength=alphabet)
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        rank = suffix_ranks(text, counts)
        suffixes = np.empty(n, np.int64)
        suffixes[rank] = np.arange(n)
        last = text[suffixes - 1]
        self.tree = WaveletMatrix(last, alphabet)
        sampled = (suffixes % _SAMPLED == 0) | (last == 0)
        self.sampled = Bits(sampled)
        self.samples = suffixes[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase, read from its end.

        phrases: one a row, filled up with 0 on the left.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(1, phrases.shape[1] + 1 if len(phrases) else 1):
            live = live[(lengths[live] >= k) & (low[live] < high[live])]
            symbols = phrases[live, -k]
            low[live] = self.before[symbols] + self.tree.rank(symbols, low[live])
            high[live] = self.before[symbols] + self.tree.rank(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix: step back to the next sampled one."""
        out = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows, 0
        while len(live):
            known = self.sampled.get(at)
            out[live[known]] = self.samples[self.sampled.rank(at[known])] + steps
            live, at = live[~known], at[~known]
            symbols, count = self.tree.access(at)
            at = self.before[symbols] + count
            steps += 1
        return out


@dataclass
class Phrases:
    """The distinct windows of a block of the benchmark."""

    vocabulary: np.ndarray  # sorted hashes; word number k + 1
    maybe: np.ndarray  # by the low 16 bits of a hash: whether a word may be of the vocabulary
    phrases: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # items of phrase k: items[first[k]:first[k + 1]]
    items: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, rows: list[tuple[str, str]], window: int) -> "Phrases":
        data, offsets = text_bytes(pa.array([text for _, text in rows], pa.large_string()))
        starts, ends, found = _words(data, offsets)
        vocabulary, number = np.unique(found, return_inverse=True)
        number = number.astype(np.int64) + 1
        bounds = words.rows_of(starts, offsets)
        names = sorted({name for name, _ in rows})
        place = {name: k for k, name in enumerate(names)}
        cut, items = [], []
        for (name, _), low, high in zip(rows, bounds[:-1], bounds[1:]):
            size = min(window, high - low)
            if size:
                part = np.lib.stride_tricks.sliding_window_view(number[low:high], size)
                cut.append(np.pad(part, ((0, 0), (window - size, 0))))
                items.append(np.full(len(part), place[name]))
        if cut:
            both = np.column_stack([np.concatenate(cut), np.concatenate(items)])
            both = np.unique(both, axis=0)
        else:
            both = np.zeros((0, window + 1), np.int64)
        new = np.ones(len(both), bool)
        new[1:] = (both[1:, :-1] != both[:-1, :-1]).any(axis=1)
        phrases = both[new, :-1]
        maybe = np.zeros(1 << 16, bool)
        maybe[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        return cls(
            vocabulary,
            maybe,
            phrases,
            (phrases > 0).sum(axis=1),
            np.append(np.flatnonzero(new), len(both)),
            both[:, -1],
            names,
        )


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = words.lower(data)
    starts, ends = words.spans(data, offsets, words.ALPHANUMERIC)
    return starts, ends, words.hashes(data, starts, ends)


def find(data: np.ndarray, offsets: np.ndarray, known: Phrases) -> tuple[np.ndarray, list, list]:
    """Of each document: number of words; hit runs (first word, after, first byte, after); items."""
    starts, ends, found = _words(data, offsets)
    bounds = words.rows_of(starts, offsets)
    n = len(offsets) - 1
    counts = np.diff(bounds)
    runs, items = [[] for _ in range(n)], [[] for _ in range(n)]
    if not len(known.phrases) or not len(found):
        return counts, runs, items
    number = np.zeros(len(found), np.int64)
    maybe = np.flatnonzero(known.maybe[(found & np.uint64(0xFFFF)).astype(np.int64)])
    place = np.minimum(np.searchsorted(known.vocabulary, found[maybe]), len(known.vocabulary) - 1)
    number[maybe] = np.where(known.vocabulary[place] == found[maybe], place + 1, 0)

    inside = number > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(found)]
    first[heads] = inside[heads]
    run = np.cumsum(first) - 1
    sizes = np.bincount(run[inside], minlength=int(first.sum()))
    kept = np.flatnonzero(inside)
    kept = kept[sizes[run[kept]] >= known.lengths.min()]
    if not len(kept):
        return counts, runs, items
    opens = first[kept]
    where = np.arange(len(kept)) + np.cumsum(opens)
    text = np.zeros(len(kept) + int(opens.sum()) + 1, np.int64)
    text[where] = number[kept]
    word_at = np.zeros(len(text), np.int64)
    word_at[where] = kept

    index = FMIndex(text, len(known.vocabulary) + 1)
    low, high = index.search(known.phrases, known.lengths)
    times = high - low
    total = int(times.sum())
    if not total:
        return counts, runs, items
    phrase = np.repeat(np.arange(len(times)), times)
    rows = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    begin = word_at[index.locate(rows)]
    change = np.bincount(begin, minlength=len(found) + 1)
    change -= np.bincount(begin + known.lengths[phrase], minlength=len(found) + 1)
    hit = np.cumsum(change)[:-1] > 0

    document = np.searchsorted(bounds, begin, side="right") - 1
    pairs = np.unique(document * len(times) + phrase)
    for pair in pairs.tolist():
        doc, k = divmod(pair, len(times))
        items[doc] += known.items[known.first[k] : known.first[k + 1]].tolist()
    for doc in np.unique(document).tolist():
        items[doc] = sorted({known.names[k] for k in items[doc]})
        at, to = int(bounds[doc]), int(bounds[doc + 1])
        edge = np.diff(np.concatenate([[0], hit[at:to].astype(np.int8), [0]]))
        base = int(offsets[doc])
        runs[doc] = [
            (a, b, int(starts[at + a]) - base, int(ends[at + b - 1]) - base)
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())
        ]
    return counts, runs, items


def merged(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Two lists of runs as one, runs that touch in words joined."""
    out: list[list] = []
    for run in sorted(a + b):
        if out and run[0] <= out[-1][1]:
            out[-1][1], out[-1][3] = max(out[-1][1], run[1]), max(out[-1][3], run[3])
        else:
            out.append(list(run))
    return [tuple(x) for x in out]


_RUNS = "array<struct<first_word:long,after_word:long,first_byte:long,after_byte:long>>"
_RUN_TYPE = pa.list_(
    pa.struct([(k, pa.int64()) for k in ("first_word", "after_word", "first_byte", "after_byte")])
)


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows as a struct `row` with `text`, `n_words`, `runs` of hit words and `items`.

    One pass over the documents for each block of the benchmark (cut by a hash of its rows to
    about `block_bytes`, so what is sent to the tasks is bounded); no shuffle of documents.
    Each input row gives one row, repeated ones too. Null or empty text has no words. Items
    without words match nothing; one without id is named "null"; repeated items count once.
    With an empty benchmark nothing is hit. A slice of text of 4 MB, or one longer document, is
    indexed at a time.
    """
    spark = documents.sparkSession
    ship(spark)
    wanted = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("item"),
        F.col(item_text).alias("text"),
    ).where(F.length("text") > 0)
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    others = [c for c in documents.columns if c != text_column]
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"),
        F.col(f"`{text_column}`").alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast(_RUNS).alias("runs"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    for k in range(blocks):
        texts = [(r.item, r.text) for r in wanted.where(block == k).collect()]
        known = spark.sparkContext.broadcast(Phrases.of(texts, window))

        def search(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                counts, runs, items = find(*text_bytes(batch.column("text")), known.value)
                runs = [merged([tuple(r.values()) for r in a or []], b) if a else b
                        for a, b in zip(batch.column("runs").to_pylist(), runs)]
                items = [sorted({*(a or []), *b}) for a, b in zip(batch.column("items").to_pylist(), items)]
                names = [f.name for f in _RUN_TYPE.value_type]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("text"),
                        pa.array(counts, pa.int64()),
                        pa.array([[dict(zip(names, r)) for r in x] for x in runs], _RUN_TYPE),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    ["row", "text", "n_words", "runs", "items"],
                )

        rows = rows.mapInArrow(search, rows.schema)
    return rows


def hit_words(runs="runs"):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r.after_word - r.first_word)


def report(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per document: words, hit words, benchmark items and their digest."""
    found = contamination(documents.select(id_column, options.get("text_column", "text")), benchmark, **options)
    return found.select(
        F.col(f"row.{id_column}").alias("doc_id"),
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """The documents with the hit runs cut out of their text; all rows and columns stay."""
    found = contamination(documents, benchmark, text_column=text_column, **options)
    end = F.octet_length("text")
    data = F.encode("text", "UTF-8")
    # The parts between the runs: from the end of one to the start of the next.
    froms = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r.after_byte))
    tos = F.concat(F.transform("runs", lambda r: r.first_byte), F.array(end.cast("long")))
    parts = F.transform(
        F.arrays_zip(froms.alias("a"), tos.alias("b")),
        lambda p: F.decode(F.substring(data, (p.a + 1).cast("int"), (p.b - p.a).cast("int")), "UTF-8"),
    )
    cut = F.when(F.size("runs") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    columns = [
        cut.alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in documents.columns
    ]
    return found.select(*columns)
