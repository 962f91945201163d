"""Which tokens of two tokenizers stand for the same bytes, scored over the whole corpus.

A text is encoded by a byte-level BPE (A, of a space and the text) and by a piece model (B, which
puts the space there itself). Bytes where tokens of both end cut the two sequences into groups; an A
and a B token are linked where their byte ranges overlap.

The corpus side is an inverted index. Documents are numbered within blocks; for each pair of ids
a block has the bitmap of the documents that link them, as sorted 16-bit places where these
are fewer bytes and as a bit set otherwise, and bit planes with the number of links in each of these
documents. Slices of a block are OR-merged into its bitmaps, and blocks share no document, so a pair's
document count is the sum of its bitmaps' popcounts: rows are summed, bitmaps never meet in one place.
Postings then meet their pair's count and return it to the documents they hold, block by block.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfattr.llm import words
from perfattr.llm.common import ship, slices, stored, text_bytes
from perfattr.llm.tokens import Table

#: Documents of a block; places fit 16 bits.
BLOCK = 1 << 13
#: A block also ends once its texts have this many bytes, so a task holds one block of this size.
BLOCK_BYTES = 16 << 20
#: Postings of more documents than this are bit sets.
DENSE = BLOCK // 16
#: Units of text whose alignment a worker keeps; beyond it starts anew.
KEPT_UNITS = 600_000
KEPT_BYTES = 96

INDEX = (
    "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, groups string, pair long, n_docs int, pair_links long, bitmap binary, planes binary"
)
_TYPES = {
    "block": pa.int64(), "place": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
    "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "groups": pa.string(),
    "pair": pa.int64(), "n_docs": pa.int32(), "pair_links": pa.int64(), "bitmap": pa.binary(), "planes": pa.binary(),
}

_pairs_of: dict[tuple[str, str], "Aligner"] = {}


# -- alignment of a text ------------------------------------------------------------------------


def _letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a space or line feed follows a character that is no white space: no token of either crosses it."""
    after = np.flatnonzero((data[1:] == 32) | (data[1:] == 10)) + 1
    last = data[after - 1]
    second, third = data[np.maximum(after - 2, 0)], data[np.maximum(after - 3, 0)]
    ascii_sign = (last > 32) & (last < 127)
    beyond = (last >= 128) & (second != 0xC2) & ((third < 0xE1) | (third > 0xE3))
    return after[ascii_sign | beyond]


def _grown(array: np.ndarray, n: int) -> np.ndarray:
    while n > len(array):
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class Lists:
    """Numbered lists in one array."""

    def __init__(self, kind: type):
        self.starts, self.values, self.n = np.zeros(1024, np.int64), np.zeros(4096, kind), 0

    def append(self, sizes: np.ndarray, values: np.ndarray) -> None:
        used = int(self.starts[self.n])
        self.values = _grown(self.values, used + len(values))
        self.starts = _grown(self.starts, self.n + len(sizes) + 1)
        self.values[used : used + len(values)] = values
        self.starts[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the given numbers one after the other, and the len(numbers) + 1 places where they begin."""
        low = self.starts[numbers]
        sizes = self.starts[numbers + 1] - low
        places = np.concatenate([[0], np.cumsum(sizes)])
        return self.values[np.repeat(low - places[:-1], sizes) + np.arange(places[-1])], places


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens whose byte ranges overlap; both tile the same bytes."""
    starts = np.concatenate([[0], ends_a[:-1]])
    first = np.searchsorted(ends_b, starts, side="right")
    sizes = np.searchsorted(ends_b, ends_a, side="left") + 1 - first
    at = np.concatenate([[0], np.cumsum(sizes)])
    a = np.repeat(np.arange(len(ends_a)), sizes)
    return a, np.arange(at[-1]) - at[a] + first[a]


class Aligner:
    """Alignment of parts of text, worked out once for each new part.

    Both tokenizers split a text at every bound of `_cuts`, as no token has white space after another sign, so a
    text's tokens, groups and links are those of its parts in order. A part whose tokens do not join
    to its own bytes marks the text, which is then encoded whole and compared as the contract says.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _letters_of_bytes()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.bytes_a = [b""] * self.n_a
        for piece, k in vocabulary.items():
            known = all(c in letters for c in piece)
            self.bytes_a[k] = bytes(letters[c] for c in piece) if known else piece.encode()
        self.bytes_b = []
        for k in range(self.n_b):
            piece = self.b.id_to_piece(k)
            own = bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()
            self.bytes_b.append(own)
        self.size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.blank = self.b.piece_to_id("▁")
        self._forget()

    def _forget(self) -> None:
        self.table = Table(KEPT_UNITS)
        self.links, self.groups = Lists(np.int64), Lists(np.uint8)
        self.counts = np.zeros((1024, 3), np.int64)
        self.odd = np.zeros(1024, bool)
        self.n = 0

    def _encoded(self, parts: list[bytes], whole: bool) -> tuple[list, list]:
        """Ids of parts that begin with a space or line feed; `whole`: of a space and a whole text."""
        texts = [x.decode(errors="replace") for x in parts]
        a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            if t == " " and not whole:
                b[k] = [self.blank]
            elif t[0] != " ":
                b[k] = b[k][1:] if b[k][:1] == [self.blank] else []
        return a, b

    def add(self, parts: list[bytes], whole: bool = False) -> np.ndarray:
        """Numbers of new parts."""
        every_a, every_b = self._encoded(parts, whole)
        numbers = np.arange(self.n, self.n + len(parts))
        self.counts = _grown(self.counts, self.n + len(parts))
        self.odd = _grown(self.odd, self.n + len(parts))
        for k, (part, a, b) in enumerate(zip(parts, every_a, every_b)):
            right = b"".join([self.bytes_a[x] for x in a]) == part and b"".join([self.bytes_b[x] for x in b]) == part
            self.odd[self.n + k] = not right
            if not right:
                every_a[k] = every_b[k] = []
        n_a = np.fromiter(map(len, every_a), np.int64, len(parts))
        n_b = np.fromiter(map(len, every_b), np.int64, len(parts))
        a = np.fromiter((x for y in every_a for x in y), np.int64, int(n_a.sum()))
        b = np.fromiter((x for y in every_b for x in y), np.int64, int(n_b.sum()))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        link_a, link_b = overlaps(ends_a, ends_b) if len(a) else (np.zeros(0, np.int64),) * 2
        of_a = np.repeat(np.arange(len(parts)), n_a)
        of_b = np.repeat(np.arange(len(parts)), n_b)
        n_links = np.bincount(of_a[link_a], minlength=len(parts))
        self.links.append(n_links, a[link_a] * self.n_b + b[link_b])
        # Both sequences end together at the last token of every group.
        closes_a, closes_b = np.isin(ends_a, ends_b), np.isin(ends_b, ends_a)
        n_groups = np.bincount(of_a[closes_a], minlength=len(parts))
        lines = _group_lines(a, closes_a, b, closes_b)
        spelt, at = [], 0
        for n in n_groups.tolist():
            spelt.append("".join(lines[at : at + n]).encode())
            at += n
        self.groups.append(
            np.fromiter(map(len, spelt), np.int64, len(spelt)), np.frombuffer(b"".join(spelt), np.uint8)
        )
        self.counts[numbers] = np.stack([n_a, n_b, n_groups], axis=1)
        self.n += len(parts)
        return numbers

    def rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the parts of the rows, in order, and the row of each; rows without tokens have none."""
        data, offsets = text_bytes(column)
        sizes = np.diff(offsets)
        filled = np.flatnonzero(sizes > 0)
        if not len(filled):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), offsets
        data = np.insert(data, offsets[:-1][filled], 32)
        begins = np.concatenate([[0], np.cumsum(sizes[filled] + 1)])
        inside = np.ones(len(data) + 1, bool)
        cuts = _cuts(data)
        inside[:] = False
        inside[cuts] = inside[begins] = True
        starts = np.flatnonzero(inside[:-1])
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(begins, starts, side="right") - 1
        hashes = words.hashes(data, starts, ends)
        if self.n > KEPT_UNITS:
            self._forget()
        found = self.table.find(hashes)
        missing = np.flatnonzero(found < 0)
        raw = data.tobytes()
        if len(missing):
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[first]
            short = ends[at] - starts[at] <= KEPT_BYTES
            numbers = self.add([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())])
            found[missing] = numbers[inverse]
            room = short & (np.cumsum(short) <= self.table.most - self.kept())
            self.table.keep(new[room], numbers[room])
        marked = np.unique(row[self.odd[found]])
        if len(marked):
            keep = ~np.isin(row, marked)
            whole = self.add([raw[begins[k] : begins[k + 1]] for k in marked.tolist()], whole=True)
            fits = ~self.odd[whole]
            found = np.concatenate([found[keep], whole[fits]])
            row = np.concatenate([row[keep], marked[fits]])
            order = np.argsort(row, kind="stable")
            found, row = found[order], row[order]
        return found, filled[row], offsets

    def kept(self) -> int:
        return int((self.table.places >= 0).sum())


def _group_lines(a: np.ndarray, closes_a: np.ndarray, b: np.ndarray, closes_b: np.ndarray) -> list[str]:
    """`a1,a2|b1;` of every group in order."""
    lines, at = [], 0
    a, b = list(map(str, a.tolist())), list(map(str, b.tolist()))
    ends = zip((np.flatnonzero(closes_a) + 1).tolist(), (np.flatnonzero(closes_b) + 1).tolist())
    low_a = low_b = at
    for high_a, high_b in ends:
        lines.append(f"{','.join(a[low_a:high_a])}|{','.join(b[low_b:high_b])};")
        low_a, low_b = high_a, high_b
    return lines


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner for two tokenizer files."""
    key = (path_a, path_b)
    if key not in _pairs_of:
        _pairs_of[key] = Aligner(path_a, path_b)
    return _pairs_of[key]


# -- bitmaps ------------------------------------------------------------------------------------


def _binary(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def posted(codes: np.ndarray, times: np.ndarray) -> dict[str, pa.Array]:
    """Postings of a block: `codes` are pair * BLOCK + place, ascending and distinct, linked `times` times each."""
    pair, place = codes // BLOCK, (codes % BLOCK).astype(np.uint16)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(pair)))
    of = np.repeat(np.arange(len(first)), n)
    dense = n >= DENSE
    sizes = np.where(dense, BLOCK // 8, 2 * n)
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(int(at[-1]), np.uint8)
    sparse = ~dense[of]
    rank = np.arange(len(pair)) - first[of] if len(pair) else np.zeros(0, np.int64)
    where = at[of[sparse]] + 2 * rank[sparse]
    data[where], data[where + 1] = place[sparse] & 0xFF, place[sparse] >> 8
    bits = place[~sparse].astype(np.int64)
    np.bitwise_or.at(data, at[of[~sparse]] + (bits >> 3), (1 << (bits & 7)).astype(np.uint8))
    # Planes: none where every document has one link, else as many as the largest number has bits.
    most = np.maximum.reduceat(times, first) if len(first) else np.zeros(0, np.int64)
    n_planes = np.where(most > 1, np.ceil(np.log2(most + 1)).astype(np.int64), 0)
    width = (n + 7) // 8
    to = np.concatenate([[0], np.cumsum(n_planes * width)])
    planes = np.zeros(int(to[-1]), np.uint8)
    for k in range(int(n_planes.max(initial=0))):
        on = (n_planes[of] > k) & ((times >> k) & 1 > 0)
        byte = to[of[on]] + k * width[of[on]] + (rank[on] >> 3)
        np.bitwise_or.at(planes, byte, (1 << (rank[on] & 7)).astype(np.uint8))
    return {
        "pair": pa.array(pair[first], pa.int64()),
        "n_docs": pa.array(n, pa.int32()),
        "pair_links": pa.array(np.add.reduceat(times, first) if len(first) else n, pa.int64()),
        "bitmap": _binary(sizes, data),
        "planes": _binary(n_planes * width, planes),
    }


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, offsets.astype(np.int64)


def unposted(n_docs: np.ndarray, bitmap: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of links of every document of the given postings."""
    n = n_docs.astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    place = np.zeros(len(of), np.int64)
    data, at = _content(bitmap)
    sparse = (n < DENSE)[of]
    where = at[of[sparse]] + 2 * rank[sparse]
    place[sparse] = data[where].astype(np.int64) | data[where + 1].astype(np.int64) << 8
    dense = np.flatnonzero(n >= DENSE)
    if len(dense):
        sets = data[at[dense][:, None] + np.arange(BLOCK // 8)]
        place[~sparse] = np.nonzero(np.unpackbits(sets, axis=1, bitorder="little"))[1]
    data, at = _content(planes)
    width = (n + 7) // 8
    n_planes = np.diff(at) // np.maximum(width, 1)
    times = np.where(n_planes[of] == 0, 1, 0)
    for k in range(int(n_planes.max(initial=0))):
        on = np.flatnonzero(n_planes[of] > k)
        byte = data[at[of[on]] + k * width[of[on]] + (rank[on] >> 3)]
        times[on] += ((byte >> (rank[on] & 7).astype(np.uint8)) & 1).astype(np.int64) << k
    return of, place, times


# -- the corpus ---------------------------------------------------------------------------------


def index(
    documents: DataFrame,
    byte_level: str,
    pieces: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_groups: bool = False,
) -> DataFrame:
    """The stored index: a row per document (`pair` null) and a row per block and linked pair of ids.

    A pair is `a * number of B's ids + b`. Every row of the table is a document of its own, also one that repeats an
    id or has none. Texts that are null, empty or not joined again by both tokenizers have no tokens:
    zeros and an empty digest. Other columns are not read. `with_groups` adds each document's groups as text.
    """
    ship(documents.sparkSession)
    rows = documents.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text")
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = aligner(byte_level, pieces)
        block, place, size, gathered = TaskContext.get().partitionId() << 32, 0, 0, []

        def batch_of(n: int, columns: dict) -> pa.RecordBatch:
            columns = columns | {"block": pa.array(np.full(n, block, np.int64))}
            return pa.RecordBatch.from_arrays(
                [columns.get(name, pa.nulls(n, kind)) for name, kind in _TYPES.items()], list(_TYPES)
            )

        def close() -> Iterator[pa.RecordBatch]:
            if gathered:
                codes = np.concatenate([c for c, _ in gathered])
                times = np.concatenate([t for _, t in gathered])
                order = np.argsort(codes)
                columns = posted(codes[order], times[order])
                n = len(columns["pair"])
                for at in range(0, n, 1 << 15):
                    to = min(n, at + (1 << 15))
                    part = {name: x.slice(at, to - at) for name, x in columns.items()}
                    yield batch_of(to - at, part)

        for batch in slices(batches, "text", 1 << 20):
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(BLOCK - place, batch.num_rows - at))
                at += part.num_rows
                columns, codes, times, n_bytes = _aligned(own, part, place, with_groups)
                gathered.append((codes, times))
                yield batch_of(part.num_rows, columns)
                place, size = place + part.num_rows, size + n_bytes
                if place == BLOCK or size >= BLOCK_BYTES:
                    yield from close()
                    block, place, size, gathered = block + 1, 0, 0, []
        yield from close()

    return stored(rows.mapInArrow(build, INDEX), "alignment")


def _aligned(
    own: Aligner, batch: pa.RecordBatch, place: int, with_groups: bool
) -> tuple[dict[str, pa.Array], np.ndarray, np.ndarray, int]:
    """Columns of the documents, their linked pairs as codes of `posted` with numbers of links, bytes of text."""
    n = batch.num_rows
    found, row, offsets = own.rows(batch.column("text"))
    counts = np.zeros((n, 3), np.int64)
    np.add.at(counts, row, own.counts[found])
    links, at = own.links.of(found)
    link_row = np.repeat(row, np.diff(at))
    codes, times = np.unique(links * BLOCK + place + link_row, return_counts=True)
    spelt, at = own.groups.of(found)
    bounds = at[np.searchsorted(row, np.arange(n + 1))]
    spelt = spelt.tobytes()
    texts = [spelt[x : y - 1] if y > x else b"" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    columns = {
        "place": pa.array(np.arange(place, place + n), pa.int32()),
        "doc_id": batch.column("doc_id"),
        "n_a": pa.array(counts[:, 0]),
        "n_b": pa.array(counts[:, 1]),
        "n_groups": pa.array(counts[:, 2]),
        "n_links": pa.array(np.bincount(link_row, minlength=n), pa.int64()),
        "groups_sha256": pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in texts], pa.string()),
    }
    if with_groups:
        columns["groups"] = pa.array([x.decode() for x in texts], pa.string())
    return columns, codes, times, int(offsets[-1])


def pair_counts(indexed: DataFrame, n_b: int) -> DataFrame:
    """Per linked pair: ids `a` and `b`, `n_docs`, `n_links`, and whether no pair of its A id has more documents."""
    pairs = (
        indexed.where("pair is not null")
        .groupBy("pair")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    )
    ids = F.floor(F.col("pair") / F.lit(n_b)).cast("long")
    pairs = stored(pairs.select("pair", ids.alias("a"), (F.col("pair") % n_b).alias("b"), "n_docs", "n_links"), "pairs")
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))
    return pairs.join(most, "a").withColumn("best", F.col("n_docs") == F.col("most")).drop("most")


_SCORES = "block long, place int, n_best long, count_sum long"


def scores(indexed: DataFrame, counts: DataFrame) -> DataFrame:
    """What the postings return to their documents: `n_best` and `count_sum` per block and place, where not zero."""
    postings = indexed.where("pair is not null").select("block", "pair", "n_docs", "bitmap", "planes")
    met = postings.join(counts.select("pair", F.col("n_docs").alias("count"), "best"), "pair")
    met = met.drop("pair").repartition("block").sortWithinPartitions("block")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, total = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

        def close() -> pa.RecordBatch:
            places = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(places), block, np.int64)),
                    pa.array(places, pa.int32()),
                    pa.array(best[places]),
                    pa.array(total[places]),
                ],
                ["block", "place", "n_best", "count_sum"],
            )

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else []
            for low, high in zip(edges, [*edges[1:], len(blocks)]):
                if block is not None and block != blocks[low]:
                    yield close()
                    best[:], total[:] = 0, 0
                block = int(blocks[low])
                part = batch.slice(low, high - low)
                of, place, times = unposted(
                    part.column("n_docs").to_numpy(), part.column("bitmap"), part.column("planes")
                )
                count = part.column("count").to_numpy()
                np.add.at(total, place, count[of] * times)
                is_best = part.column("best").to_numpy(zero_copy_only=False)[of]
                np.add.at(best, place[is_best], times[is_best])
        if block is not None:
            yield close()

    return met.mapInArrow(add, _SCORES)


def alignment(documents: DataFrame, byte_level: str, pieces: str, **options) -> DataFrame:
    """One row per document: sizes of its alignment, links with the best count of their A id, sum of the counts.

    A link's count is the number of documents whose tokens have its pair of ids linked. See `index` for odd rows; an
    empty table gives an empty result.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    indexed = index(documents, byte_level, pieces, **options)
    returned = scores(indexed, stored(pair_counts(indexed, n_b), "counts"))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own += ["groups"] if options.get("with_groups") else []
    return (
        indexed.where("pair is null")
        .select("block", "place", *own)
        .join(returned, ["block", "place"], "left")
        .select(
            *own[:5],
            F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
            *own[5:],
        )
    )
