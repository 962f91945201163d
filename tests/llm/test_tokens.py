"""Token-id files and packing against plain loops."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from perfattr.llm import packed_ids, packing
from perfattr.llm.common import scratch
from perfattr.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, row int, sequence_id string"
ODD = [
    (3, "b", "x", 1, "y"),
    (1, "the end\n\nof  the line <|endoftext|> it's 42%", "x", 1, "y"),
    (2, None, "x", 1, "y"),
    (2, "", "x", 1, "y"),
    (None, "no id", "x", 1, "y"),
    (5, "same", "x", 1, "y"),
    (5, "same", "x", 1, "y"),
    (9, "long " * 9000, "x", 1, "y"),
]


PLAIN = Tokenizer.from_file(PATH)


def plain_ids(text: str | None, end: int) -> bytes:
    ids = PLAIN.encode(text or "", add_special_tokens=False).ids + [end]
    return np.asarray(ids, "<u4").tobytes()


PARTS = list("aB \u00e9e\u0301\u0338=\u03a3\u03c2'sre.,12H\u0331<|>\t\n \u00a0\x1c!?1")
PARTS += ["<|endoftext|>", "<|ENDOFTEXT|>", "Word", "the"]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_ids_by_word_equal_those_of_the_text(parts):
    text = "".join(parts)
    ids, bounds = encoder(PATH).encode(pa.array([text, None, text]), 7)
    ids = [x.astype("<u4").tobytes() for x in np.split(ids, bounds[1:-1])]
    assert ids == [plain_ids(text, 7), plain_ids("", 7), plain_ids(text, 7)]


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 15, 16, 17, 24, 31])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 4096, 5001])
def test_packing_bits_round_trip(width, n):
    ids = np.random.default_rng(n).integers(0, 1 << width, n).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == (n * width + 7) // 8
    assert np.array_equal(packed_ids.unpack(data, width, n), ids)


def test_files_hold_all_ids_in_order(spark):
    folder = scratch(spark, "test-ids")
    found = packed_ids.token_id_files(spark.createDataFrame(ODD, SCHEMA), PATH, folder, ids_per_shard=4).collect()
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 2, 2, 3, 5, 5, 9]
    at = 0
    texts = {r[0]: r[1] for r in ODD}
    for row in found:
        ids = plain_ids(texts[row.doc_id], 2)
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += row.n_tokens
    last = found[-1]
    shard = packed_ids.Shard(f"{folder}/shards/{last.shard}")
    k = shard.doc_ids.index(9)
    whole = np.frombuffer(plain_ids(texts[9], 2), "<u4")
    assert shard.width == 16 and np.array_equal(shard.document(k), whole)
    first = int(shard.starts[k])
    assert np.array_equal(shard.read(first + 4090, first + 4100), whole[4090:4100])


def test_files_of_no_documents(spark):
    assert packed_ids.token_id_files(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def check_packed(rows, texts, length):
    sequences, of_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        of_doc.setdefault(r.doc_id, []).append(r)
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    for doc_id, text in texts:
        ids = plain_ids(text, 1)
        cut = [ids[k : k + 4 * length] for k in range(0, len(ids), 4 * length)]
        own = sorted(of_doc[doc_id], key=lambda r: r.piece)
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in own} >= {
            (k, k * length, len(c) // 4, zlib.crc32(c)) for k, c in enumerate(cut)
        }
    return len(sequences)


def test_packing_is_gapless_and_whole(spark):
    rows = packing.pack_documents(spark.createDataFrame(ODD, SCHEMA), PATH, with_ids=True).collect()
    check_packed(rows, [(r[0], r[1]) for r in ODD], 4096)
    assert sum(r.length for r in rows) == sum(len(plain_ids(r[1], 1)) // 4 for r in ODD)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 8))
def test_best_fit_takes_the_tightest_open_bin(lengths, most):
    packer = packing.BestFit(64, most)
    free: dict[int, int] = {}
    for n in lengths:
        number, offset = packer.place(n)
        room = [f for f in free.values() if f >= n]
        if room:
            assert free[number] == min(room)
        else:
            assert number not in free
            if len(free) >= most:
                fullest = min(free.values())
                gone = next(k for k, f in free.items() if f == fullest and k not in
                            {x for s in packer.bins for x in s})
                del free[gone]
        assert offset == 64 - free.get(number, 64)
        free[number] = free.get(number, 64) - n
        if not free[number]:
            del free[number]


def test_packing_is_close_to_the_least(spark):
    lengths = np.random.default_rng(5).integers(1, 4097, 20_000)
    packer = packing.BestFit()
    used = {packer.place(int(n))[0] for n in lengths}
    assert len(used) <= 1.02 * -(-lengths.sum() // 4096)
