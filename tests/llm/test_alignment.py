"""Cross-tokenizer alignment against plain loops over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from perfattr.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block string, pair string, n_docs int"


def plain_bytes():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            letters[chr(256 + len(letters) - len(plain))] = b
    return letters


def brute_force(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    letters = plain_bytes()
    found, docs_of = [], Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        goal = (" " + text).encode()
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        ab = [bytes(letters[c] for c in a_model.id_to_token(k)) for k in a]
        bb = []
        for k in b:
            piece = b_model.id_to_piece(k)
            bb.append(bytes([int(piece[3:5], 16)]) if b_model.is_byte(k) else piece.replace("▁", " ").encode())
        if b"".join(ab) != goal or b"".join(bb) != goal:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links, j = [], 0
        for i, end in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        at_a, at_b = {end: k + 1 for k, end in enumerate(ends_a)}, {end: k + 1 for k, end in enumerate(ends_b)}
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = at_a[end], at_b[end]
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        docs_of.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    out = []
    for one in found:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        n_best = sum(docs_of[p] == best[p[0]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), n_best, sum(docs_of[p] for p in links), ";".join(groups)))
    return out


ODD = [
    None, "", " ", "  ", "\n", "\n\n x", "a", " lead", "trail ", "two  blanks   three", "tabs\tand\r\nlines\n\n end\n",
    "<|endoftext|> as text <s> </s> <unk> <0x41>", "it's we'll 'tis", "a▁b ▁", "nul\x00 byte", "ﬁ ½ ①",
    "日本語のテキスト。 空白 あり", "emoji 🙂🙂 👩‍👩‍👧 end", "nbsp here 　wide line", "x" * 3000,
    "été où Ça coûte", "́combining é", "﻿bom", "word\x1f \x7f \x85next",
]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    signs = list("abcde éüß\n .,'&;<>_0123\t") + ["日", "本", "🙂", " ", "▁", "  ", " the", "tion", "'s"]
    made = ["".join(draw.choice(signs) for _ in range(draw.randint(1, 400))) for _ in range(150)]
    vocabulary = ["".join(draw.choice("aeioutnrsl") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    prose = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 3000))) for _ in range(20)]
    return ODD + made + prose + prose[:5] * 40


def check(rows, texts):
    expected = brute_force(texts)
    assert len(rows) == len(texts)
    for r in rows:
        one = expected[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == one[:6], texts[r.doc_id]
        assert r.groups_sha256 == (hashlib.sha256(one[6].encode()).hexdigest() if one[0] else "")


def test_alignment_equals_plain_loops(spark, texts):
    rows = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    found = alignment.alignment(rows, A, B, with_groups=True).collect()
    check(found, texts)
    assert {r.doc_id: r.groups for r in found} == dict(enumerate(x[6] for x in brute_force(texts)))


def test_many_blocks_and_dense_bitmaps(spark, texts, monkeypatch):
    """Blocks of few documents, so that pairs have bit sets and rows in many blocks."""
    own = texts[-60:] + ODD
    codes, times = [], []
    for block in (64, 8):
        monkeypatch.setattr(alignment, "BLOCK", block)
        monkeypatch.setattr(alignment, "DENSE", block // 16 + 1)
        model = alignment.Aligner(A, B)
        batch = pa.RecordBatch.from_arrays([pa.array(range(block)), pa.array(own[:block])], ["doc_id", "text"])
        _, codes, times, _ = alignment._aligned(model, batch, 0, False)
        columns = alignment.posted(codes, times)
        n_docs = columns["n_docs"].to_numpy()
        of, place, again = alignment.unposted(n_docs, columns["bitmap"], columns["planes"])
        assert ((columns["pair"].to_numpy()[of] * block + place) == codes).all() and (again == times).all()
        assert (n_docs >= alignment.DENSE).any() and columns["pair_links"].to_numpy().sum() == times.sum()


def test_repeated_rows_and_null_ids_are_documents(spark):
    rows = spark.createDataFrame(
        [(1, "same words here", "", "", 0)] * 4 + [(None, "same words", "", "", 0), (2, None, "", "", 0)], SCHEMA
    )
    found = alignment.alignment(rows, A, B).collect()
    expected = brute_force(["same words here"] * 4 + ["same words", None])
    got = sorted(tuple(r)[1:7] for r in found)
    assert got == sorted(x[:6] for x in expected) and sum(r.doc_id is None for r in found) == 1


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_pair_counts(spark):
    texts = ["one two two", "two one", "three"]
    rows = spark.createDataFrame([(k, t, "", "", 0) for k, t in enumerate(texts)], SCHEMA)
    n_b = sentencepiece.SentencePieceProcessor(model_file=B).get_piece_size()
    pairs = alignment.pair_counts(alignment.index(rows, A, B), n_b).collect()
    assert sum(r.n_links for r in pairs) == sum(x[3] for x in brute_force(texts))
    assert all(r.pair == r.a * n_b + r.b and (r.best or r.n_docs < 3) for r in pairs)
