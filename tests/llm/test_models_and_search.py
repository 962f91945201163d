"""Substring dedup, quality, toxicity, language and top-k search."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perfattr.llm import hashed, language, quality, substring_dedup, top_k, toxicity
from perfattr.llm.common import bounded_sample, slices, text_bytes

SCHEMA = "doc_id long, text string, lang string, row string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, x, "extra", 1) for k, t, x in rows], SCHEMA)


def prose(draw, n, vocabulary=4000):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


# -- columns of text -------------------------------------------------------------------------------


def test_slices_keep_rows_whole_and_in_order():
    texts = ["a" * 10, None, "", "b" * 500, "c", "d" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(6))], ["text", "k"])
    for most in (1, 10, 1000):
        parts = list(slices([batch.slice(0, 2), batch.slice(2), batch.slice(6)], "text", most))
        assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(6))
        for p in parts:
            data, offsets = text_bytes(p.column("text"))
            own = [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
            assert own == [t or "" for t in p.column("text").to_pylist()]


def test_bounded_sample_is_repeatable(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert bounded_sample(rows, "doc_id", 5000).count() == 5000
    some = [sorted(r[0] for r in bounded_sample(x, "doc_id", 500).collect()) for x in (rows, rows.repartition(3))]
    assert some[0] == some[1] and 350 < len(some[0]) < 650


# -- substring dedup -------------------------------------------------------------------------------


def plain_gear(data):
    out = []
    for k in range(len(data)):
        total = 0
        for age in range(min(32, k + 1)):
            total += int(substring_dedup._GEAR[data[k - age]]) << age
        out.append(total % (1 << 32))
    return out


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=120))
def test_gear_hash_rolls_over_32_bytes(data):
    data = np.frombuffer(data, np.uint8)
    assert substring_dedup.gear_hashes(data).tolist() == plain_gear(data)


def test_chunks_cover_rows_and_resist_insertions():
    draw = np.random.default_rng(2)
    base = draw.integers(97, 123, 4000).astype(np.uint8)
    rows = [base, np.insert(base, 1500, [65, 66, 67]), base[:0], base[:10], np.full(1000, 97, np.uint8)]
    data, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ends = substring_dedup.chunk_ends(data, offsets)
    assert set(offsets[1:].tolist()) <= set(ends.tolist()) | {int(offsets[2])}
    assert np.diff(ends, prepend=0).max() <= substring_dedup.MOST_CHUNK
    first = ends[ends <= 4000]
    second = ends[(ends > 4000) & (ends <= offsets[2])] - 4000
    assert set(first[first <= 1500]) == set(second[second <= 1500])
    assert set(first[first > 1600] + 3) == set(second[second > 1603])
    alone = substring_dedup.chunk_ends(base, np.array([0, 4000]))
    assert alone.tolist() == first.tolist()


def test_chunks_end_between_characters():
    texts = ["é中" * 400, "aé" * 300, "😀" * 200]
    data, offsets = text_bytes(pa.array(texts))
    ends = substring_dedup.chunk_ends(data, offsets).tolist()
    parts = [data[a:b].tobytes() for a, b in zip([0, *ends], ends)]
    assert "".join(p.decode() for p in parts) == "".join(texts)
    assert max(map(len, parts)) <= substring_dedup.MOST_CHUNK + 3


def plain_passages(docs, least=substring_dedup.LEAST_PASSAGE):
    """The result by dictionaries over the chunks' bytes; docs in the order read."""
    chunks = []
    for _, text in docs:
        data = np.frombuffer((text or "").encode(), np.uint8)
        ends = substring_dedup.chunk_ends(data, np.array([0, len(data)])).tolist()
        chunks.append([(a, b, data[a:b].tobytes()) for a, b in zip([0, *ends], ends)])
    count = Counter(c for own in chunks for _, _, c in own)
    first = {}
    for k, own in enumerate(chunks):
        for j, (_, _, c) in enumerate(own):
            first.setdefault(c, (k, j))
    out = {}
    for k, own in enumerate(chunks):
        found, gone, j = [], [], 0
        while j < len(own):
            to = j
            while to < len(own) and count[own[to][2]] > 1:
                to += 1
            if to > j and own[to - 1][1] - own[j][0] >= least:
                found.append((own[j][0], own[to - 1][1] - own[j][0]))
                for i in range(j, to):
                    a, b, c = own[i]
                    if first[c] != (k, i):
                        if gone and gone[-1][0] + gone[-1][1] == a and i > j:
                            gone[-1] = (gone[-1][0], b - gone[-1][0])
                        else:
                            gone.append((a, b - a))
            j = to + 1 if to == j else to
        out[docs[k][0]] = (len((docs[k][1] or "").encode()), len(own), found, gone)
    return out


def test_passages_equal_brute_force_and_planted_ones_are_found(spark):
    draw = random.Random(6)
    passages = [prose(draw, 55) for _ in range(3)]
    docs = []
    for k in range(40):
        text = prose(draw, draw.randint(5, 120))
        if k % 4 == 0:
            at = draw.randint(0, len(text))
            text = text[:at] + " " + draw.choice(passages) + " " + text[at:]
        docs.append((k, text))
    docs += [(100, None), (101, ""), (102, "é" * 300), (103, docs[1][1]), (104, passages[0] + "|" + passages[0])]
    df = frame(spark, [(k, t, None) for k, t in docs]).coalesce(1)
    found = {r.doc_id: r for r in substring_dedup.repeated_passages(df).collect()}
    for doc_id, (size, chunks, spans, gone) in plain_passages(docs).items():
        r = found[doc_id]
        assert (r.n_bytes, r.n_chunks) == (size, chunks)
        assert [tuple(s) for s in r.passages] == spans and [tuple(s) for s in r.removed] == gone
        assert r.repeated == bool(spans) and r.n_repeated_bytes == sum(n for _, n in spans)
        assert r.n_removed_bytes == sum(n for _, n in gone)
    repeated = [p for p in passages if sum((t or "").count(p) for _, t in docs) > 1]
    used = {k for k, t in docs if t and any(p in t for p in repeated)}
    flagged = {k for k, r in found.items() if r.repeated}
    assert len(used) > 5 and flagged >= used and flagged - used <= {1, 102, 103}
    assert found[103].n_removed_bytes == len(docs[1][1])
    assert substring_dedup.repeated_passages(frame(spark, []).limit(0)).collect() == []


def test_spans_are_cut_out(spark):
    df = spark.createDataFrame([("aébc", [(3, 1)]), ("x", []), ("abcdef", [(0, 2), (4, 2)])],
                               "text string, removed array<struct<start:long,length:long>>")
    cut = df.select(substring_dedup.without_spans("text", "removed").alias("t")).collect()
    assert [r.t for r in cut] == ["aéc", "x", "cd"]


# -- quality ---------------------------------------------------------------------------------------


def quality_case(seed=3):
    draw = random.Random(seed)
    docs, labels = [], []
    for k in range(160):
        found = [f"w{draw.randrange(60)}" for _ in range(draw.randint(4, 80))]
        junk = k % 5 == 0
        if junk:
            found = [x + draw.choice(["&&&", "!!", "%%%"]) for x in found] if k % 2 else [found[0]] * len(found)
        docs.append((k, " ".join(found), None))
        if k % 3:
            labels.append((k, int(not junk), 0))
    return docs, labels


def test_junk_goes_and_clean_text_stays(spark):
    docs, labels = quality_case()
    docs += [(1000, None, None), (1001, "", None), (None, "w1 w2 w3", None), (1002, "w1 w2 w3", None)]
    df = frame(spark, docs)
    labels = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.selection(df, labels)
    rows = {r.doc_id: r for r in found.collect()}
    junk = {k for k, _, _ in docs if k is not None and k < 1000 and k % 5 == 0}
    kept = {k for k, r in rows.items() if r.kept}
    assert not kept & junk and len(kept) >= len(docs) - len(junk) - 3
    assert not rows[1000].kept and not rows[1001].kept and rows[1000].key is None
    stays = quality.selected(df, labels)
    assert stays.columns == df.columns and {r.doc_id for r in stays.collect()} == kept
    some = quality.selection(df, labels, k=10).where("kept").collect()
    best = sorted((r.key for r in rows.values() if r.key is not None), reverse=True)[:10]
    assert sorted((r.key for r in some), reverse=True) == best
    none = quality.selection(df, labels.limit(0)).where("kept").collect()
    assert len(none) == len(docs) - 2
    assert quality.selection(df.limit(0), labels).collect() == []


def test_weights_equal_plain_counts():
    texts = ["a b b b!", "", "c, c d"]
    data, offsets = text_bytes(pa.array(texts))
    found, row = hashed.grams(data, offsets, 1 << 30)
    assert Counter(row.tolist()) == {0: 9, 2: 7}
    raw = np.array([5, 3, 0, 2])
    ratios = quality.log_ratios(raw, np.array([4, 0, 0, 1]))
    share = np.array([4.5, 0.5, 0.5, 1.5]) / 7, np.array([5.5, 3.5, 0.5, 2.5]) / 12
    assert np.allclose(ratios, np.log(share[0] / share[1]))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.integers(-5, 5), st.booleans()), max_size=30))
@example([(0, False), (0, False), (0, True)])
@example([(1, True), (1, False), (1, False), (0, True), (2, True)])
def test_threshold_has_the_fewest_errors(pairs):
    scores, good = np.array([float(s) for s, _ in pairs]), np.array([g for _, g in pairs], bool)
    cut = quality.cut_between(scores, good)

    def wrong(at):
        return int(((scores >= at) != good).sum())

    if len(pairs) and good.any() and not good.all():
        assert wrong(cut) == min(wrong(at) for at in [*(scores - 0.25), *(scores + 0.25)])


@pytest.mark.parametrize("k", [1, 7, 50, 200])
def test_kth_largest(spark, k):
    draw = random.Random(k)
    values = [draw.choice([draw.randrange(1 << 62), draw.randrange(100)]) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "place long")
    assert quality.kth_largest(rows, "place", k) == sorted(values, reverse=True)[k - 1]


def test_selection_equals_a_plain_choice_of_the_largest_keys(spark):
    """Keys from the stated ratio and noise, and the documents kept, by plain loops; ids and texts repeat."""
    draw = random.Random(12)
    docs = [(k, prose(draw, draw.randint(1, 40), 30), "en") for k in range(120)]
    docs += [(k, " ".join("##" + w for w in prose(draw, 20, 30).split()), "en") for k in range(120, 160)]
    docs += docs[:3] + [(5, docs[9][1], "en"), (300, None, "en"), (301, "", "en"), (None, docs[2][1], "en")]
    labels = [(k, int(k < 120)) for k in range(0, 160, 2)]
    df = frame(spark, docs)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    text_of = dict((k, t) for k, t, _ in docs[:160])
    raw, good = Counter(), Counter()
    grams_of = {}
    for k, text, _ in docs:
        column = pa.array([text], pa.string())
        found = hashed.grams(*text_bytes(column), quality.BUCKETS)[0].tolist()
        grams_of[text] = found
        raw.update(found)
    label = dict(labels)
    for k, text, _ in docs:
        if label.get(k) == 1:
            good.update(grams_of[text])
    counts = np.zeros((2, quality.BUCKETS), np.int64)
    for j, each in enumerate((raw, good)):
        for bucket, n in each.items():
            counts[j, bucket] = n
    ratios = quality.log_ratios(*counts)
    hashes = df.select("doc_id", "text", F.xxhash64("doc_id", F.xxhash64("text"), F.lit(0)).alias("h")).collect()
    noise = {(r.doc_id, r.text): (r.h % (1 << 40) + 0.5) / (1 << 40) for r in hashes}

    def key(k, text):
        mean = sum(ratios[g] for g in grams_of[text]) / len(grams_of[text])
        return mean * quality.LENGTH - math.log(-math.log(noise[k, text]))

    keys = sorted((key(k, t) for k, t, _ in docs if grams_of[t]), reverse=True)
    for k in (1, 40, 500):
        found = quality.selection(df, known, k=k).collect()
        assert len(found) == len(docs)
        least = keys[min(k, len(keys)) - 1]
        want = Counter((i, bool(grams_of[t]) and key(i, t) >= least - 1e-9) for i, t, _ in docs)
        assert Counter((r.doc_id, r.kept) for r in found) == want
        assert sorted((r.key for r in found if r.key is not None), reverse=True) == pytest.approx(keys)
    assert text_of


# -- toxicity --------------------------------------------------------------------------------------


def test_machine_learns_what_two_terms_mean_together():
    draw = np.random.default_rng(1)
    rows, toxic = [], []
    for _ in range(1500):
        own = set(draw.choice(12, 4, replace=False).tolist())
        rows.append(sorted(own))
        toxic.append(float({0, 1} <= own or {2, 3} <= own))
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    feature = np.array([x for r in rows for x in r])
    machine = toxicity.fit(feature, first, np.array(toxic), 12)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    assert ((machine.scores(feature, row, len(rows)) >= 0.5) == np.array(toxic, bool)).mean() > 0.98
    flat = toxicity.Machine(machine.bias, machine.weights, machine.factors * 0)
    assert ((flat.scores(feature, row, len(rows)) >= 0.5) == np.array(toxic, bool)).mean() < 0.97


def test_toxic_documents_are_found(spark):
    draw = random.Random(2)
    docs, labels = [], []
    for k in range(600):
        text = prose(draw, draw.randint(10, 60), 300)
        toxic = k % 4 == 0
        if toxic:
            text += " " + draw.choice(["slurish", "slurable", "insultful", "Insult"]) + " " + prose(draw, 3, 300)
        docs.append((k, text, None))
        labels.append((k, 1, int(toxic)))
    docs += [(1000, None, None), (1001, "", None), (None, "w1 insult", None)]
    df = frame(spark, docs)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(df, known).collect()}
    tested = [k for k, r in rows.items() if r.held_out and k < 600]
    assert 80 < len(tested) < 170
    assert all(rows[k].predicted == int(k % 4 == 0) for k in tested)
    assert rows[1000].score == rows[1001].score < 0.5 and not rows[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    share = toxicity.toxicity(df, known.limit(0)).collect()
    assert len(share) == len(docs) and len({r.score for r in share}) == 1
    assert toxicity.toxicity(df.limit(0), known).collect() == []


def test_scores_equal_sums_over_all_pairs_of_terms(spark):
    """The model's scores by plain loops over the terms of each whole text and all pairs of them."""
    draw = random.Random(8)
    docs = []
    for k in range(150):
        words_ = prose(draw, draw.randint(1, 50), 25).split()
        marks = [w for w in ("vileness", "awfully", "nastiest") if draw.random() < 0.7]
        docs.append((k, " ".join([*words_, *marks] if k % 3 == 0 else words_), "en"))
    docs += [(900, None, "en"), (901, "", "en"), (902, " ".join(docs[0][1] for _ in range(300)), "en"), docs[0], docs[0]]
    df = frame(spark, docs)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)], "doc_id long, toxic int")
    number, machine = toxicity.train(df.select("doc_id", "text"), labels)
    assert len(machine.weights) > 5
    for r in toxicity.toxicity(df, labels).collect():
        text = dict((k, t) for k, t, _ in docs)[r.doc_id]
        found = hashed.terms(*text_bytes(pa.array([text], pa.string())), toxicity.BUCKETS, toxicity.PREFIXES)[0]
        own = sorted({int(number[x]) for x in found if number[x] >= 0})
        total = machine.bias + sum(machine.weights[a] for a in own)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                total += sum(x * y for x, y in zip(machine.factors[a], machine.factors[b]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5)


# -- language --------------------------------------------------------------------------------------

SYLLABLES = {"aa": ["ba", "du", "ki"], "bb": ["schö", "ung", "ter"], "cc": ["ción", "ado", "que"]}


def language_case():
    draw = random.Random(8)
    docs = []
    for k in range(300):
        lang = sorted(SYLLABLES)[k % 3]
        words_ = ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(draw.randint(3, 60))]
        docs.append((k, " ".join(words_), lang))
    return docs


def test_languages_of_held_out_documents(spark):
    docs = language_case() + [(1000, None, "aa"), (1001, "", None), (1002, "12 + 3!", "bb"), (1003, "badu kiki", None)]
    rows = {r.doc_id: r for r in language.languages(frame(spark, docs), steps=120).collect()}
    want = {k: lang for k, _, lang in docs if k < 1000}
    tested = [k for k, r in rows.items() if r.held_out and k < 1000]
    assert len(tested) > 40 and np.mean([rows[k].lang_pred == want[k] for k in tested]) > 0.97
    assert [rows[k].lang_pred for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    none = language.languages(frame(spark, [(k, t, None) for k, t, _ in docs[:5]])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert language.languages(frame(spark, []), steps=2).collect() == []


def test_windows_hold_all_bytes():
    data, offsets = text_bytes(pa.array(["a" * 300, "", "é" * 5, None]))
    some, row = language.windows(data, offsets, 128)
    assert row.tolist() == [0, 0, 0, 2] and [int((w < 256).sum()) for w in some] == [128, 128, 44, 10]


def test_gradients_equal_differences():
    network = language.Network.random(3, seed=3)
    draw = np.random.default_rng(0)
    bytes_, label = draw.integers(0, 257, (7, 5)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    _, gradients = network.gradients(bytes_, label)
    for parameter, gradient in zip(network.arrays(), gradients):
        at = np.unravel_index(np.argmax(np.abs(gradient)), gradient.shape)
        value, loss = parameter[at], []
        for step in (0.01, -0.01):
            parameter[at] = value + step
            loss.append(network.gradients(bytes_, label)[0])
        parameter[at] = value
        assert abs((loss[0] - loss[1]) / 0.02 - gradient[at]) < 1e-3


# -- top-k -----------------------------------------------------------------------------------------


def plain_top(vectors, queries, k):
    known = [
        (vec_id, [int(np.floor(256 * float(np.float32(v)))) for v in x])
        for vec_id, x in vectors
        if vec_id is not None and x and all(v is not None and np.isfinite(v) for v in x)
    ]
    out = set()
    for q, y in {(q, tuple(y)) for q, y in known if q in queries}:
        scores = [(-sum(a * b for a, b in zip(y, x)), i) for i, x in known if i != q and len(x) == len(y)]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("at_once", [3, 1000])
def test_top_k_equals_brute_force(spark, at_once):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (5, 6))
    vectors = [(k, (centres[k % 5] + draw.normal(0, 0.2, 6)).tolist()) for k in range(400)]
    vectors += [(k, vectors[0][1]) for k in range(400, 440)]
    vectors += [(440, None), (441, []), (442, [1.0] * 5 + [None]), (443, [float("nan")] * 6), (444, [float("inf")] * 6)]
    vectors += [(None, [0.5] * 6), (450, [1.0, 2.0]), (451, [3.0, -2.0]), (452, [0.0] * 6), (0, vectors[0][1])]
    df = spark.createDataFrame([(i, x, "extra", 3) for i, x in vectors], "vec_id long, embedding array<float>, rank string, score int")
    asked = df.where("vec_id % 10 = 0")
    found = top_k.top_k(asked, df, queries_at_once=at_once, block=16).collect()
    want = plain_top(vectors, {i for i, _ in vectors if i is not None and i % 10 == 0}, 5)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == want and len(found) == len(want)
    assert top_k.top_k(df.limit(0), df).collect() == [] and top_k.top_k(asked, df.limit(0)).collect() == []


def test_every_row_of_a_candidate_takes_a_rank(spark):
    """A third of all rows are one candidate, far more than there are ranks."""
    vectors = [(0, [1.0, 0.0])] + [(1, [9.0, 0.0])] * 12 + [(k, [9.0 - k, 1.0]) for k in range(2, 8)]
    vectors += [(2, [9.5, 1.0]), (3, [9.0, 5.0])]  # other vectors of an id
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    found = top_k.top_k(df.where("vec_id = 0"), df).collect()
    want = [(1, 2, 9.5), (2, 1, 9.0), (3, 1, 9.0), (4, 1, 9.0), (5, 1, 9.0)]
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(n, i, int(x * 256 * 256)) for n, i, x in want]
    assert plain_top(vectors, {0}, 5) == {(0, n, i, int(x * 256 * 256)) for n, i, x in want}


def test_blocks_below_the_bound_are_not_scored(monkeypatch):
    draw = np.random.default_rng(9)
    centres = draw.normal(0, 100, (20, 8))
    blocks = []
    for k, centre in enumerate(centres):
        rows = np.floor(centre + draw.normal(0, 3, (32, 8))).astype(np.int64)
        blocks.append((np.arange(32 * k, 32 * k + 32), rows, rows.max(axis=0), rows.min(axis=0)))
    queries = np.stack([blocks[k][1][0] for k in range(5)])
    scored, plain = [], top_k.scores

    def counted(rows, asked):
        scored.append(len(rows) * len(asked))
        return plain(rows, asked)

    monkeypatch.setattr(top_k, "scores", counted)
    found = top_k.best_of_blocks(blocks, queries, np.array([0, 32, 64, 96, 128]), 5)
    assert len(found) == 25 and sum(scored[2:]) < 0.5 * 5 * 640
