"""Near duplicates, line dedup and benchmark search against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perfattr.llm import components, decontamination, line_dedup, near_duplicates, words
from perfattr.llm.common import text_bytes

SCHEMA = "doc_id long, text string, node long, row string, __key int"


def rows_of(texts):
    return [(k, text, 7, "extra", 1) for k, text in texts]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def closed(nodes, links):
    """The smallest reachable node of each."""
    group = {n: n for n in nodes}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -- words ---------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text(alphabet="aZé0 _\n\x85中.", max_size=12), max_size=6))
def test_words_and_hashes_depend_on_their_bytes_only(texts):
    data, offsets = text_bytes(pa.array([*texts, None], pa.string()))
    data = words.lower(data)
    for kind, pattern in (
        (words.ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"),
        (words.NOT_SPACE, r"[^\x20\x09-\x0D]+"),
    ):
        starts, ends = words.spans(data, offsets, kind)
        found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        assert found == [w for t in texts for w in re.findall(pattern, lowered(t))]
        hashes = words.hashes(data, starts, ends)
        by_word = {}
        for word, h in zip(found, hashes.tolist()):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)


# -- components ----------------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    draw = random.Random(4)
    names = draw.sample(range(-(1 << 40), 1 << 40), 120)
    edges = [(names[k], names[k + 1]) for k in range(40)]
    edges += [(names[50], names[k]) for k in range(51, 90)] + [(names[100], names[101]), (names[101], names[100])]
    edges += [(names[110], names[110])]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    assert sorted(map(len, groups.values())) == [2, 40, 41]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- near duplicates -----------------------------------------------------------------------------


def plain_shingles(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    size = min(5, len(found))
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)} if found else set()


def plain_components(texts):
    sets = {k: plain_shingles(t) for k, t in texts}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]
    ]
    return sets, closed(sets, links)


def families(seed):
    """Bases, copies with a few words changed, copies of these, and texts that share a half."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(6):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([6, 40, 150]))]
        texts.append(base)
        for _ in range(12):
            other = list(base if draw.random() < 0.6 else texts[-1])
            for _ in range(draw.randint(0, max(1, len(other) // 25))):
                other[draw.randrange(len(other))] = draw.choice(vocabulary)
            texts.append(other)
        texts.append(base[: len(base) // 2] + [draw.choice(vocabulary) for _ in range(len(base) // 2)])
    draw.shuffle(texts)
    out = [(10 * k + 3, " ".join(t)) for k, t in enumerate(texts)]
    return out + [(1, None), (2, ""), (4, " \t\n"), (5, "one"), (6, "ONE"), (8, "two words"), (9, "two  words")]


@pytest.mark.parametrize("seed", [1])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = families(seed)
    sets, smallest = plain_components(texts)
    found = near_duplicates.classes(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {
        k: (len(sets[k]), smallest[k], smallest[k] == k) for k, _ in texts
    }
    kept = near_duplicates.deduplicated(spark.createDataFrame(rows_of(texts), SCHEMA))
    assert kept.columns == ["doc_id", "text", "node", "row", "__key"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in texts if smallest[k] == k)


def test_near_duplicates_of_odd_rows(spark):
    rows = rows_of([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (7, "x y z")])
    found = near_duplicates.classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (7, 7, True),
    ]
    kept = near_duplicates.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "x y"), (5, "a b c d e f"), (7, "x y z")]
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates.classes(empty).collect() == [] and near_duplicates.deduplicated(empty).collect() == []


def test_unlinked_texts_without_an_id_or_of_one_id_all_stay(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    texts = [(None, a), (None, a), (None, f"{a} more"), (None, b), (None, c), (4, d), (4, b + c), (4, d), (9, f"{d} more")]
    texts += [(5, "x y"), (5, "x z"), (None, "x z"), (None, ""), (None, None), (4, " ")]
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    kept = near_duplicates.deduplicated(df).collect()
    left = sorted((r.doc_id or 0, r.text or "") for r in kept)
    copy = next(t for k, t in left if t.startswith(a))
    assert left == sorted([(0, copy), (0, b), (0, c), (4, d), (4, b + c), (5, "x y"), (5, "x z"), (0, ""), (0, ""), (4, " ")])


def test_sketches_estimate_the_similarity():
    draw = np.random.default_rng(3)
    common, own = draw.integers(0, 1 << 62, 700).astype(np.uint64), draw.integers(0, 1 << 62, (2, 100)).astype(np.uint64)
    a, b = (near_duplicates.samples(np.unique(np.append(common, x))) for x in own)
    xor = near_duplicates.odd_sketch(a) ^ near_duplicates.odd_sketch(b)
    count = int(np.bitwise_count(xor.view(np.uint64)).sum())
    assert near_duplicates.most_different_bits(0.62) <= near_duplicates.most_different_bits(0.5)
    estimate = 1 + 512 / (4 * 128) * np.log(1 - 2 * count / 512)
    assert abs(estimate - 700 / 900) < 0.2
    assert count <= near_duplicates.most_different_bits(700 / 900 - near_duplicates.SLACK)


def test_parity_of_a_set_never_exceeds_the_difference():
    draw = np.random.default_rng(5)
    for n in (10, 200, 2000):
        a, b = (draw.choice(3000, n, replace=False).astype(np.uint64) for _ in range(2))
        xor = near_duplicates.parity_bits(np.unique(a), 4096) ^ near_duplicates.parity_bits(np.unique(b), 4096)
        assert np.bitwise_count(xor.view(np.uint64)).sum() <= len(np.setxor1d(a, b))


# -- lines ---------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_documents(seed):
    draw = random.Random(seed)
    letters = "abcdeé "
    bases = ["".join(draw.choice(letters) for _ in range(draw.randint(20, 40))) for _ in range(14)]
    docs = []
    for k in range(30):
        lines = []
        for _ in range(draw.randint(1, 8)):
            line = list(draw.choice(bases) if draw.random() < 0.5 else "".join(draw.choice(letters) for _ in range(25)))
            for _ in range(draw.choice([0, 0, 1, 2, 3])):
                at = draw.randrange(len(line))
                if draw.random() < 0.4:
                    line.insert(at, draw.choice(letters))
                elif draw.random() < 0.5:
                    del line[at]
                else:
                    line[at] = draw.choice(letters)
            lines.append("".join(line))
        short = [draw.choice(["see also", "see alsp", "第一章", "7", "--", ""]) for _ in range(2)]
        docs.append((k, "\n".join([*lines, *short, "}", "}"])))
    return docs + [(100, None), (101, ""), (102, "\n\n"), (103, docs[0][1]), (104, "x" * 70_000)]


@pytest.mark.parametrize("seed", [1])
def test_repeated_lines_equal_brute_force(spark, seed):
    docs = line_documents(seed)
    texts = sorted({x for _, t in docs if t for x in t.split("\n") if len(x) >= 20})
    near = [
        (a, b) for a in texts for b in texts if a < b and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2
    ]
    name = closed(texts, near)
    first, want = set(), {}
    for k, text in sorted(docs, key=lambda d: d[0]):
        lines = text.split("\n") if text is not None else []
        again = []
        for n, line in enumerate(lines):
            if any(c.isalnum() for c in line):
                if name.get(line, line) in first:
                    again.append(n)
                first.add(name.get(line, line))
        want[k] = (len(lines), len(again), again)
    df = spark.createDataFrame(rows_of(docs), SCHEMA)
    found = line_dedup.repeated_lines(df).collect()
    assert {r.doc_id: (r.n_lines, r.n_repeated, r.removed) for r in found} == want
    assert want[103][1] >= want[103][0] - 4 and sum(len(x[2]) for x in want.values()) > 40  # a copy loses all that says something
    cut = line_dedup.without_repeated_lines(df)
    assert cut.columns == df.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {
        k: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[k][2]) for k, t in docs
    }


def test_merged_components_equal_those_of_all_edges(spark):
    draw = random.Random(6)
    label = [draw.getrandbits(60) for _ in range(300)]
    some = [tuple(draw.sample(label[:200], 2)) for _ in range(110)]
    more = [tuple(draw.sample(label, 2)) for _ in range(60)]
    frame_of = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    found = components.merged(components.components(frame_of(some)), frame_of(more)).collect()
    whole = {r.node: r.component for r in components.components(frame_of(some + more)).collect()}
    assert len(found) == len(whole) and {r.node for r in found} == set(whole)
    groups = [defaultdict(set), defaultdict(set)]
    for r in found:
        groups[0][r.component].add(r.node)
        groups[1][whole[r.node]].add(r.node)
    assert sorted(map(sorted, groups[0].values())) == sorted(map(sorted, groups[1].values()))


def test_repeated_lines_of_no_documents(spark):
    assert line_dedup.repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_only_linked_copies_keep_repeated_lines(spark):
    draw = random.Random(8)

    def some(n):
        return [" ".join("".join(draw.choice("abcdefghijklm") for _ in range(6)) for _ in range(8)) for _ in range(n)]

    a, b, boiler, own = some(12), some(10), some(6), some(3)
    docs = {
        1: a,
        2: [*a, own[0]],  # a near copy keeps its lines, for the next stage to remove it
        3: [b[0], b[0], b[0], b[1]],  # repeats of its own lines alone
        4: boiler[:3],
        5: boiler[3:],
        6: [*boiler, own[1]],  # repeats of several documents
        7: [*a[:9], *some(7)],  # most characters of one document, but no near duplicate
        8: [*b[2:], *boiler[:2]],
        9: [*b[2:], *boiler[:2]],  # a copy, but for what its original loses too
    }
    want = {**docs, 3: b[:2], 6: own[1:2], 7: docs[7][9:], 8: b[2:], 9: b[2:]}
    df = spark.createDataFrame(rows_of([(k, "\n".join(x)) for k, x in docs.items()]), SCHEMA)
    cut = line_dedup.without_repeated_lines(df, linked_copies=True)
    assert cut.columns == df.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {k: "\n".join(x) for k, x in want.items()}
    assert sorted(r.doc_id for r in near_duplicates.deduplicated(cut).collect()) == [1, 3, 4, 5, 6, 7, 8]
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.without_repeated_lines(empty, linked_copies=True).collect() == []


def test_native_shingles_are_those_of_near_duplicates(spark):
    texts = ["a b c d e f a b c d e", "One", "ONE two", "", " \t\n", None, "x\u00a0y z\x0bw\x1fv É é q", " a  b c d e "]
    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in found.select("t", F.size(line_dedup.shingles(F.col("t"))).alias("n")).collect():
        assert max(r.n, 0) == len(plain_shingles(r.t))


def test_pipeline_line_plan_has_no_python(spark):
    df = spark.createDataFrame(rows_of(line_documents(1)), SCHEMA)
    plan = line_dedup.without_repeated_lines(df, linked_copies=True)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance_equals_the_matrix(spark, edits):
    draw = random.Random(edits)
    pairs = []
    for _ in range(150):
        a = [draw.choice("abé") for _ in range(draw.randint(0, 9))]
        b = list(a)
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = draw.choices("abc", k=draw.randint(0, 1))
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        assert min(r.d, edits + 1) == min(distance(r.a, r.b), edits + 1)


def test_line_plans_have_no_python(spark):
    df = spark.createDataFrame(rows_of(line_documents(1)), SCHEMA)
    plan = line_dedup.repeated_lines(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- benchmark -----------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_report(text, items):
    found = plain_words(text)
    hit, names = set(), set()
    for name, item in items:
        own = plain_words(item)
        size = min(10, len(own))
        windows = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(found) - size + 1):
            if size and tuple(found[k : k + size]) in windows:
                hit.update(range(k, k + size))
                names.add(str(name) if name is not None else "null")
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(found), len(hit), len(names), digest, bool(hit)


def benchmark_case(seed):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "cé", "d1", "e"]
    items = [(k, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([2, 4, 11, 15])))) for k in range(8)]
    items += [(None, "lonely phrase here"), (20, None), (21, "..."), (3, items[3][1])]
    texts = []
    for k in range(25):
        found = [draw.choice([*vocabulary, "zz"]) for _ in range(draw.randint(0, 60))]
        if draw.random() < 0.6:
            found[draw.randint(0, len(found)) : 0] = (draw.choice(items)[1] or "").split()
        texts.append((k, draw.choice([" ", ", ", "\n- "]).join(found)))
    return [*texts, (50, None), (51, ""), (52, "Lonely, PHRASE here!"), (53, texts[0][1])], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_equals_brute_force(spark, seed, block_bytes):
    texts, items = benchmark_case(seed)
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.report(df, benchmark, block_bytes=block_bytes).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == {k: plain_report(t, items) for k, t in texts}


def test_cut_passages_are_gone_and_the_rest_stays(spark):
    texts = [(1, "Keep é this. one two, three! And this."), (2, "one two four"), (3, None)]
    benchmark = spark.createDataFrame([(1, "One two three")], "item_id long, text string")
    df = spark.createDataFrame(rows_of(texts), SCHEMA)
    cut = decontamination.decontaminate(df, benchmark)
    assert cut.columns == df.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "Keep é this. ! And this.", 2: "one two four", 3: None}
    none = decontamination.report(df, benchmark.limit(0)).collect()
    assert [(r.n_words, r.n_hit) for r in sorted(none, key=lambda r: r.doc_id)] == [(8, 0), (3, 0), (0, 0)]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1))
def test_fm_index_finds_every_place(text, phrases):
    text = np.array([0, *text, 0])
    index = decontamination.FMIndex(text, 4)
    width = max(map(len, phrases))
    table = np.array([[0] * (width - len(p)) + p for p in phrases])
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for phrase, a, b in zip(phrases, low, high):
        places = sorted(index.locate(np.arange(a, b)).tolist())
        assert places == [k for k in range(len(text)) if text[k : k + len(phrase)].tolist() == phrase]
