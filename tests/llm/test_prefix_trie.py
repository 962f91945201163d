"""The prefix trie against plain dictionaries, the rollup against a walk up the tree."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perfattr.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, k1 int"


def rebuilt(rows):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in said.items()}
    out = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))  # as in SQL, towards zero
        out[c] = said.get(base, [])[:h] + turns[h:]
    return out


def brute_force(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]),
            leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, own in members.items()
    )


def found(spark, rows, piece=prefix_trie.PIECE, plain=False):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    turns, runs = prefix_trie.ranked(table)
    make = prefix_trie.as_they_are if plain else prefix_trie.spliced
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(*make(turns, runs), piece=piece).collect())


def conversations(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < 0.1:
            continue
        for t in range(draw.randint(1, 11)):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "", None, "ccc"])))
    rows += [(300 + k, t, "user", f"same {t}") for k in range(40) for t in range(3)]  # copies
    rows += [(-7, 1, "user", "below zero"), (-5, 1, "user", "base"), (400, None, "x", "null first"), (400, 0, "x", "y")]
    rows += [(401, 2, "user", "twice"), (401, 2, "user", "twice"), (None, 0, "user", "nobody's")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [12, prefix_trie.PIECE])
def test_trie_equals_dictionaries(spark, piece):
    rows = conversations(3, 60)
    assert found(spark, rows, piece) == brute_force(rebuilt(rows))


def test_deep_conversation_and_its_copy(spark, monkeypatch):
    """Longer than a run of turns and than a piece, so keys are carried on and the chain is split by joins."""
    monkeypatch.setattr(prefix_trie, "RUN", 16)
    rows = [(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(90)]
    rows += [(3, t, "user", f"turn {t}" if t < 40 else f"other {t}") for t in range(70)]
    whole = {c: [(r, x) for _, _, r, x in sorted(y for y in rows if y[0] == c)] for c in (1, 2, 3)}
    assert found(spark, rows, 30, plain=True) == brute_force(whole)


def test_empty_table_has_no_root(spark):
    assert found(spark, []) == []


def test_conversations_may_lose_all_their_turns(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert found(spark, rows) == brute_force(rebuilt(rows)) == [
        (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())
    ]


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 10**6), max_size=60), st.integers(1, 3))
def test_rollup_equals_walk(draws, tops):
    """Forests of any shape: a node's parent is one of those before it."""
    parent = np.array([-1] * tops + [d % (k + tops) for k, d in enumerate(draws)])
    values = np.stack([np.arange(len(parent)), np.ones(len(parent), int)], axis=1)
    expected = np.zeros_like(values)
    for k in range(len(parent)):
        at = k
        while at >= 0:
            expected[at] += values[k]
            at = parent[at]
    assert (prefix_trie.rollup(parent, expected[:, 1], values) == expected).all()


def test_rollup_of_a_chain_takes_few_rounds():
    n = 20_000
    parent = np.arange(n) - 1
    totals = prefix_trie.rollup(parent, n - np.arange(n), np.ones((n, 1), int))
    assert (totals[:, 0] == n - np.arange(n)).all()
