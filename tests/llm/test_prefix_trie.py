"""The conversation trie against plain Python, with blocks, parts and pieces of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from nestfold.llm import prefix_trie as trie

TURNS = "conv_id long, turn long, role string, text string, turns string, seq string, key int, part string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "s", 1, "p") for r in rows], TURNS)


def in_order(rows):
    """Conversation -> its turns (role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            held[conv].append((turn is not None, turn or 0, digest, (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in held.items()}


def rebuilt(convs):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 6
        return convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + convs[c][h:]

    return {c: one(c) for c in convs}


def nodes(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (min(held), len(path), min(members[path[:-1]]) if path else None, len(held), children.get(path, 0), leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, held in members.items()
    )


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def check(spark, rows, rebuild=True, block=trie.BLOCK):
    made = trie.sequences(frame(spark, rows))
    convs = in_order(rows)
    got = trie.prefix_trie(trie.share_heads(made) if rebuild else made, block)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert order(map(tuple, got.collect())) == order(nodes(rebuilt(convs) if rebuild else convs))


def some_rows(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 5000), convs):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 9, 60, trie.BLOCK])
def test_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "CHUNK", 3)
    check(spark, some_rows(3, 250, 9, ["a", "b", "ça", None]), rebuild=False, block=block)


def test_heads_of_others(spark):
    rows = some_rows(4, 300, 9, ["a", "b", "ça", ""])
    rows += [(c, t, "user", "a") for c in range(600, 700, 3) for t in range(7)]
    check(spark, rows, block=50)


def test_one_common_first_turn_and_one_common_conversation(spark):
    rows = [(c, t, "u", "hello" if t < 2 else "x") for c in range(400) for t in range(5)]
    rows += [(c, t, "u", "hello" if t == 0 else f"{c}") for c in range(1000, 1400) for t in range(3)]
    check(spark, rows, rebuild=False, block=40)


def test_long_conversations(spark):
    rows = [(c, t, "u", "x" if t < 300 + c else f"{c}") for c in range(4) for t in range(700)]
    check(spark, rows, rebuild=False, block=500)


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "u", "b"), (1, None, None, "a"), (1, 0, "u", None), (1, 0, "u", None), (1, 0, None, "u"), (2, None, "u", "b"), (None, 0, "u", "b"), (3, 1, "a", "bc"), (4, 1, "ab", "c")]
    check(spark, rows, rebuild=False)
    check(spark, rows)


def test_turnless_conversations(spark):
    gone = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2]  # their first turns go, and no donor is there
    check(spark, [(c, t, "u", "x") for c in gone[:5] for t in range(2)] + [(777, t, "u", "x") for t in range(9)])
    check(spark, [(gone[0], 0, "u", "x")])


def test_empty_table(spark):
    check(spark, [])


def test_extents_against_a_scan():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 5, 60)
    table = trie._minima(values)
    rows, depths = (a.ravel() for a in np.meshgrid(np.arange(60), np.arange(5)))
    right, left = trie.right_ends(table, rows, depths), trie.left_ends(table, rows, depths)
    for r, d, b, a in zip(rows, depths, right, left, strict=True):
        while b + 1 < 60 and r == b and values[b + 1] >= d:
            raise AssertionError((r, d, b))
        assert all(values[r + 1 : b + 1] >= d) and (b == 59 or values[b + 1] < d)
        assert all(values[a + 1 : r + 1] >= d) and (a == 0 or values[a] < d)
