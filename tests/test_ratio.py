"""Batched ratios against the standard library."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from nestfold.operators.ratio import ratios


def points(texts):
    return [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]


def check(pairs):
    got = ratios(points([a for a, _ in pairs]), points([b for _, b in pairs]))
    for (a, b), r in zip(pairs, got, strict=True):
        assert r == SequenceMatcher(None, a, b).ratio(), (a, b, r)


def variant(rng, text, alphabet):
    out = list(text)
    for _ in range(rng.randrange(8)):
        at = rng.randrange(len(out) + 1)
        match rng.randrange(3):
            case 0:
                out[at:at] = rng.choices(alphabet, k=rng.randrange(4))
            case 1:
                del out[at : at + rng.randrange(4)]
            case 2:
                out[at : at + 2] = reversed(out[at : at + 2])
    return "".join(out)


@pytest.mark.parametrize("alphabet, longest, n", [("ab", 30, 40_000), ("abcdefč 😀", 40, 40_000), ("stan centar 60", 90, 15_000)])
def test_short_texts(alphabet, longest, n):
    rng = random.Random(longest)
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(longest))) for _ in range(n)]
    check([(t, variant(rng, t, alphabet) if rng.random() < 0.5 else texts[rng.randrange(n)]) for t in texts])


def test_long_texts_with_popular_characters():
    """From 200 characters on, frequent characters of the right text start no block."""
    rng = random.Random(3)
    words = ["dvosoban", "stan", "lux", "centar", "vračar", "nov", "uknjižen", "terasa", "60m²", "hitno", "x", "yy"]
    pairs = []
    for _ in range(1500):
        a = " ".join(rng.choices(words, k=rng.randrange(20, 60)))
        pairs.append((a, variant(rng, a, "abc ")))
        pairs.append((a, " ".join(rng.choices(words, k=rng.randrange(25, 50)))))
    check(pairs)
    check([("a" * 300, "a" * 300), ("a" * 300, "ab" * 150), ("xa" + "b" * 250, "xab" * 90), ("é" * 199, "é" * 199), ("é" * 199, "é" * 200)])


def test_empty_texts():
    check([("", ""), ("a", ""), ("", "a"), (" ", " ")])
    assert ratios([], []).tolist() == []
