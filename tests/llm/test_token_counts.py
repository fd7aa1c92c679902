"""Token counts against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from nestfold.llm import token_counts
from nestfold.llm.token_counts import PreTokens, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "A", " ", "  ", "    ", "\n", "▁", "\r", ";", ".", ",", "é", " ", "　", "\x00", "𝔸", "the", "The", "ing", "<s>", "</s>", "<0x0A>", "<unk>", "\t", "ﬁ", "1", "();", "​", "é"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def known(model):
    return PreTokens(model)


def test_odd_texts(model, known):
    rng = random.Random(7)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(14))) for _ in range(50_000)]
    want = [len(ids) for ids in model.encode(texts)]
    assert known.counts(pa.array(texts)).tolist() == want


def test_proved_strings_are_one_token(model, known):
    assert len(known.whole) > 30_000
    for s in random.Random(1).sample(sorted(known.whole), 3000):
        assert model.encode("\n" + s, out_type=str)[2:] == [s.replace(" ", "▁")]


def test_proved_strings_are_not_merged(model):
    """Pre-tokens among the proved strings, and remembered ones, never reach the library again."""
    known = PreTokens(model)
    asked = []
    merged = known.merged
    known.merged = lambda words: asked.extend(words) or merged(words)
    texts = pa.array(["the cat sat on the mat", "The qzxv\nqzxv the"])
    assert known.counts(texts).tolist() == [len(ids) for ids in model.encode(texts.to_pylist())]
    assert not set(asked) & set(known.whole) and set(asked) == {" qzxv", "qzxv"}
    asked.clear()
    known.counts(texts)
    assert not asked


def test_memory_starts_anew(model, monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 10)
    known, rng = PreTokens(model), random.Random(3)
    for _ in range(5):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(30)) for _ in range(9)]
        assert known.counts(pa.array(texts)).tolist() == [len(ids) for ids in model.encode(texts)]
        assert len(known.known) <= len(known.whole) + 1 + 10 + 30 * 9


def test_rows(spark, model):
    long = "Lorem ipsum, dolor\n" * 40_000
    texts = [None, "", " ", "one two", "one two", long, "x" * 100_000, "\n" * 5000]
    df = spark.createDataFrame([(k if k else None, t, 1, "n") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, id string")
    got = count_tokens(df).collect()
    want = [(k if k else None, len((t or "").encode()), len(model.encode(t or ""))) for k, t in enumerate(texts)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert {r.doc_id for r in got if r.over_limit} == {k for k, _, n in want if n > 4096} and all(r.over_limit is not None for r in got)
    assert count_tokens(df.limit(0)).collect() == []


def test_other_normalization_is_refused(known):
    class Folding:
        def __getattr__(self, name):
            return getattr(known.model, name)

        def encode(self, text, **options):
            return known.model.encode(text.replace("ﬁ", "fi") if isinstance(text, str) else text, **options)

    with pytest.raises(ValueError):
        PreTokens(Folding())
    assert np.array_equal(known.counts(pa.array([], pa.string())), np.empty(0, np.int64))
