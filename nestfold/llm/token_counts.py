"""Token counts by a whole-token shortcut.

Merges never cross a place where no vocabulary string holds the two neighbouring characters together. Where
spaces follow something else, and around a separator that stands in no string at all, this holds for the
vocabulary (it is looked up, not assumed), so a text falls into pre-tokens whose tokens add up. Which vocabulary
strings encode alone as one token is proved once, before any text is seen; pre-tokens among them count as one. Only the rest
is merged, each different one once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 2 << 20  # bytes of text taken together
KEPT = 500_000  # merged pre-tokens that a worker remembers before it starts anew
SHORT = 64  # characters of a pre-token that is worth remembering
SPACE = "▁"  # what the vocabulary writes for a space
SEPARATORS = ("\n", "\x00", "\x01", "\ue000")


class PreTokens:
    """Numbers of tokens of pre-tokens: proved ones from the start, merged ones as they come."""

    def __init__(self, model):
        self.model = model
        bare = [k for k in range(model.vocab_size()) if model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)]
        strings = [model.id_to_piece(k) for k in sorted(set(range(model.vocab_size())).difference(bare))]
        # What the cuts rest on: text goes through unchanged with a space before it, no string holds a space behind something else or the separator.
        through = "".join(model.encode("x  ﬁ  ", out_type=str))
        self.separator = next((c for c in SEPARATORS if not any(c in s for s in strings)), None)
        if through != f"{SPACE}x{SPACE}{SPACE}ﬁ {SPACE}" or self.separator is None or any(SPACE in s.lstrip(SPACE) for s in strings):
            raise ValueError("a vocabulary with other normalization, or with strings across words")
        self.cut = f"([^ {self.separator}]) ", f"\\1{self.separator} "
        self.before = len(model.encode(self.separator))  # tokens of the space and the separator before a pre-token
        alone = self.merged([s.replace(SPACE, " ") for s in strings])
        self.whole = {s.replace(SPACE, " "): 1 for s, n in zip(strings, alone, strict=True) if n == 1}
        self.known = {"": 0} | self.whole

    def merged(self, pre_tokens: list[str]) -> list[int]:
        """Numbers of tokens, as the library merges them."""
        found = self.model.encode([self.separator + p for p in pre_tokens], num_threads=1)
        return [len(ids) - self.before for ids in found]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), SPACE, " ")
        # The separators of a text itself are tokens; those set between pre-tokens aren't.
        own = pc.count_substring(texts, self.separator).to_numpy(zero_copy_only=False).astype(np.int64)
        begun = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise("", texts, " "))
        cut = pc.split_pattern(pc.replace_substring_regex(begun, *self.cut), self.separator)
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(cut).dictionary_encode()
        different = coded.dictionary.to_pylist()
        fresh = [p for p in different if p not in self.known]
        made = dict(zip(fresh, self.merged(fresh), strict=True))
        known = self.known
        tokens = np.fromiter((known[p] if p in known else made[p] for p in different), np.int64, len(different))
        stops = np.concatenate([[0], np.cumsum(tokens[coded.indices.to_numpy()])])
        ends = np.cumsum(sizes)
        if len(known) + len(made) > len(self.whole) + KEPT:
            self.known = known = {"": 0} | self.whole
        known.update((p, n) for p, n in made.items() if len(p) <= SHORT)
        return stops[ends] - stops[ends - sizes] + own * (self.before - 1)


@lru_cache
def pre_tokens(path: str) -> PreTokens:
    """One memory for each worker."""
    import sentencepiece

    return PreTokens(sentencepiece.SentencePieceProcessor(model_file=path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pre_tokens(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, found, a = np.cumsum(sizes), [np.empty(0, np.int64)], 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + CHUNK, "right")))
                found.append(known.counts(texts.slice(a, b - a)))
                a = b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(np.concatenate(found))], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of each row: UTF-8 bytes, tokens, and whether these are more than ``limit``.

    ``model`` is the path of a sentencepiece vocabulary whose normalization leaves texts as they are; another one
    raises a ValueError. Tokens are those of the library, without any added ones.

    Null and empty texts have no bytes and no tokens. Rows that repeat are each counted; a null id stays. An empty
    table gives none. Long texts are taken one by one and whole. Other columns are not read.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_count(path), "id long, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
