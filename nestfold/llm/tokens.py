"""Token ids in Simple-8b blocks: written in ascending order of documents, read back with their offsets."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nestfold.llm import simple8b

WORDS_KEPT = 500_000  # words whose ids a worker remembers before it starts anew
CHUNK = 2 << 20  # bytes of text taken together
BLOCK_IDS = 1 << 16  # ids of a block, but for one long document
END = "\n"  # stands for the end id; no word holds white space
# Letters that no normalization joins with a neighbour, and whose small letters are told one by one.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}]+")
# A single mark behind such a letter, at the end of a word: a token of its own with or without space.
_MARK = rf"([{_LETTERS}])([.,])([\t-\r ]|$)"
# A capital and a mark that joins it: some (J and a caron, H and a line below) have one letter for both only when
# small, and the tokenizer joins before it makes small.
_JOINED = r"[A-Z]\p{M}"


class WordIds(dict):
    """Word -> its number; ``flat`` and ``ends`` hold the ids of all words by number.

    The tokenizer drops white space and cuts words apart there, so the ids of a text are those of its
    words in turn. Unknown words wait in ``fresh`` until ``learn`` asks for all of them at once.
    """

    def __init__(self, tokenizer, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = tokenizer
        # The same merges without normalization, for plain words in small letters.
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = [i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.closes = np.zeros(tokenizer.get_vocab_size() + 1, bool)
        self.closes[last] = True
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        """Start anew; word 0 is the end id, word 1 is empty."""
        self.clear()
        self[END], self[""] = 0, 1
        self.flat, self.ends, self.fresh = np.array([self.end_id], np.uint32), np.array([1, 1]), []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at

    def learn(self) -> None:
        """Ids of the fresh words; plain ones are cut apart where a token closes a word."""
        if not self.fresh:
            return
        plain = [k for k, w in enumerate(self.fresh) if _PLAIN.fullmatch(w)]
        odd = sorted(set(range(len(self.fresh))).difference(plain))
        texts = [" ".join([self.fresh[k] for k in plain[a : a + 500]]).lower() for a in range(0, len(plain), 500)]
        found = [np.array(e.ids, np.uint32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        cuts = np.flatnonzero(self.closes[np.concatenate(found)]) + 1 if found else np.empty(0, np.int64)
        texts = [self.fresh[k] for k in odd]
        others = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        # Both came in an order of their own: back to that of the fresh words.
        sizes = np.concatenate([np.diff(cuts, prepend=0), np.array([len(o) for o in others], np.int64)])
        order = np.empty(len(sizes), np.int64)
        order[plain + odd] = np.arange(len(sizes))
        begins, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)
        self.flat = np.concatenate([self.flat, np.concatenate(found + others)[at]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends])
        self.fresh = []

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids of all texts end to end, number of each)``, the end id behind each. Each word is looked up once."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        small = pc.if_else(pc.match_substring_regex(texts, _JOINED), texts, pc.ascii_lower(texts))
        cut = pc.replace_substring_regex(small, _MARK, r"\1 \2\3")
        # A special token is told by its case.
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, cut))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        coded = pc.list_flatten(words).dictionary_encode()
        known = coded.dictionary.to_pylist()
        numbers = np.fromiter(map(self.__getitem__, known), np.int64, len(known))
        self.learn()
        last = np.cumsum(counts) - 1
        at = np.zeros(int(counts.sum()), np.int64)
        inner = np.ones(len(at), bool)
        inner[last] = False
        at[inner] = numbers[coded.indices.to_numpy()]
        begins = np.concatenate([[0], self.ends[:-1]])
        lengths = (self.ends - begins)[at]
        stops = np.cumsum(lengths)
        ids = self.flat[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(begins[at] - (stops - lengths), lengths)]
        if len(self) > WORDS_KEPT:
            self.forget()
        return ids, np.diff(stops[last], prepend=0)


@lru_cache
def word_ids(path: str, end_id: int) -> WordIds:
    """One memory of words for each worker; Spark spreads the work, so the library gets no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(path), end_id)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """``(ids, texts)`` of about CHUNK bytes, or of one long text."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
            yield ids[a:b], texts.slice(a, b - a)
            a = b


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, base, block = TaskContext.get().partitionId(), 0, 0
        words = word_ids(path, end_id)
        for keys, texts in _chunks(batches):
            ids, counts = words.of(texts)
            stops = np.cumsum(counts)
            a = 0
            while a < len(keys):
                before = int(stops[a] - counts[a])
                b = max(a + 1, int(np.searchsorted(stops, before + BLOCK_IDS, "right")))
                n = int(stops[b - 1]) - before
                packed = simple8b.encode(ids[before : before + n], counts[a:b])
                bare = [k is None for k in keys[a:b]]
                held = simple8b.pack(np.array([k or 0 for k in keys[a:b]]), counts[a:b], *packed)
                yield pa.RecordBatch.from_pydict(
                    {"part": [part], "block": [block], "base": [base], "n_ids": [n], "unnamed": [sum(bare)], "held": [held]}, _FILE
                )
                base, block, a = base + n, block + 1, b

    return run


_FILE = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("base", pa.int64()), ("n_ids", pa.int64()), ("unnamed", pa.int32()), ("held", pa.binary())])
_FILE_DDL = "part int, block int, base long, n_ids long, unnamed int, held binary"


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str | None = None,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the token ids of ``docs`` into ``folder``: Simple-8b blocks in ascending order of ids.

    Spark's own writer holds the blocks (one binary value each), so that lost executors and
    repeated tasks leave whole files. ``part`` and ``block`` give their order; a block knows the ids
    before it in its part. ``tokenizer`` is the path of a vocabulary file.

    A null or empty text has the end id alone. Null ids come first; rows with equal ids are ordered by
    text and all written. An empty table makes no block. Other columns are not read.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(_write(path, end_id), _FILE_DDL).write.option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, unnamed, held in zip(*(batch.column(c).to_pylist() for c in ("start", "unnamed", "held")), strict=True):
            keys, counts, _, words, escapes = simple8b.unpack(held)
            ids = simple8b.decode(words, escapes).astype("<u4").tobytes()
            stops = np.cumsum(counts, dtype=np.int64)
            begins = stops - counts
            named = [None] * unnamed + keys[unnamed:].tolist()
            made = [ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(named, pa.int64()), pa.array(begins + start), pa.array(counts.astype(np.int64)), pa.array(made, pa.binary())],
                ["id", "start", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids)`` of each document: ids before it in the whole table, ids of its own,
    and these as little-endian unsigned 32-bit integers."""
    blocks = spark.read.schema(_FILE_DDL).parquet(folder)
    # One row for each task that wrote: its ids, and those of the tasks before it.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("before") + F.col("base")).alias("start"), "unnamed", "held")
    out = placed.mapInArrow(_read, "id long, start long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)
