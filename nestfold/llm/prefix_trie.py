"""Prefix trie of conversations, from sorted sequences and range minima over their LCPs.

Equal conversations are one row from the start. The different ones are sorted over the whole table; members of a prefix
stand next to each other there. Within a block of sorted rows a sparse table holds minima of neighbours' longest
common prefixes (LCPs), and each candidate prefix, on its own, searches the ends of its interval by halving steps, its
parent's left end likewise: no stack, no order among candidates. Sums over members and over
subtrees are differences of running sums. Each part of the sort knows the last row before it and the first behind
it, so that only prefixes reaching beyond a block, a path at each of its ends, are left to be merged by key.

Texts stay where they are read: a turn is an md5 of its role and text and a length from there on. A conversation is one row of
20 bytes a turn, like a text that is taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestfold.session import broadcast_if_small, cut

BLOCK = 1 << 18  # turns of a block, but for one long conversation
CHUNK = 1 << 16  # conversation ids written into one piece of text
WIDE = 16  # bytes of a turn's digest
TURNS = "array<struct<turn:bigint,digest:binary,chars:int>>"


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)`` of each conversation: its turns' digests and code points, by ``turn``, null first.

    A null role or text is empty. Turns that share a number are ordered by digest; equal rows are
    several turns. Rows without a conversation id belong to none and go.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).filter("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def share_heads(made: DataFrame, every: int = 100, longest: int = 6) -> DataFrame:
    """``sequences`` with heads of others: of conversation c the first h turns, h = crc32(c in decimal) mod ``longest``, come
    from conversation c - c % ``every`` (all it has; none if it isn't there), the rest are its own. For negative ids % keeps the sign."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    donors = made.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, longest).alias("head"))
    made = made.withColumn("donor", F.col("conv_id") - F.col("conv_id") % every).join(donors, "donor", "left")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.array().cast(TURNS))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return made.select("conv_id", F.concat(head, own).alias("turns"))


def _member_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id) -> pieces of the comma-joined ids of each key, in order."""
    part, piece, key, ids = TaskContext.get().partitionId(), 0, None, []
    made: list[tuple] = []

    def ended() -> None:
        nonlocal piece
        if ids:
            made.append((key, part, piece, ",".join(ids)))
            piece += 1
            ids.clear()

    for batch in batches:
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key or len(ids) >= CHUNK:
                ended()
                key = k
            ids.append(str(conv))
        yield _pieces(made)
        made.clear()
    ended()
    yield _pieces(made)


def _pieces(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)], ["key", "part", "piece", "ids"])


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, part, piece) -> SHA-256 of each key's list; one hash is under way at a time."""
    key, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k == key:
                running.update(b"," + ids.encode())
                continue
            if running:
                done.append((key, running.hexdigest()))
            key, running = k, hashlib.sha256(ids.encode())
        yield _digested(done)
    if running:
        yield _digested([(key, running.hexdigest())])


def _digested(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends"])


def _classes(seqs: DataFrame) -> DataFrame:
    """``(seq, chars, n, lead, ends)``: different sequences, their number, smallest id, and digest of all their ids."""
    seq = F.coalesce(F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")), F.lit(b""))
    rows = seqs.select("conv_id", seq.alias("seq"), F.col("turns.chars").alias("chars"))
    rows = cut(rows.withColumn("key", F.unhex(F.md5("seq"))))
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("lead"), F.first("seq").alias("seq"), F.first("chars").alias("chars")))
    several = broadcast_if_small(groups.filter("n > 1").select("key"))
    members = rows.select("key", "conv_id").join(several, "key")
    # A large group is dealt over several tasks, which write its ids; one task then hashes pieces, in their order.
    pieces = cut(members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_member_lists, "key binary, part int, piece long, ids string"))
    digests = pieces.repartition("key").sortWithinPartitions("key", "part", "piece").mapInArrow(_list_digests, "key binary, ends string")
    alone = F.sha2(F.col("lead").cast("string").cast("binary"), 256)
    return groups.join(digests, "key", "left").select("seq", "chars", "n", "lead", F.coalesce("ends", alone).alias("ends"))


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: at level k the minima of runs of 2**k values."""
    table = [values]
    while len(table[-1]) > 1 << (len(table) - 1):
        w = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-w], table[-1][w:]))
    return table


def right_ends(table: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The last row to which each candidate's LCPs stay at its depth or above; ``table`` is of LCPs with the row before."""
    at, n = rows.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        fits = at + (1 << k) < n
        fits[fits] = table[k][at[fits] + 1] >= depths[fits]
        at += fits.astype(at.dtype) << k
    return at


def left_ends(table: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The first such row."""
    at = rows.copy()
    for k in range(len(table) - 1, -1, -1):
        fits = at - (1 << k) >= 0
        fits[fits] = table[k][at[fits] - (1 << k) + 1] >= depths[fits]
        at -= fits.astype(at.dtype) << k
    return at


def lcps(seqs: list[bytes]) -> np.ndarray:
    """LCP in turns of each sequence with the one before it; the first has -1."""
    sizes = np.array([len(s) // WIDE for s in seqs], np.int64)
    out = np.full(len(seqs), -1, np.int64)
    flat = np.frombuffer(b"".join(seqs), np.uint64).reshape(-1, 2)
    starts = np.cumsum(sizes) - sizes
    common = np.minimum(sizes[1:], sizes[:-1])
    out[1:] = common
    some = np.flatnonzero(common)
    if len(some):
        n = common[some]
        begins = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(begins, n)
        same = (flat[np.repeat(starts[1:][some], n) + inner] == flat[np.repeat(starts[:-1][some], n) + inner]).all(1)
        out[1:][some] = np.minimum.reduceat(np.where(same, np.repeat(n, n), inner), begins)
    return out


def _prefix_keys(seq: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of 0 to ``depth`` turns."""
    h, out = hashlib.md5(), []
    for d in range(depth + 1):
        if d:
            h.update(seq[(d - 1) * WIDE : d * WIDE])
        out.append(h.copy().digest())
    return out


_NODE = pa.schema(
    [("key", pa.binary()), ("parent_key", pa.binary())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.string())]
)
_NODE_DDL = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def block_nodes(rows: list[tuple], before: bytes | None, behind: bytes | None) -> pa.RecordBatch:
    """The nodes of sorted rows (seq, chars, n, lead, ends) between the rows ``before`` and ``behind`` (None: the table ends).

    A node that reaches beyond the rows has a ``key``, and its sums are the share of these rows.
    """
    seqs = [r[0] for r in rows]
    n = len(rows)
    around = lcps([before or b"", *seqs, behind or b""])[1:]
    lcp, last = around[:-1], int(around[-1]) if behind is not None else -1
    if before is None:
        lcp[0] = -1
    sizes = np.array([len(s) // WIDE for s in seqs], np.int64)
    inner = lcp.copy()
    inner[0] = -1
    table, leads = _minima(inner), np.array([r[3] for r in rows], np.int64)

    # Candidates: each row brings the prefixes beyond its LCP, the first row of the block all of its own.
    brought = sizes - inner
    base = np.concatenate([[0], np.cumsum(brought)])
    row = np.repeat(np.arange(n), brought)
    depth = np.arange(int(base[-1])) - np.repeat(base[:-1], brought) + np.repeat(inner + 1, brought)
    end = right_ends(table, row, depth)
    new = depth > lcp[row]
    beyond = ~new | ((end == n - 1) & (depth <= last))

    members = np.concatenate([[0], np.cumsum([r[2] for r in rows])])
    n_convs = members[end + 1] - members[row]
    least = _minima(leads)
    level = np.frexp(end - row + 1)[1] - 1
    conv = np.empty(len(row), np.int64)
    for k in range(len(least)):
        here = np.flatnonzero(level == k)
        conv[here] = np.minimum(least[k][row[here]], least[k][end[here] - (1 << k) + 1])

    # Parents: one turn shorter in the same row, or the prefix of the LCP, which an earlier row brought.
    parent = np.arange(len(row)) - 1
    outer = np.flatnonzero((depth == inner[row] + 1) & (depth > 0))
    first = left_ends(table, row[outer], depth[outer] - 1)
    parent[outer] = base[first] + depth[outer] - 1 - inner[first] - 1
    parent[depth == 0] = -1
    children = np.bincount(parent[new & (parent >= 0)], minlength=len(row))

    flat = np.concatenate([np.empty(0, np.int64), *(r[1] for r in rows)]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    chars = np.zeros(len(row), np.int64)
    deep = depth > 0
    chars[deep] = flat[starts[row[deep]] + depth[deep] - 1]
    # Sums over subtrees: candidates stand in the order of a walk through the trie.
    follows = np.append(lcp[1:], last)
    leaf = new & (depth == sizes[row]) & (follows[row] < depth)
    until = base[end + 1]
    over = lambda values: (lambda total: total[until] - total[np.arange(len(row))])(np.concatenate([[0], np.cumsum(values)]))
    leaves, saved = over(leaf), over((n_convs - new) * chars)

    keys: list[bytes | None] = [None] * len(row)
    for k in np.flatnonzero(beyond).tolist():
        keys[k] = b""  # told below, path by path
    for r in {0, n - 1}:
        path = np.flatnonzero(beyond & (row <= r) & (end >= r))
        made = _prefix_keys(seqs[r], int(depth[path].max(initial=0)))
        for k, d in zip(path.tolist(), depth[path].tolist(), strict=True):
            keys[k] = made[d]
    inside = parent >= 0
    of_parent = [keys[p] if p >= 0 else None for p in parent.tolist()]
    known = inside & np.array([k is None for k in of_parent], bool)
    ends = [rows[r][4] if d == s else None for r, d, s in zip(row.tolist(), depth.tolist(), sizes[row].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(of_parent, pa.binary()), pa.array(conv), pa.array(depth), pa.array(conv[parent], mask=~known)]
        + [pa.array(c.astype(np.int64)) for c in (n_convs, children, leaves, saved)]
        + [pa.array(ends, pa.string())],
        schema=_NODE,
    )


def _nodes(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (part, seq); blocks end with their part, or when they are full."""
        part, rows, size, before, behind = None, [], 0, None, None
        for batch in batches:
            for p, prev, following, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "behind", "seq", "chars", "n", "lead", "ends")), strict=True):
                if part is not None and (p != part or size >= block):
                    yield block_nodes(rows, before, behind if p != part else row[0])
                    before, rows, size = rows[-1][0], [], 0
                if p != part:
                    part, before, behind = p, prev, following
                rows.append((row[0], np.array(row[1], np.int64), *row[2:]))
                size += len(row[1]) + 1
        if rows:
            yield block_nodes(rows, before, behind)

    return run


def prefix_trie(seqs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, a row for each node.

    ``seqs`` has one row for each conversation, as from ``sequences``. A node is a different sequence of the first turns;
    conversations that start with it are its members, and ``conv_id`` is the smallest. ``saved_tokens`` sums, over the
    node and all below it, members but one times code points of the last text. ``ends_sha256`` digests the ids of members that end there.

    A conversation without turns is a member of the root alone. An empty table has no node, not even the root.
    """
    classes = _classes(seqs).repartitionByRange("seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id())
    classes = cut(classes)
    # Two rows for each part: its first and last sequence; the neighbours of each part are told from them.
    order = Window.orderBy("part")
    edges = classes.groupBy("part").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    edges = edges.select("part", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("behind"))
    placed = classes.join(broadcast_if_small(edges), "part").repartition("part").sortWithinPartitions("part", "seq")
    nodes = cut(placed.select("part", "before", "behind", "seq", "chars", "n", "lead", "ends").mapInArrow(_nodes(block), _NODE_DDL))
    whole = nodes.filter("key is null")
    shared = nodes.filter("key is not null").groupBy("key", "depth").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends")
    )
    shared = cut(shared)
    named = broadcast_if_small(shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    out = whole.unionByName(shared.withColumn("parent_conv_id", F.lit(None).cast("long"))).join(named, "parent_key", "left")
    return out.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends_or_none(F.col("ends")).alias("ends_sha256")
    )


def ends_or_none(ends: Column) -> Column:
    """A node where no conversation ends has the digest of an empty list."""
    return F.coalesce(ends, F.sha2(F.lit(b""), 256))
