"""MinHash near-duplicates with sequential Bayesian verification.

Every text becomes its set of word shingles, a MinHash signature and a key of the whole set. Equal
sets are one class from there on. Bands of the signature put classes into buckets; in each bucket
the members are first compared with one leader, which joins the bulk of a group in linear
work. What a bucket still holds apart is then compared there, in bounded tiles, and only between
different components. A comparison reads the signatures batch by batch and stops as soon as the
posterior probability of the wanted similarity falls below ``miss``; what survives is verified on the
full sets. Nothing but verified links leaves a tile, at most one for each of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from nestfold.llm.membership import bitmap, inside
from nestfold.llm.words import U64, binary, fresh, hashes_of, mix, seeds, shingles_of, words_of
from nestfold.operators.cluster import connected_components
from nestfold.session import broadcast_if_small, cut

ROWS = 4  # hashes of a band
BANDS = 24  # at similarity 0.8 a pair shares no band with probability (1 - 0.8**4)**24 = 3e-6
HASHES = 128  # length of a signature
BATCH = 16  # hashes that a comparison reads at a time
TILE = 1_000_000  # shingles of one side of a tile


@lru_cache
def least_matches(percent: int, miss: float) -> list[tuple[int, int]]:
    """``(hashes read, matches needed to go on)`` after each batch.

    With a flat prior the similarity after m matches of n is Beta(m + 1, n - m + 1), so
    P(similarity >= t) = P(Binomial(n + 1, t) <= m). Below ``miss`` the pair is dropped.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity, counted on the whole sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(size: int):
    factors = seeds(HASHES, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles_of(hashes_of(words_of(text, lower=True)), size)
                counts.append(len(found))
                if not len(found):
                    keys.append(None)
                    sigs.append(None)
                    continue
                keys.append(xxh3_128_digest(found.tobytes()))
                least = np.full(HASHES, ~U64(0))
                for k in range(0, len(found), 4096):  # bounded memory for very long texts
                    least = np.minimum(least, (found[k : k + 4096] * factors).min(1))
                sigs.append((least >> U64(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), pa.array(counts, pa.int64()), binary(keys), binary(sigs)],
                ["id", "digest", "n_shingles", "key", "sig"],
            )

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        for band in range(BANDS):
            h = np.full(len(sig), band + 1, U64)
            for k in range(ROWS):
                h = mix(h + sig[:, band * ROWS + k].astype(U64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.full(len(sig), band, np.int32)), batch.column("node")],
                ["bucket", "band", "node"],
            )


def _survivors(percent: int, miss: float):
    steps = least_matches(percent, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            left, matches, read = np.arange(len(a)), np.zeros(len(a), np.int64), 0
            for n, need in steps:
                matches = matches + (a[left, read:n] == b[left, read:n]).sum(1)
                left, matches, read = left[matches >= need], matches[matches >= need], n
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in ("a", "b")], ["a", "b"])

    return run


def _compare(percent: int, miss: float):
    """Rows sorted by tile, probes (role 0) first; links between probes and targets of other components."""
    steps = least_matches(percent, miss)

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        probes, targets = [r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1]
        if not probes or not targets:
            return
        group: dict[int, int] = {}

        def root(x: int) -> int:
            while group.setdefault(x, x) != x:
                group[x] = x = group[group[x]]
            return x

        nodes = np.array([r[1] for r in targets])
        comps = np.array([r[2] for r in targets])
        sets = [np.frombuffer(r[5], U64) for r in targets]
        sizes = np.array([len(s) for s in sets])
        signed = rows[0][4] is not None
        sig = np.frombuffer(b"".join(r[4] for r in targets), np.uint32).reshape(-1, HASHES) if signed else None
        for _, node, comp, band, mine, own in probes:
            own = np.frombuffer(own, U64)
            left = np.flatnonzero((comps != comp) & (nodes != node) & (sizes * 100 >= percent * len(own)) & (sizes * percent <= 100 * len(own)))
            if signed:
                mine, matches, read = np.frombuffer(mine, np.uint32), 0, 0
                for n, need in steps:
                    matches = matches + (sig[left, read:n] == mine[read:n]).sum(1)
                    left, matches, read = left[matches >= need], matches[matches >= need], n
                if band:  # a pair that shares an earlier band is compared there
                    k = band * ROWS
                    earlier = (sig[left, :k] == mine[:k]).reshape(-1, band, ROWS).all(2).any(1)
                    left = left[~earlier]
            for t in left:
                other = int(nodes[t])
                if root(node) != root(other) and linked(own, sets[t], percent):
                    group[root(other)] = root(node)
                    yield node, other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, found = None, [], []

        def ended() -> None:
            found.extend(links(rows))
            rows.clear()

        for batch in batches:
            for block, salt, *row in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "role", "node", "comp", "band", "sig", "shingles")), strict=True):
                if (block, salt) != tile:
                    ended()
                    tile = (block, salt)
                rows.append(tuple(row))
            if len(found) > 10_000:
                yield _pairs(found)
                found.clear()
        ended()
        yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _shingle_sets(size: int, wanted):
    """Sets of the texts whose hash may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(np.flatnonzero(inside(wanted.value, batch.column("hash").to_numpy().view(U64))))
            texts = batch.column("text").take(at).to_pylist()
            sets = [shingles_of(hashes_of(words_of(t, lower=True)), size) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(at), pa.array([len(s) for s in sets], pa.int64()), binary([s.tobytes() for s in sets])],
                ["node", "n", "shingles"],
            )

    return run


_TILE = "block long, salt int, role int, node long, comp long, band int, sig binary, shingles binary"


def _compared(rows: DataFrame, percent: int, miss: float) -> DataFrame:
    rows = rows.select(*(c.split()[0] for c in _TILE.split(", ")))
    rows = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", "role", "node")
    return rows.mapInArrow(_compare(percent, miss), "a long, b long")


def _classified(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, miss: float) -> tuple[DataFrame, DataFrame]:
    """``(id, digest, n_shingles, key)`` of each row, and ``(key, comp, component_id)`` of the sets that have copies or links:
    the number of their component, and its smallest id. Sets are numbered by themselves, so different texts under
    one id stay apart, and so do components with one smallest id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    sketched = cut(rows.mapInArrow(_sketch(size), "id long, digest binary, n_shingles long, key binary, sig binary"))

    # A class is numbered by its smallest id. Where an id has several rows, rows are numbered first, equal ones alike.
    named = sketched.filter("key is not null and id is not null")
    numbers = _numbers(sketched)
    numbered = named.withColumn("node", F.col("id")) if numbers is None else named.join(numbers, ["id", "digest"])
    lead = F.min(F.struct("id", "digest", "node", "sig")).alias("lead")
    classes = cut(numbered.groupBy("key").agg(lead, F.count("*").alias("copies")).select("key", "copies", "lead.id", "lead.node", "lead.sig"))
    signatures = classes.select("node", "sig")
    spark = docs.sparkSession

    def sets_of(needed: DataFrame) -> DataFrame:
        """The full shingle sets of the needed nodes, and of some others: a bitmap of the needed ones goes to the texts,
        which are neither shuffled nor joined where ids are unique."""
        wanted = spark.sparkContext.broadcast(bitmap(needed.select(F.xxhash64("node").alias("hash"))))
        texts = rows.filter("id is not null").withColumn("node", F.col("id"))
        if numbers is not None:
            texts = rows.join(numbers.join(needed, "node", "left_semi"), ["id", "digest"]).select("node", "text").distinct()
        hashed = texts.select("node", F.xxhash64("node").alias("hash"), "text")
        return cut(hashed.mapInArrow(_shingle_sets(size, wanted), "node long, n long, shingles binary"))

    bands = cut(signatures.mapInArrow(_buckets, "bucket long, band int, node long"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    live = cut(bands.join(shared, "bucket"))

    # One leader for each bucket: the member whose buckets are the fullest stands in the middle of its group.
    weight = live.groupBy("node").agg(F.sum("members").alias("weight"))
    led = live.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"))
    led = cut(led)
    star = live.join(led, "bucket").filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    signed = star.join(signatures.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    signed = signed.join(signatures.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    star = cut(signed.select("a", "b", "sig_a", "sig_b").mapInArrow(_survivors(percent, miss), "a long, b long"))

    needed = cut(star.select(F.col("a").alias("node")).union(star.select("b")).distinct())
    sets = sets_of(needed)
    salted = star.join(star.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts")), "a")
    blank = [F.lit(None).cast("binary").alias("sig"), "shingles"]
    members = salted.join(sets.withColumnRenamed("node", "b"), "b").select(
        F.col("a").alias("block"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"), F.col("b").alias("comp"), F.lit(0).alias("band"), *blank
    )
    heads = salted.select("a", "parts").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    heads = heads.join(sets.withColumnRenamed("node", "a"), "a").select(
        F.col("a").alias("block"), "salt", F.lit(0).alias("role"), F.col("a").alias("node"), F.col("a").alias("comp"), F.lit(0).alias("band"), *blank
    )
    links = cut(_compared(heads.unionByName(members), percent, miss))
    comps = cut(_components(links))

    # What a bucket still holds apart, but for its leader, whose pairs are all compared.
    held = live.filter("members > 2").join(led, "bucket").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    held = held.filter("node <> leader").select("bucket", "band", "node", "comp")
    apart = held.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    held = cut(held.join(apart, "bucket", "left_semi"))
    if not held.isEmpty():
        needed = cut(held.select("node").distinct())
        sets = sets_of(needed)
        largest = held.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("bulk"))
        held = held.join(sets.select("node", "n"), "node").join(largest, "bucket").withColumn("probe", F.col("comp") != F.col("bulk"))
        parts = held.groupBy("bucket").agg(
            F.ceil(F.sum("n") / TILE).cast("int").alias("t_parts"), F.ceil(F.sum(F.when(F.col("probe"), F.col("n"))) / TILE).cast("int").alias("p_parts")
        )
        held = cut(held.join(parts, "bucket"))
        t, p = (F.pmod(F.xxhash64("node", F.lit(k)), c).cast("int") for k, c in ((1, "t_parts"), (2, "p_parts")))
        steps = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
        targets = held.withColumn("q", F.explode(steps("p_parts"))).withColumn("salt", t * F.col("p_parts") + F.col("q")).withColumn("role", F.lit(1))
        probes = held.filter("probe").withColumn("q", F.explode(steps("t_parts"))).withColumn("salt", F.col("q") * F.col("p_parts") + p).withColumn("role", F.lit(0))
        tiles = targets.unionByName(probes).select(F.col("bucket").alias("block"), "salt", "role", "node", "comp", "band")
        tiles = tiles.join(signatures, "node").join(sets.select("node", "shingles"), "node")
        late = cut(_compared(tiles, percent, miss))
        if not late.isEmpty():
            comps = cut(_components(links.unionByName(late)))

    # A component has the smallest id of its sets.
    named = classes.select("node", "id").join(comps, "node")
    least = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = cut(named.join(least, "comp").select("node", "comp", "component_id"))
    final = classes.join(named, "node", "left").filter("copies > 1 or comp is not null")
    return sketched, cut(final.select("key", F.coalesce("comp", "node").alias("comp"), F.coalesce("component_id", "id").alias("component_id")))


def _numbers(sketched: DataFrame) -> DataFrame | None:
    """``(id, digest, node)``, a number for each different row; None where each id has one row and so is a number itself."""
    ids = sketched.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1").isEmpty():
        return None
    different = sketched.filter("id is not null and digest is not null").select("id", "digest").distinct()
    return cut(different.withColumn("node", F.monotonically_increasing_id()))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    miss: float = 1e-6,
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    Two texts are linked when 100 * shared shingles >= ``percent`` * all their shingles; a component's
    id is its smallest document id and that document is kept. Words are lower-cased in A-Z only.

    Null and empty texts have no shingles and are linked with nothing. Fewer than ``size`` words are
    one shingle. A null id gets no component and is kept. Rows that repeat an id each follow
    their own text; equal rows get equal results. Other columns are not read.
    """
    sketched, final = _classified(docs, id_col, text_col, size, percent, miss)
    out = sketched.select("id", "n_shingles", "key").join(final.drop("comp"), "key", "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, with the smallest id.

    Of different texts of a component under that id the one with the smallest md5 stays; of rows equal in id and text the
    last in the order of their columns written as JSON. Rows with a null id, and texts without words, all stay.
    """
    sketched, final = _classified(docs, id_col, text_col, size, percent, miss)
    rows = sketched.filter("id is not null").select("id", "digest", "key").join(final, "key")
    rows = cut(rows.groupBy("comp", "id", "digest").agg(F.count("*").alias("n")))
    stays = rows.groupBy("comp").agg(F.min(F.struct("id", "digest")).alias("stays"))
    rows = rows.join(stays, "comp").withColumn("stays", F.struct("id", "digest") == F.col("stays"))
    names = {c: fresh(docs.columns, f"near_{c}") for c in ("id", "digest")}
    told = cut(rows.filter("not stays or n > 1").select(*(F.col(c).alias(n) for c, n in names.items()), "stays"))
    marked = docs.withColumn(names["id"], F.col(id_col).cast("long")).withColumn(names["digest"], F.unhex(F.md5(F.col(text_col).cast("string").cast("binary"))))
    keys = list(names.values())
    left = marked.join(broadcast_if_small(told.select(*keys)), keys, "left_anti").select(*docs.columns)
    again = told.filter("stays").select(*keys)
    if again.isEmpty():
        return left
    whole = F.struct(*docs.columns)
    one = marked.join(broadcast_if_small(again), keys, "left_semi").groupBy(*keys).agg(F.max_by(whole, F.to_json(whole)).alias("row"))
    return left.unionByName(one.select("row.*"))


def _components(links: DataFrame) -> DataFrame:
    found = connected_components(links, "a", "b")
    return found.select("node", F.col("component_id").alias("comp"))
