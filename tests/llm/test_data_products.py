"""Archives, mixtures, shards, token files and the classifier: round trips and stated laws."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nestfold.llm import mixing, quality, sharding, simple8b, tokens, warc
from nestfold.llm.order import running_sum
from nestfold.session import work_folder

# Archives.

INNER = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50
PAGES = [
    (5, "http://a\r\nX: y", INNER), (3, None, INNER), (3, None, INNER), (None, "u", INNER), (7, "u", None), (8, "u", ""), (9, "u", "x" * 99), (10, "u", "x" * 99),
    (11, "u", "é" * 50), (12, "u", "é" * 50), (13, "u", "\n" * 200), (14, "u", "a\rb\r\n\r\n" * 40 + "\r\n"), (15, "u", "a\rb\r\n\r\n" * 40 + "\r\n"), (16, "u", "ü" * 300_000),
]


def archived(spark, rows, **options):
    folder = work_folder(spark, "warc")
    warc.write_archives(spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, nth int, digest string"), folder, **options)
    return warc.read_archives(spark, folder)


@pytest.mark.parametrize("most", [100_000, 1])
def test_archives_come_back_whole(spark, most):
    records = archived(spark, PAGES, most=most)
    got = sorted(map(tuple, warc.resolve_revisits(spark, records).collect()), key=str)
    first = {"é" * 50: 11, PAGES[-2][2]: 14, INNER: 3}
    want, seen = [], False
    for i, _, html in PAGES:
        raw = (html or "").encode()
        original = first.get(html, i)
        again = original != i or (i == 3 and seen)  # of two equal pages one is the response
        seen |= i == 3
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", original if again else None))
    assert got == sorted(want, key=str)
    payloads = {r.page_id: r for r in records.filter("record_type = 'response'").collect()}
    assert bytes(payloads[16].payload).decode() == "ü" * 300_000 and bytes(payloads[14].payload).decode() == PAGES[-2][2]
    assert payloads[9].header_digest == "sha256:" + hashlib.sha256(b"x" * 99).hexdigest()
    assert {r.url for r in records.filter("page_id = 5").collect()} == {"http://a%20%20X:%20y"}
    assert records.select("record_id").distinct().count() == len(PAGES)


def test_groups_of_parts():
    assert warc.part_groups({}, 5) == [(0, 2**31 - 1)]
    assert warc.part_groups({0: 3, 4: 2, 5: 1, 9: 20, 10: 1}, 5) == [(0, 4), (5, 8), (9, 9), (10, 2**31 - 1)]


def test_no_payload_is_shuffled(spark, monkeypatch):
    """With automatic broadcasting switched off: no exchange of any plan holds payloads."""
    kind = type(spark.range(1))
    plans, write = [], kind.write
    monkeypatch.setattr(kind, "write", property(lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write.fget(df)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(k, f"u{k}", ("same " * 40) if k % 3 else f"own {k} " * 30) for k in range(60)]
        records = archived(spark, rows, most=7)
        assert records.filter("record_type = 'revisit'").count() == 39 and records.count() == 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) >= 4
    for plan in plans:
        for at, line in enumerate(plan.splitlines()):
            if "Exchange" in line and "BroadcastExchange" not in line:
                assert "payload" not in "".join(plan.splitlines()[at : at + 2]), plan


def test_no_pages_no_records(spark):
    assert warc.resolve_revisits(spark, archived(spark, [])).collect() == []


# Running sums.


def test_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(100), rng.randrange(9)) for _ in range(2000)] + [(None, 4)]
    got = running_sum(spark.createDataFrame(rows, "k int, n long"), [F.col("k"), F.col("n")], "n", "before").collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.before, r.n)):
        assert r.before == total
        total += r.n
    assert total == sum(n for _, n in rows)
    assert [r.k is None for r in sorted(got, key=lambda r: r.before)][0]


# Mixing.


def water_level(sizes, weights, total, epochs):
    full = set()
    while True:
        free = [s for s in sizes if s not in full]
        left = total - sum(epochs * sizes[s] for s in full)
        over = {s for s in free if left * weights[s] / sum(weights[x] for x in free) > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in full else left * weights[s] / sum(weights[x] for x in free) for s in sizes}
        full |= over


def mixed(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, source string, size int, weight string")
    return mixing.take(df, mixing.plan_mix(df, **kw)).collect()


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = []
    for k, (source, n) in enumerate([("a", 5), ("b", 300), ("c", 40), ("Z", 200), ("é", 10), (None, 30)]):
        rows += [(1000 * k + j, " ".join("w" for _ in range(rng.randint(1, 60))), source) for j in range(n)]
    rows += [(9001, None, "a"), (9002, " \n", "b"), (None, "no id here", "c"), (9003, "twice", "b"), (9003, "twice", "b")]
    out = mixed(spark, rows)
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "source", "size", "weight", "mix"}
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in out:
        assert r.mix.size == len((r.text or "").split())
        assert 0 <= r.mix.times <= 3
        sizes[r.source] += r.mix.size
        taken[r.source] += r.mix.times * r.mix.size
        longest[r.source] = max(longest[r.source], r.mix.size)
    order = ["Z", "a", "b", "c", "é", None]
    want = water_level(sizes, dict(zip(order, [5, 2, 1] * 2, strict=True)), sum(sizes.values()), 3)
    for r in out:
        assert r.mix.source_size == sizes[r.source] and math.isclose(r.mix.target, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]
    assert sorted(map(str, out)) == sorted(map(str, mixed(spark, rows)))
    assert sorted(map(str, out)) != sorted(map(str, mixed(spark, rows, seed=18)))


def test_targets_that_end_among_equal_rows(spark):
    """Of equal rows as many are taken as the target asks for."""
    rows = [(1, "w " * 10, "a")] * 100 + [(2, "v " * 7, "b")] * 90 + [(k, "u " * 3, "c") for k in range(10, 400)] + [(3, "t " * 5, None)] * 40
    out = mixed(spark, rows)
    assert len(out) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.mix.size
        taken[r.source] += r.mix.times * r.mix.size
        assert r.mix.times <= 3
    want = water_level(sizes, {"a": 5, "b": 2, "c": 1, None: 5}, sum(sizes.values()), 3)
    longest = {"a": 10, "b": 7, "c": 3, None: 5}
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in sizes), (taken, want)
    counts = lambda rows: Counter(map(str, rows))
    assert counts(out) == counts(mixed(spark, rows))


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixed(spark, []) == []
    assert [r.mix.times * r.mix.size for r in mixed(spark, [(1, None, "a"), (2, "", None)])] == [0, 0]
    assert [(r.mix.times, r.mix.target) for r in mixed(spark, [(1, "one two", "a")])] == [(1, 2.0)]


# The classifier's weights.


def test_weights_equal_plain_updates(spark):
    """Follow-the-regularised-leader, one weight at a time in dictionaries."""
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choices(["Dobar", "los", "tekst", "123", "!!!", "kratak", "uvod"], k=rng.randrange(0, 30)))) for k in range(60)]
    labels = [(k, rng.randrange(2)) for k in range(0, 70)] + [(3, None), (None, 1)]
    found = quality.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), max_rows=50)
    order = spark.createDataFrame(labels, "doc_id long, quality int").dropna().withColumn("h", F.xxhash64("doc_id")).orderBy("h").limit(50).collect()
    texts, alpha, beta, l1, l2 = dict(docs), 1.0, 1.0, 0.02, 0.05
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else (math.copysign(l1, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)
    for _ in range(2):
        for r in order:
            if r.doc_id not in texts:
                continue
            slots, each = quality.grams(texts[r.doc_id])
            x = {k: c * each for k, c in Counter(slots.tolist()).items()} | {1 << quality.BITS: 1.0}
            w = {k: weight(k) for k in x}
            miss = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()))) - r.quality
            for k, v in x.items():
                g = miss * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    want = np.zeros((1 << quality.BITS) + 1)
    for k in z:
        want[k] = weight(k)
    assert np.abs(want).max() > 0.1 and np.allclose(found, want, atol=1e-4)


# Shards.


def test_differencing_is_tight_and_whole():
    rng = random.Random(1)
    assert sharding.difference([], 4) == []
    for n, shards in ((1, 4), (3, 4), (7, 2), (500, 16)):
        sizes = [rng.randint(1, 10**6) for _ in range(n)]
        sums = [0] * shards
        for size, shard in zip(sizes, sharding.difference(sizes, shards), strict=True):
            sums[shard] += size
        assert sum(sums) == sum(sizes)
        if n == 500:
            assert max(sums) - min(sums) < 1000
    found = sharding.difference([8, 7, 6, 5, 4], 2)
    assert abs(sum(s * (1 - 2 * k) for s, k in zip([8, 7, 6, 5, 4], found, strict=True))) == 2  # the classic example's difference


def differenced(sizes, shards):
    """Plain differencing over whole tuples: sums of the shards, largest spread first, the earlier of equal ones."""
    heap = [([s] + [0] * (shards - 1), k) for k, s in enumerate(sizes)]
    while len(heap) > 1:
        heap.sort(key=lambda h: (h[0][-1] - h[0][0], h[1]))
        (a, _), (b, nth) = heap.pop(0), heap.pop(0)
        heap.append((sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True), nth))
    return heap[0][0]


@pytest.mark.parametrize("shards", [2, 3, 7, 16])
def test_differencing_equals_plain_tuples(shards):
    rng = random.Random(shards)
    for n in (1, 2, 5, 30, 120):
        sizes = [rng.choice([rng.randint(1, 1000), rng.randint(1, 10)]) for _ in range(n)]
        sums = [0] * shards
        for size, shard in zip(sizes, sharding.difference(sizes, shards), strict=True):
            sums[shard] += size
        assert sorted(sums, reverse=True) == differenced(sizes, shards)


@pytest.mark.parametrize("resolution", [1 << 14, 64])
def test_shards_keep_groups_and_balance_bytes(spark, resolution):
    rng = random.Random(2)
    texts = ["x" * rng.randint(0, 400) + str(k % 700) for k in range(1500)] + ["copy of one text " * 20] * 60 + [None, "", "é" * 50]
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)] + [(None, "é" * 50, 1, 2), (3, texts[3], 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, key int")
    out = sharding.shard_by_bytes(df, resolution=resolution).collect()
    assert len(out) == len(rows)
    by_id = dict(enumerate(texts))
    sums, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        sums[r.shard] += r.size
        slots[r.shard].append((r.slot, -1 if r.doc_id is None else r.doc_id))
        if r.doc_id is not None:
            raw = (by_id[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
            groups[raw].add(r.shard)
    assert set(sums) <= set(range(16)) and all(len(s) == 1 for s in groups.values())
    largest = max(Counter((t or "") for t in texts).items(), key=lambda p: p[1] * len(p[0]))
    mean = (sum(sums.values()) - 60 * (len(largest[0]) + 1)) / 15
    ordered = sorted(sums.values())
    assert ordered[-2] - ordered[0] <= mean * 0.05 if resolution > 64 else ordered[-2] <= 2 * mean
    for found in slots.values():
        assert [s for s, _ in sorted(found)] == list(range(len(found)))
        assert [d for _, d in sorted(found)] == sorted(d for _, d in found)
    assert sharding.shard_by_bytes(df.limit(0)).collect() == []


# Token files.


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(200):
        n = int(rng.integers(0, 400))
        values = rng.integers(0, 3, n).astype(np.uint64) if trial % 2 else np.array([int(rng.integers(0, 2**63)) >> int(rng.integers(0, 63)) for _ in range(n)], np.uint64)
        if trial % 5 == 0 and n:
            values[rng.integers(0, n)] = 2**64 - 1  # needs an escape
        counts = np.diff([0, *sorted(rng.integers(0, n + 1, 3).tolist()), n])
        words, first, escapes = simple8b.encode(values, counts)
        ids, back, begins, held, odd = simple8b.unpack(simple8b.pack(np.arange(4), counts, words, first, escapes))
        assert (simple8b.decode(held, odd) == values).all() and (back == counts).all() and (ids == np.arange(4)).all()
        if not len(odd):  # a document decodes alone from its first word on
            for k in np.flatnonzero(counts):
                assert (simple8b.decode(held[begins[k] :], odd)[: counts[k]] == values[counts[:k].sum() : counts[: k + 1].sum()]).all()


ODD = [
    None, "", "   ", "́abc é Å", "It's WE'RE don't. x's", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "\x01 a\x01b \x01", "ΑΣ Σ ΟΔΟΣ", "İstanbul ﬁ ǅ",
    "a b c \u0085 d", "１２3 ４½", "日本語 テキスト。", "😀😀 !?!? ...", "Straße. ÄÖÜ, ẞ", "x\x1cy\x1fz", "K ª º µ.", "can't.  won't," * 3, "., .. ,", "word " * 40_000,
]


@pytest.mark.parametrize("kept", [tokens.WORDS_KEPT, 5])
def test_token_files_equal_the_tokenizer(spark, monkeypatch, kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(tokens, "WORDS_KEPT", kept)
    words = tokens.WordIds(tokenizer, 1)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in ODD]
    for _ in range(2):
        ids, counts = words.of(pa.array(ODD, pa.string()))
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    rows = [(100 - k, t, "b", "i") for k, t in enumerate(ODD)] + [(None, "no id", "b", "i"), (100, "again", "b", "i"), (100, "again", "b", "i"), (-5, "minus", "b", "i")]
    folder = work_folder(spark, "tokens")
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, block string, ids string"), folder)
    out = sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, *sorted(i for i, *_ in rows if i is not None)]
    texts, start = defaultdict(list), 0
    for i, t, *_ in rows:
        texts[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])
    for r in out:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids)
        texts[r.doc_id].remove(ids)
        start += len(ids)
    assert not any(texts.values())


def test_capitals_are_joined_with_marks_before_they_are_made_small():
    """J and a caron, H and a line below and so on are one letter only when small."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"Plain Words. {c}{m}ola, SO{c}{m}. {c.lower()}{m}ola E\u0301 {c}." for c in "HJTWYA" for m in ("\u0331", "\u030c", "\u0308", "\u030a", "\u0344", "\u0323\u0308", "\u0301")]
    ids, counts = tokens.WordIds(tokenizer, 1).of(pa.array([*texts, None, "no mark J"], pa.string()))
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in [*texts, "", "no mark J"]]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_token_files_of_nothing(spark):
    folder = work_folder(spark, "tokens")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert tokens.read_tokens(spark, folder).collect() == []


# Classifier.


def labelled(spark, n, start=0):
    rng = random.Random(start)
    rows = []
    for k in range(n):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(10, 60))]
        bad = k % 4 == 0
        if bad and k % 8:
            words = [w.upper() + "!!" for w in words]
        elif bad:
            words = [w for w in words for _ in range(6)]
        rows.append((start + k, " ".join(words), int(not bad), "s"))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, SCORE string")


def test_classifier_on_unseen_texts(spark):
    train, test = labelled(spark, 600), labelled(spark, 300, 10_000)
    weights = quality.train(train.drop("quality"), train.select("doc_id", "quality"), max_rows=500)
    assert (weights == quality.train(train.drop("quality"), train.select("doc_id", "quality"), max_rows=500)).all()
    out = quality.score(test, weights).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "quality", "score"} and len(out) == 300
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in out) >= 295
    for r in out[:20]:  # a score is a dot product with the grams
        at, each = quality.grams(r.text)
        assert math.isclose(r.score, 1 / (1 + math.exp(-(weights[-1] + each * weights[at].astype(float).sum()))), rel_tol=1e-6)


def test_classifier_without_labels_and_on_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x " * 50_000), (1, None)], "doc_id long, text string")
    none = quality.train(docs, spark.createDataFrame([(None, 1), (1, None), (77, 0)], "doc_id long, quality int"))
    assert not none.any()
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 4
    assert quality.score(docs.limit(0), none).collect() == []
