"""The pipeline's stages and the registered queries over the smallest tables, against plain Python."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from nestfold.llm import quality
from nestfold.llm.queries import KEEP_SCORE, ORACLE, QUERIES, held_out
from tests.llm.test_data_products import water_level
from tests.llm.test_near_dup import by_all_pairs, shingles
from tests.llm.test_text_scans import base_spans, counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return read(spark, "documents").toPandas()


@pytest.fixture(scope="module")
def got(spark):
    return lambda name: QUERIES[name](spark, SF).collect()


def by_hash(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_near_duplicates(docs, got):
    rows = list(zip(docs.doc_id.tolist(), docs.text, strict=True))
    want = by_all_pairs(rows, 2)
    out = got("op1_minhash_near_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == {i: (len(shingles(t, 2)), want[i], want[i] == i) for i, t in rows}


def test_personal_data(docs, got):
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in got("op2_personal_data"):
        spans = base_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(s) for s in spans.values())
        assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_equal_sql(got, name):
    con = duckdb.connect()
    for table in ("pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in got(name))


def test_token_counts(docs, got):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for i, t in zip(docs.doc_id.tolist(), docs.text, strict=True)]
    assert sorted(map(tuple, got("op11_whole_token_counts"))) == sorted(want)


def test_mixture(docs, got):
    out = got("op4_source_mixing")
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    sizes, taken, longest = Counter(), Counter(), Counter()
    source = dict(zip(docs.doc_id, docs.source, strict=True))
    for r in out:
        assert r.size == len(texts[r.doc_id].encode().split()) and r.taken <= 3 * r.size
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    weights = {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(sizes))}
    want = water_level(sizes, weights, sum(sizes.values()), 3)
    for r in out:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)


def test_classifier(spark, docs, got):
    out = got("op5_quality_classifier")
    assert sorted(r.doc_id for r in out) == sorted(docs.doc_id)
    labels = {r.doc_id: r.quality for r in read(spark, "labels").collect()}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == by_hash(r.doc_id)
    judged = [r.predicted == labels[r.doc_id] for r in out if r.held_out and r.doc_id in labels]
    assert sum(judged) >= 0.8 * len(judged)


def test_shards(docs, got):
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    out = got("op6_karmarkar_karp_sharding")
    sums = Counter()
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sums[r.shard] += r.size
    assert len(out) == len(docs) and max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values()) / 16


def test_licenses(docs, got):
    named = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-short", "Released under the MIT License.": "mit-short", "All rights reserved.": "all-rights-reserved", "Licensed under the Apache License, Version 2.0.": "apache-2.0-short", "License, version 3.": "gpl-3.0-short"}
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    out = got("op7_license_scan")
    assert len(out) == len(docs)
    for r in out:
        assert set(r.licenses) == {name for line, name in named.items() if line in texts[r.doc_id]}


def test_rules(docs, got):
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    for r in got("op8_adaptive_quality_rules"):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def tokens_of(rows):
    """``(doc_id, start, n_tokens, crc)`` of (id, text) in ascending order."""
    tokenizer, start, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i, text in sorted(rows):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(docs, got):
    assert sorted(map(tuple, got("op9_simple8b_tokens"))) == tokens_of(zip(docs.doc_id.tolist(), docs.text, strict=True))


def holding(docs, spark):
    """The documents that hold all words of a benchmark item in a row."""
    items = [" ".join(r.text.lower().split()) for r in read(spark, "benchmark").collect()]
    return {i for i, t in zip(docs.doc_id, docs.text, strict=True) if any(f" {x} " in f" {' '.join(t.lower().split())} " for x in items)}


def test_decontamination(spark, docs, got):
    out = got("op10_benchmark_decontamination")
    assert {r.doc_id for r in out if not r.kept} == holding(docs, spark) != set()
    assert all(r.kept == (len(r.item_ids) == 0) for r in out) and len(out) == len(docs)


def test_stages_one_by_one(spark, docs):
    """Each stage's decisions on its own input, extra columns with clashing names carried along."""
    extra = {"score": F.lit("s"), "hits": F.lit(1), "mix": F.lit("m"), "key": F.lit(2), "_score": F.lit(3)}
    now, columns = read(spark, "documents").withColumns(extra), [*docs.columns, *extra]
    stages = [f for _, f in corpus_pipeline.STAGES]
    texts = dict(zip(docs.doc_id, docs.text, strict=True))

    def step(k, rows):
        out = stages[k](spark, rows, SF)
        assert out.columns == columns
        assert {(r["score"], r["hits"], r["mix"], r["key"], r["_score"]) for r in out.collect()} <= {("s", 1, "m", 2, 3)}
        return out.cache()

    first = step(0, now)
    weights = quality.train(read(spark, "documents"), read(spark, "labels").filter(~held_out()), "quality")
    scores = {r.doc_id: r.score for r in quality.score(read(spark, "documents"), weights).collect()}
    ids = sorted(r.doc_id for r in first.collect())
    assert ids == sorted(i for i in texts if scores[i] >= KEEP_SCORE) and len(ids) < len(texts)

    second = step(1, first)
    comps = by_all_pairs([(i, texts[i]) for i in ids], 5)
    ids = sorted(r.doc_id for r in second.collect())
    assert ids == sorted(set(comps.values())) and len(ids) < len(comps)

    third = step(2, second)
    gone = holding(docs, spark)
    assert sorted(r.doc_id for r in third.collect()) == [i for i in ids if i not in gone] != ids

    fourth = step(3, third)
    ids = [i for i in ids if i not in gone]
    copies = Counter(r.doc_id for r in fourth.collect())
    assert set(copies) <= set(ids) and max(copies.values()) <= 3
    sizes, taken, longest, source = Counter(), Counter(), Counter(), dict(zip(docs.doc_id, docs.source, strict=True))
    for i in ids:
        n = len(texts[i].split())
        sizes[source[i]] += n
        taken[source[i]] += n * copies[i]
        longest[source[i]] = max(longest[source[i]], n)
    want = water_level(sizes, {s: [5, 2, 1][k % 3] for k, s in enumerate(sorted(sizes))}, sum(sizes.values()), 3)
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)

    last = stages[4](spark, fourth, SF)
    want = tokens_of((i, texts[i]) for i, n in copies.items() for _ in range(n))
    assert sorted(map(tuple, last.collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_near_dedup_of_repeated_ids_and_rows(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, c)]
    now = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], read(spark, "documents").schema)
    left = corpus_pipeline.near_dedup(spark, now, SF).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in left) == [(1, a, "s0"), (5, b, "s2"), (9, c, "s5")]


def test_stages_on_an_empty_table(spark):
    now = read(spark, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.collect() == [] and now.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_nulls(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (2, "", None, "s", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)]
    now, left = spark.createDataFrame(rows, read(spark, "documents").schema), defaultdict(list)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        left[name] = now.collect()
    assert all(r.n_tokens >= 1 for r in left["token-ID / binary output"])
