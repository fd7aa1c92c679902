"""Personal data, licenses, benchmark passages and quality rules against plain Python."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.llm import decontam, licenses, pii, rules
from nestfold.llm.words import hashes_of, windows_of
from nestfold.session import BROADCAST_ROWS, broadcast_if_small

CLASHING = "doc_id long, text string, lang string, source string, PII string, hits int, licenses string, n_words string, fences int, kept string"


def frame(spark, rows, langs=None):
    return spark.createDataFrame([(i, t, *(langs or {}).get(i, ("en", "s")), "x", 1, "l", "n", 2, "k") for i, t in rows], CLASHING)


# Personal data.

ODD = [
    None, "", "a@b.c_x@d.e a@b..c x@y", "1.2.3.4.5 1.2.3.45.6.7.8 256.1.1.1 0001.002.3.4", "4111 1111 1111 1111 4111-1111-1111-11114",
    "+1 (234) 567-8901+44 20 7946 0958 +12345678", "😀 x@y.zz 😀😀 4111111111111111", "1 " * 20_000, "a." * 20_000 + "@", "a@" + "b." * 20_000 + "c",
    "x@y.z " * 2_000, "@@@@a@b.c@d.e", "1..2.3.4.5", "+1" + " (" * 4_000 + "2", "٤ 1.2.3.4",
]


def luhn(number):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(number))) % 10 == 0


def base_spans(text):
    text, digits = text or "", lambda m: re.sub("[^0-9]", "", m.group())
    all_of = lambda pattern, ok: [(m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return {
        "email": all_of(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": all_of(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        "card": all_of(r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": all_of(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }


def test_personal_data_equals_plain_search(spark):
    rng = random.Random(2)
    pieces = ["4111111111111111", "a.b@c.de", "@", "+1 222 333 4444", ".", "10.0.0.1", " ", "-", "9", "x", "é", "+", "("]
    rows = list(enumerate(ODD + ["".join(rng.choices(pieces, k=30)) for _ in range(300)]))
    out = pii.find_personal_data(frame(spark, rows))
    assert len(out.columns) == 10
    found = out.select("doc_id", pii.written(F.filter("pii", lambda s: s["kind"].isin("email", "ip", "card", "phone"))).alias("s")).collect()
    for r in found:
        want = base_spans(rows[r.doc_id][1])
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, spans in want.items() for a, b in spans), rows[r.doc_id][1][:80]


def test_check_digits_and_words_nearby(spark):
    rows = [(1, "iban GB82 WEST 1234 5698 7654 32, and DE89370400440532013000."), (2, "GB83WEST12345698765432"), (3, "my card 3782 822463 10005"), (4, "no 3782 822463 10005"), (5, "mail me: a@b.cd"), (6, "for example a@b.cd")]
    got = {r.doc_id: [(s.kind, s.text, s.score) for s in r.pii] for r in pii.find_personal_data(frame(spark, rows)).collect()}
    assert got[1] == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0), ("iban", "DE89370400440532013000", 0.8)]
    assert got[2] == [] and got[4] == [] and got[3] == [("amex", "3782 822463 10005", 0.6)]
    assert got[5][0][2] == 1.0 and got[6][0][2] == 0.6
    assert pii.find_personal_data(frame(spark, [])).collect() == []


# Quality rules.


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup, at, covered = set(), 0, defaultdict(list), set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    for places in at.values():
        if len(places) > 1:
            covered.update(p + j for p in places for j in range(5))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_counts_equal_plain_counting(spark):
    rng = random.Random(4)
    odd = [None, "", "  ", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 20_000, "a\n\na\n \n \na", "😀 é #|<", "a b c d e f a b c d e f g h a b c d e", "a\x0bb\x1cc d"]
    rows = list(enumerate(odd + [" ".join(rng.choices(["a", "b", "#c", "\n", "dé"], k=40)) for _ in range(200)]))
    judged = rules.judge(rules.count_signals(frame(spark, rows, {1: (None, None)}))).collect()
    assert len(judged) == len(rows)
    for r in judged:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(rows[r.id][1])
        assert not (r.base_failed and r.kept)


def test_fences_follow_the_group(spark):
    """Symbols are usual in one source and odd in the other; a small group takes its language's fences."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(3, 8)))
    plain = lambda: " ".join(word() for _ in range(60))
    marked = lambda: " ".join(word() + "$$$" * (k % 2) for k in range(60))
    rows, groups = [], {}
    for k in range(400):
        rows.append((k, plain() if k < 200 else marked()))
        groups[k] = ("en", "prose" if k < 200 else "prices")
    rows += [(400, marked()), (401, marked()), (402, plain())]
    groups |= {400: ("en", "prose"), 401: ("de", "small"), 402: (None, None)}
    kept = {r.id: (r.kept, r.failed) for r in rules.judge(rules.count_signals(frame(spark, rows, groups))).collect()}
    assert all(kept[k][0] for k in range(400))
    assert kept[400] == (False, ["symbol_share"])
    assert kept[402][0]
    assert rules.judge(rules.count_signals(frame(spark, []))).collect() == []


def test_each_ratio_rejects_outliers_that_pass_the_base_rules(spark):
    """One text in 150 is odd in one ratio, by less than any fixed distance would tell."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    lines = lambda n=10: [" ".join(word(rng.randint(5, 6)) for _ in range(12)) for _ in range(n)]
    rows = ["\n".join(lines()) for _ in range(600)]
    short = "ok so\nok so\n"  # a line twice, too short for a window of five words
    twice = lines()[0].split()[:6]
    odd = {
        "word_length": ["\n".join(" ".join(word(7) for _ in range(12)) for _ in range(10)), "\n".join(" ".join(word(4) for _ in range(12)) for _ in range(10))],
        "symbol_share": [rows[0].replace(" ", "# ", 20)],
        "dup_line_share": [short + rows[1]],
        "repeat_share": [" ".join(twice) + " zz " + rows[2].replace("\n", " ") + " " + " ".join(twice)],
    }
    want = {len(rows) + k: [name] for k, (name, _) in enumerate((n, t) for n, texts in odd.items() for t in texts)}
    rows += [t for texts in odd.values() for t in texts]
    got = rules.judge(rules.count_signals(frame(spark, list(enumerate(rows))))).collect()
    assert {r.id: r.failed for r in got if r.failed} == want and not any(r.base_failed for r in got)
    assert {r.id for r in got if not r.kept} == set(want)


def test_fences_of_small_groups_move_with_their_rows(spark):
    """Words of 4 letters in the small group, of 6 in its language: fences move a little with each row, without a jump."""
    ddl = "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    tops = {}
    for n in (1, 25, 50, 99, 100, 150):
        rows = [("en", "big", 100, 600, 0, 5, 0, 0)] * 10_000 + [("en", "small", 100, 400, 0, 5, 0, 0)] * n
        drawn = {r.source: r.fences for r in rules.thresholds(spark.createDataFrame(rows, ddl)).collect()}
        assert (drawn["big"].word_length.lo, drawn["big"].word_length.hi) == (6.0, 6.0)
        tops[n] = drawn["small"].word_length.hi
    assert tops == pytest.approx({1: 5.98, 25: 5.5, 50: 5.0, 99: 4.02, 100: 4.0, 150: 4.0}, abs=0.011)


def fences_by_hand(rows, least_rows=100):
    """Nearest-rank quantiles of sorted values, blended; within what a bucket of the sketch may be off."""
    values = defaultdict(lambda: defaultdict(list))
    for lang, source, n, chars, symbols, lines, dup, rep in rows:
        ratios = {"word_length": (chars - symbols) / n, "symbol_share": symbols / chars, "dup_line_share": dup / max(lines, 1), "repeat_share": rep / n}
        for key in ((lang, source), (lang,), ()):
            for name, v in ratios.items():
                values[key][name].append(v)
    out = {}
    for key in [k for k in values if len(k) == 2]:
        for name, (_, times, tail, low) in rules.RATIOS.items():
            def of(k, q):
                held = sorted(values[k][name])
                return held[max(1, math.ceil(q * len(held))) - 1]
            w = [min(len(values[k][name]) / least_rows, 1.0) for k in (key, key[:1])]
            first, q1, q3, last = (w[0] * of(key, q) + (1 - w[0]) * (w[1] * of(key[:1], q) + (1 - w[1]) * of((), q)) for q in (1 - tail, 0.25, 0.75, tail))
            out[key, name] = (min(q1 - (q3 - q1) * times, first) if low else None, max(q3 + (q3 - q1) * times, last))
    return out


def test_fences_equal_sorted_values(spark):
    rng = random.Random(12)
    rows = []
    for lang, source, n in (("en", "a", 3000), ("en", "b", 40), ("de", "a", 70), (None, None, 130), ("de", None, 5)):
        for _ in range(n):
            words = rng.randint(10, 400)
            rows.append((lang, source, words, words * 5 + rng.randrange(200), rng.choice([0, 0, 0, rng.randrange(9)]), rng.randint(1, 30), rng.choice([0, 0, 1]), rng.choice([0, 0, 0, rng.randrange(words // 5 + 1)])))
    ddl = "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    drawn = {((r.lang, r.source), name): r.fences[name] for r in rules.thresholds(spark.createDataFrame(rows, ddl).repartition(7)).collect() for name in rules.RATIOS}
    want = fences_by_hand(rows)
    assert drawn.keys() == want.keys()
    for at, (lo, hi) in want.items():
        spread = 8 * (rules.GAMMA - 1) * max(abs(hi), abs(lo or 0))
        assert abs(drawn[at].hi - hi) <= 0.01 + spread, (at, hi, drawn[at])
        assert (lo is None) == (drawn[at].lo is None) and (lo is None or abs(drawn[at].lo - lo) <= 0.01 + spread)


def test_reruns_over_one_large_group_agree(spark):
    """Rows in another order, dealt in another way: the same fences and verdicts in every row."""
    n, of = 150_000, lambda k, m: F.xxhash64("id", F.lit(k)) % m
    words = 10 + F.abs(of(1, 300))
    counted = spark.range(n).select(
        "id", F.lit("en").alias("lang"), F.lit("s").alias("source"), words.alias("n_words"), (words * 5 + F.abs(of(2, 900))).alias("word_chars"), F.greatest(F.lit(0), of(3, 20)).alias("n_symbols"),
        F.lit(9).cast("long").alias("n_lines"), F.greatest(F.lit(0), of(4, 4)).alias("n_dup_lines"), F.greatest(F.lit(0), of(5, 5)).alias("n_repeat_words"),
    )
    runs = [rules.judge(df).select("id", "kept", F.concat_ws(",", "failed").alias("failed")) for df in (counted, counted.orderBy(F.rand(1)).repartition(13), counted.repartition(3, "n_words"))]
    assert runs[0].filter("not kept").count() > 100
    for other in runs[1:]:
        assert other.exceptAll(runs[0]).isEmpty() and runs[0].exceptAll(other).isEmpty()


# Licenses.


def test_licenses_equal_containment_at_every_place(spark):
    """What stands there by brute force is named, or lies under a template that explains more of the stretch."""
    scanner, rng = licenses.Scanner(licenses.TEMPLATES, 0.8), random.Random(3)
    texts = [None, "", "licensed under", licenses.TEMPLATES["apache-2.0"].upper(), "\n".join(licenses.TEMPLATES.values()), "x " * 50_000 + licenses.TEMPLATES["mit"]]
    planted = {3: "apache-2.0", 5: "mit"}
    for _ in range(120):
        name, rate = rng.choice(sorted(licenses.TEMPLATES)), rng.choice([0, 0.02, 0.05])
        words = [w if rng.random() > rate else "zz" for w in licenses.TEMPLATES[name].split()]
        if not rate:
            planted[len(texts)] = name
        texts.append(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(40))) + " " + " ".join(words) + " tail and more")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    for d, text in enumerate(texts):
        h, want = hashes_of(licenses.license_words(text)), {}
        own = windows_of(h, 5).tolist()
        for k, name in enumerate(scanner.names):
            w, shingles = scanner.words[k], set(scanner.shingles[k].tolist())
            if len(w) < 5:
                want |= {name: (p, p + len(w)) for p in range(len(h) - len(w) + 1) if (h[p : p + len(w)] == w).all()}
                continue
            room = len(w) // 5
            places = [p for p, s in enumerate(own) if s in shingles]
            for p in places[:: max(1, len(places) // 40)]:
                for o in range(0, len(w) - 4, 1 + len(w) // 60):
                    a, b = max(0, p - o - room), max(0, p - o + len(w) + room - 4)
                    at = [k for k in range(a, min(b, len(own))) if own[k] in shingles]
                    if at and len({own[k] for k in at}) / len(shingles) >= 0.8:
                        want[name] = (at[0], at[-1] + 5)
        names = {x.license for x in got[d]}
        assert names <= set(want), text[:200]
        for name in set(want) - names:
            a, b = want[name]
            assert any(x.start < b and x.start + x.words > a for x in got[d]), (name, text[:200])
        spans = sorted((x.start, x.start + x.words) for x in got[d])
        assert all(2 * (b - c) <= min(b - a, e - c) for (a, b), (c, e) in zip(spans, spans[1:], strict=False))
        if d in planted:
            assert names == {planted[d]}, text[:200]
    assert licenses.scan_licenses(frame(spark, [])).collect() == []


def test_notices_have_one_name_each(spark):
    """Families of licenses that share most of their words."""
    copies = {n: f"Copyright 2020 Someone\n\n{t}\n\nint main()" for n, t in licenses.TEMPLATES.items()}
    commented = {n: "\n".join(f" * {line}" for line in re.findall(r".{1,60}(?:\s|$)", t)) for n, t in copies.items()}
    rows = [*copies.items(), *commented.items()]
    got = {r.doc_id: [x.license for x in r.licenses] for r in licenses.scan_licenses(frame(spark, [(k, t) for k, (_, t) in enumerate(rows)])).collect()}
    assert {k: got[k] for k in got} == {k: [n] for k, (n, _) in enumerate(rows)}


# Benchmark passages.


@pytest.mark.parametrize("most", [BROADCAST_ROWS, 0])
def test_passages_are_found_with_words_substituted(spark, monkeypatch, most):
    """With the sides of the joins broadcast, and shuffled."""
    monkeypatch.setattr(decontam, "broadcast_if_small", lambda df: broadcast_if_small(df, most))
    rng = random.Random(8)
    word = lambda: "v" + str(rng.randrange(10**5))
    items = [(k, " ".join(word() for _ in range(rng.choice([15, 30, 60])))) for k in range(12)] + [(50, "only three words"), (51, None), (52, "")]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for k, text in items[:12]:
        words = text.split()
        for every in (0, 6, 9):
            changed = [("zz" if every and j % every == every - 1 else w).upper() for j, w in enumerate(words)]
            want[len(rows)] = {k}
            rows.append(f"{filler(40)} {' '.join(changed)}\n{filler(30)}")
        want[len(rows)] = set()
        rows.append(f"{filler(20)} {' '.join(words[3:9])} {filler(20)}")  # six words in a row are no passage
    want |= {len(rows): set(), len(rows) + 1: set(), len(rows) + 2: {50}, len(rows) + 3: {0, 1}}
    rows += [None, "", "here: only three words", items[0][1] + " " + items[1][1]]
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find_contamination(frame(spark, list(enumerate(rows))), tests)
    got = {r.doc_id: r.hits for r in out.collect()}
    assert {d: {h.item_id for h in hits} for d, hits in got.items()} == want
    whole = got[0][0]
    assert (whole.start, whole.words, whole.agreeing) == (40, len(items[0][1].split()), len(items[0][1].split()))
    none = decontam.find_contamination(frame(spark, [(1, "a")]), tests.limit(0)).collect()
    assert none[0].hits == [] and decontam.find_contamination(frame(spark, []), tests).collect() == []


def by_all_diagonals(text, passage, percent=80, least=8):
    """The longest stretch of words laid over each other in any way, then the most agreeing, then the first."""
    h, w, best = text.lower().split(), passage.lower().split(), None
    for start in range(1 - len(w), len(h)):
        a, b = max(0, start), min(len(h), start + len(w))
        agree = [h[k] == w[k - start] for k in range(a, b)]
        for lo in range(len(agree)):
            good = 0
            for hi in range(lo + 1, len(agree) + 1):
                good += agree[hi - 1]
                if hi - lo >= min(least, len(w)) and 100 * good >= percent * (hi - lo):
                    best = max(best or (0,), (hi - lo, good, -(a + lo)))
    return best and (-best[2], best[0], best[1])


def test_altered_passages_equal_brute_force(spark):
    """8 to 60 words, a tenth to a fifth of them changed anywhere: the overlap of brute force, and all are found."""
    rng = random.Random(17)
    word = lambda: "q" + str(rng.randrange(10**6))
    items, rows, made = [], [], []
    for n, changed in ((8, 1), (10, 1), (10, 2), (12, 2), (15, 2), (15, 3), (20, 3), (20, 4), (30, 6), (60, 12)):
        words = [word() for _ in range(n)]
        items.append((len(items), " ".join(words)))
        for _ in range(40 if n < 60 else 8):
            copy = list(words)
            for at in rng.sample(range(n), changed):
                copy[at] = word()
            rows.append(" ".join([word() for _ in range(rng.randrange(9))] + copy + [word() for _ in range(rng.randrange(9))]))
            made.append(len(items) - 1)
    got = {r.doc_id: r.hits for r in decontam.find_contamination(frame(spark, list(enumerate(rows))), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, text in enumerate(rows):
        (hit,) = got[d]
        assert hit.item_id == made[d] and (hit.start, hit.words, hit.agreeing) == by_all_diagonals(text, items[made[d]][1]), (text, hit)


def test_few_words_in_any_order_equal_brute_force(spark):
    """Texts and passages of two or three different words hit each other everywhere."""
    rng = random.Random(18)
    draw = lambda n: " ".join(rng.choices("abc"[: rng.choice([1, 2, 3])], k=n))
    items = [(k, draw(rng.randrange(1, 14))) for k in range(12)]
    rows = [draw(rng.randrange(1, 30)) for _ in range(60)]
    got = {r.doc_id: {h.item_id: (h.start, h.words, h.agreeing) for h in r.hits} for r in decontam.find_contamination(frame(spark, list(enumerate(rows))), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, text in enumerate(rows):
        for k, passage in items:
            want = by_all_diagonals(text, passage)
            found = got[d].get(k)
            # Without five words in a row, or a pattern of a seed, nothing starts; what is found is at most the best.
            assert found is None or found[1:] <= want[1:], (text, passage)
            if want and (want[2] == want[1]):
                assert found == want, (text, passage, found, want)


def test_long_repetitive_texts_are_told_in_seconds():
    h, w = np.zeros(200_000, np.uint64), np.zeros(2000, np.uint64)
    begun = time.perf_counter()
    starts = decontam._starts([np.arange(200_000)], [np.arange(2000)])
    assert decontam.best_overlap(h, w, starts, 80, 8) == (0, 2000, 2000)
    assert time.perf_counter() - begun < 5
