"""Language model, language identification and quality."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tracelight.llm import ctw, langid, quality

crc = lambda d: zlib.crc32(("" if d is None else str(d)).encode())


def brute_ctw(rows, order):
    """Context-tree weighting by the book, with dictionaries."""
    tree, below, weighted = defaultdict(lambda: [0, 0]), Counter(), {}

    def bits(b):
        n = 1
        for j in range(7, -1, -1):
            yield n, (b >> j) & 1
            n = 2 * n + ((b >> j) & 1)

    coded = lambda t: bytes(order) + (t or "").encode().lower() + b"\0"
    for d, t in rows:
        if crc(d) % 7 != 2:
            s = coded(t)
            for i in range(order, len(s)):
                for n, x in bits(s[i]):
                    for k in range(order + 1):
                        tree[(s[i - k : i], n)][x] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    for key in sorted(tree, key=lambda k: -len(k[0])):
        own = kt(*tree[key])
        weighted[key] = own if len(key[0]) == order else float(np.logaddexp(own, below[key])) - math.log(2)
        if key[0]:
            below[(key[0][1:], key[1])] += weighted[key]

    def score(t):
        s, total = coded(t), 0.0
        for i in range(order, len(s)):
            for n, x in bits(s[i]):
                p = 0.5
                for k in range(order, -1, -1):
                    key = (s[i - k : i], n)
                    if key not in tree:
                        continue
                    a, b = tree[key]
                    own = ((b if x else a) + 0.5) / (a + b + 1)
                    ratio = math.exp(max(-60, min(60, kt(a, b) - below[key])))
                    p = own if k == order else (ratio * own + p) / (ratio + 1)
                total += math.log10(p)
        return total

    return score


@pytest.fixture(scope="module")
def scored(spark):
    """Documents and what brute force makes of them."""
    docs = cases.documents(spark, 8)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts, ends = Counter(), 0
    for d, t in rows:
        if crc(d) % 7 != 2:
            counts.update((t or "").encode().lower().split())
            ends += 1
    tokens, distinct = sum(counts.values()) + ends, len(counts) + 1
    counts[None] = ends
    score, want = brute_ctw(rows, ctw.ORDER), []
    for d, t in rows:
        words = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / (tokens + distinct + 1)) for w in words)
        want.append((-1 << 40 if d is None else d, crc(d) % 7 == 2, len(words), sum(counts[w] > 0 for w in words), tokens, base, score(t)))
    return docs, sorted(want)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 30_000, "shard_text": 20_000}, {"chunk_bytes": 10_000, "shard_text": 60_000, "fan": 3}])
def test_ctw_equals_brute_force(spark, scored, sizes):
    docs, want = scored
    got = sorted((-1 << 40 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score_documents(docs, **sizes).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_ctw_of_nothing(spark):
    assert ctw.score_documents(cases.empty(spark)).count() == 0


def test_language_by_held_out_accuracy(spark):
    docs = cases.documents(spark, 1)
    true = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.language_of(docs).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and true[r.doc_id] and 0 <= (r.doc_id or -1) < 7000]
    assert sum(true[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert by[-2].lang_pred == by[8003].lang_pred == "und" and by[8003].score == 0
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 for r in got)


def test_language_codes_are_exact(spark):
    text = [b"abab", b"abc"]
    data, offsets = np.frombuffer(b"".join(text), np.uint8), np.array([0, 4, 7])
    code, n = np.unique(langid.grams(data, offsets), return_counts=True)
    tree = langid.Tree(code, n.astype(float))
    # after "ab" at a start: seen followed by a and by c, once each; two kinds of follower
    gram = np.array([ord("a") << 16 | ord("b") << 8 | ord("c")], np.uint32)
    assert tree.nats(gram)[0] == pytest.approx(math.log(4))
    # z is new under every context: three escapes down to the bytes
    assert tree.nats(np.array([ord("a") << 16 | ord("b") << 8 | ord("z")], np.uint32))[0] > math.log(256)


def brute_ppm(samples, text, order=3):
    """Nats of a text under a tree of contexts, method C, by dictionaries."""
    counts = defaultdict(Counter)
    for t in samples:
        padded = bytes(order) + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                counts[padded[i - k : i]][padded[i]] += 1
    total, padded = 0.0, bytes(order) + text
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            c = counts.get(padded[i - k : i])
            if c is None:
                continue
            room = sum(c.values()) + len(c)
            if padded[i] in c:
                total -= math.log(c[padded[i]] / room)
                break
            total -= math.log(len(c) / room)
        else:
            total += math.log(256)
    return total


def test_language_equals_brute_force(spark):
    rows = [(k, t, n) for n, (k, t) in enumerate([("en", "the cat and the dog"), ("en", "then they ate"), ("de", "der hund und die katze"), ("de", "dann aßen sie"), ("xx", "the cat and the dog"), ("xx", "then they ate")])]
    trees = langid.learn(spark.createDataFrame(rows, "lang string, text string, key long"))
    asked = ["the dog ate", "die Katze", "ß", "zebra 12", "a" * 3000, "", None, "123", "the dog ate"]
    got = langid.identify(spark.createDataFrame([(i, t, "s") for i, t in enumerate(asked)], "doc_id long, text string, score string"), trees)
    by = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(asked):
        text = (t or "").encode()
        cost = {k: brute_ppm([x.encode() for own, x, _ in rows if own == k], text) for k in sorted(trees)}
        if not any(c.isalpha() for c in t or ""):
            assert by[i].lang_pred == "und" and by[i].score == 0
            continue
        best = min(cost, key=lambda k: (round(cost[k], 9), k))  # en and xx tie: the first by name
        share = 1 / sum(math.exp(min(0, cost[best] - c)) for c in cost.values())
        assert by[i].lang_pred == best and by[i].score == pytest.approx(share, rel=1e-6)
        assert by[i].bits_per_byte == pytest.approx(cost[best] / math.log(2) / len(text), rel=1e-9)


def brute_quality(text, weight, bias):
    b = text.encode()
    bucket = lambda x, n: ((int.from_bytes(x.ljust(n, b"\0"), "little") * 0x9E3779B1 % 2**32) ^ (n << 27) % 2**32) >> (32 - quality.BUCKET_BITS)
    values = [float(weight[bucket(b[i : i + n], n)]) for n in (3, 4) for i in range(len(b))]
    words = b.split()
    hashes = quality.word_hashes(np.frombuffer(b"".join(words), np.uint8), *np.cumsum([[0, *map(len, words)][:-1], [*map(len, words)]], axis=1)) if words else []
    values += [float(weight[int(quality.mix64(np.array([h], np.uint64))[0] >> np.uint64(64 - quality.BUCKET_BITS))]) for h in hashes]
    again = len(words) - len(set(words))
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = len(triples) - len(set(triples))
    values += [float(weight[quality.WORD_AGAIN])] * again + [float(weight[quality.TRIPLE_AGAIN])] * twice
    return 1 / (1 + math.exp(-(bias + sum(values) / max(1, len(values)))))


def test_quality_scores_do_not_depend_on_the_neighbours(spark):
    weight = np.random.default_rng(9).normal(0, 3, 1 << quality.BUCKET_BITS).astype(np.float32)
    texts = ["an apple a day, an apple a day", "", "q", "zz", "naïve été", "the the the the", "x" * 5000, None, "an apple a day, an apple a day"]
    want = [brute_quality(t or "", weight, 0.1) for t in texts]
    for order in (range(len(texts)), reversed(range(len(texts)))):
        df = spark.createDataFrame([(i, texts[i], "n") for i in order], "doc_id int, text string, score string").repartition(2)
        alone = {r.doc_id: r.score for r in quality.score(df, (weight, 0.1)).collect()}
        together = {r.doc_id: r.score for r in quality.score(df.coalesce(1), (weight, 0.1)).collect()}
        assert alone == together and [alone[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_language_without_labels(spark):
    none = cases.documents(spark, 40).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_of(none).collect()} == {"und"}
    assert langid.language_of(cases.empty(spark)).count() == 0


def test_quality_by_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    label = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.quality_of(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_on_odd_rows(spark):
    docs = cases.documents(spark, 4)
    labels = spark.createDataFrame([(d, int(d % 3 > 0)) for d in range(0, 200, 4)] + [(8, 0), (8, 1), (None, 1), (12, None)], "doc_id long, quality int")
    got = quality.quality_of(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality_of(docs, labels.filter("false")).collect()} == {0.5}
    assert quality.quality_of(cases.empty(spark), labels).count() == 0
