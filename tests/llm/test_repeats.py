"""Repeats, near copies and benchmark passages against brute force."""

import hashlib
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tests.llm import cases
from tracelight.llm import decontam, jaccard, substring, suffix

LAST = (1 << 63) - 1


def place(d):
    return LAST if d is None else d


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark, 2)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 40_000, "range_keys": 3_000}])
def test_word_windows(spark, docs, rows, sizes):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, LAST), place(d))
    want = Counter()
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < place(d):
                gone[i : i + 13] = [True] * 13
        want[(d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())] += 1
    assert Counter(map(tuple, substring.remove_repeats(docs, **sizes).collect())) == want
    assert sum(n * k[2] for k, n in want.items()) > 0
    assert substring.remove_repeats(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 40_000, "shard_text": 300_000, "block_bytes": 10_000}, {"chunk_bytes": 60_000, "hot": 2}])
def test_byte_strings(spark, docs, rows, sizes):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            k, at = b[i : i + 100], (place(d), i)
            if k not in first or at < first[k]:
                first[k] = at
    want = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (place(d), i):
                gone[i : i + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        want[(d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())] += 1
    assert Counter(map(tuple, suffix.remove_repeats(docs, **sizes).collect())) == want
    assert suffix.remove_repeats(cases.empty(spark)).count() == 0


def test_hot_and_cold_anchors_agree(spark):
    """A table of some size, its common anchors dealt window by window and not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cold, hot = (sorted(map(tuple, suffix.remove_repeats(docs, chunk_bytes=300_000, hot=n).collect())) for n in (1 << 40, 3))
    assert cold == hot and sum(r[2] for r in cold) > 0


@pytest.mark.parametrize("text", [b"banana", b"a" * 300, b"mississippi" * 20, bytes(np.random.default_rng(1).integers(97, 100, 2000).astype(np.uint8))])
def test_suffix_array_and_common_prefixes(text):
    data = np.frombuffer(text, np.uint8)
    order = suffix.suffix_array(data)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    shared = suffix.common_prefixes(data, order)
    for a, b, n in zip(order, order[1:], shared[1:]):
        k = 0
        while k < min(100, len(text) - max(a, b)) and text[a + k] == text[b + k]:
            k += 1
        assert n == k


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("sizes", [{}, {"block": 2}])
def test_near_copies(spark, sizes):
    docs = cases.documents(spark, 1)
    base = [f"t{i}" for i in range(60)]
    near = [(9000 + k, " ".join([*base[:k], "new", *base[k + 1 :]])) for k in range(12)] + [(9100, " ".join(base)), (9101, " ".join(base))]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    by = defaultdict(list)
    nameless = 0
    for r in docs.collect():
        if r.doc_id is None:
            nameless += 1
        else:
            by[r.text or ""].append(r.doc_id)
    texts = list(by)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, copies = Counter(), Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                copies[i] += len(by[texts[j]])
                copies[j] += len(by[texts[i]])
                root[find(i)] = find(j)
    least = {}
    for i, t in enumerate(texts):
        least[find(i)] = min(least.get(find(i), LAST), min(by[t]))
    want = Counter((d, least[find(i)], min(by[t]), len(by[t]) - 1 + copies[i], links[i]) for i, t in enumerate(texts) for d in by[t])
    want[(None, None, None, 0, 0)] = nameless
    assert Counter(map(tuple, jaccard.near_duplicates(docs, **sizes).collect())) == want
    assert sum(links.values()) > 40


def test_links_do_not_depend_on_the_size_of_a_block(spark):
    """At a low recall many pairs share no band; what counts as a link is the same all the same."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(30):  # a chain and a bunch of near copies
        words = [f"t{i}" for i in range(60)]
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            words[at] = f"n{k}"
        rows.append((k, " ".join(words)))
        rows.append((100 + k, " ".join(f"c{i}" for i in range(2 * k, 2 * k + 40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for sizes in ({}, {"block": 2}, {"block_bytes": 900}):
        got = sorted(map(tuple, jaccard.near_duplicates(docs, recall=0.6, **sizes).collect()))
        want = want or got
        assert got == want
    assert sum(r[4] for r in want) > 30


def test_near_copies_of_nothing(spark):
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0


def test_bands_meet_the_recall():
    n = jaccard.band_count(0.8, 4, 0.9999)
    assert 1 - (1 - 0.8**4) ** n >= 0.9999 > 1 - (1 - 0.8**4) ** (n - 1)


def tokens(t):
    return (t or "").lower().translate(str.maketrans("", "", decontam.PUNCTUATION)).split()


def test_benchmark_passages(spark):
    docs = cases.documents(spark, 1).select("doc_id", "text", "score")
    item = " ".join(f"b{i}" for i in range(30))
    swapped = item.replace("b4 ", "x ").replace("b9 ", "y ").replace("b17 ", "z ")
    planted = [(9000, "lead " + item + " tail"), (9001, swapped.upper()), (9002, " ".join(f"b{i} c{i}" for i in range(30))), (9003, "p q r s t"), (9004, "p q r s v"), (9005, "g1 g2 g3 gx g5 g6 g7"), (None, item)]
    docs = docs.unionByName(spark.createDataFrame([(*p, "s") for p in planted], "doc_id long, text string, score string"))
    bench = spark.read.parquet(f"{cases.SF}/benchmark.parquet").select("item_id", "text").unionByName(
        spark.createDataFrame([(900, item), (901, "p q r s t"), (902, "a b"), (903, None), (None, item), (904, "g1 g2 g3 g4 g5 g6 g7"), (900, item)], "item_id long, text string"))
    items = [(r.item_id, tokens(r.text)) for r in bench.collect() if r.item_id is not None]
    want = defaultdict(set)
    for r in docs.collect():
        w = tokens(r.text)
        for k, v in items:
            width = min(13, len(v))
            if len(v) < 5 or r.doc_id is None:
                continue
            need = -(-width * 8 // 10) if width > 5 else width
            if not set(v) & set(w):
                continue
            for shift in range(width - len(v), len(w) - width + 1):
                run = [0 <= shift + i < len(w) and w[shift + i] == v[i] for i in range(len(v))]
                if any(sum(run[s : s + width]) >= need and shift + s >= 0 and shift + s + width <= len(w) for s in range(len(v) - width + 1)):
                    want[r.doc_id].add(k)
                    break
    got = {r.doc_id: set(r.item_ids) for r in decontam.contaminated(docs, bench).collect()}
    assert got == dict(want)
    assert {9000, 9001, 9003, 9005} <= set(got) and not {9002, 9004} & set(got)
    assert decontam.contaminated(cases.empty(spark), bench).count() == 0 == decontam.contaminated(docs, bench.filter("false")).count()


def test_a_large_benchmark_is_joined_without_broadcast(spark, monkeypatch):
    docs = cases.documents(spark, 4)
    bench = spark.read.parquet(f"{cases.SF}/benchmark.parquet")
    want = sorted(map(str, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert sorted(map(str, decontam.contaminated(docs, bench).collect())) == want


def test_native_plans(spark):
    plan = decontam.contaminated(cases.documents(spark), spark.read.parquet(f"{cases.SF}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_long_texts_without_broadcast(spark, monkeypatch):
    """Time goes with a text's length on this path too."""
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    passage = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (2, "common words of a stem that many share " + "end")], "item_id long, text string")
    words = lambda n: " ".join(f"v{i % 997}" for i in range(n))
    took = []
    for n in (8_000, 400_000):
        docs = spark.createDataFrame([(7, words(n) + " " + passage + " " + words(n)), (8, words(n))], "doc_id long, text string")
        began = time.time()
        assert [(r.doc_id, r.item_ids) for r in decontam.contaminated(docs, bench).collect()] == [(7, [1])]
        took.append(time.time() - began)
    assert took[1] < 5 * took[0] + 20


@pytest.mark.parametrize("width", range(5, 14))
def test_masks_leave_one_clear(width):
    """Whatever tokens differ, as many as may: one mask keeps none of them."""
    differ = width - decontam.needed(width)
    for wrong in combinations(range(width), differ):
        assert any(not set(kept) & set(wrong) for kept in decontam.masks_of(width))


def test_a_common_stem_makes_no_hits(spark):
    """Documents and items that share five common words only are not compared with each other."""
    stem = "which of the following is"
    docs = spark.createDataFrame([(i, f"a{i} b{i} {stem} c{i} d{i} e{i}") for i in range(2000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"x{i}y{j}" for j in range(6)) + f" {stem} " + " ".join(f"z{i}y{j}" for j in range(6))) for i in range(400)], "item_id long, text string")
    found = decontam.overlaps(docs, items)
    found.collect()
    assert found.count() == 0
    seeds = decontam._seeds(items, "item_id", "text", [13]).select("seed").distinct()
    assert decontam._found(docs, seeds, "doc_id", "text", [13], True).count() == 0
