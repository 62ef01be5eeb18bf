"""Personal data, top-k, packing and the pipeline."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tracelight.llm import packing, pii, topk
from tracelight.llm.queries import tokenizer_path

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ODD = ["a@b.c_d@e.f 1.2.3.4.5 256.1.1.1 00001.2.3.4 é+49 30 1234567", "4111 1111 1111 1111, 4111-1111-1111-1112 +1 2", "x@y @z.w a@b a.@c.d..e", "1 " * 3000, "9" * 400, "ü@é.de +1 (555) 010-9999-", "1.2.3.4@x.y"]


def luhn(x):
    return sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(x))) % 10 == 0


def brute(text):
    found, counts = [], []
    for kind, p in BASE.items():
        n = 0
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                found.append(f"{kind}:{m.start()}:{m.end()}")
                n += 1
        counts.append(n)
    return counts, ",".join(found)


def test_base_spans(spark):
    docs = cases.documents(spark, 1).select("doc_id", "text").unionByName(spark.createDataFrame([(5000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    text = defaultdict(list)
    for r in docs.collect():
        text[r.doc_id].append(brute(r.text))
    for r in pii.digest(docs).collect():
        assert any([r.n_email, r.n_ip, r.n_card, r.n_phone] == n and r.base_sha256 == hashlib.sha256(s.encode()).hexdigest() and r.spans.startswith(s) for n, s in text[r.doc_id])
    assert pii.digest(cases.empty(spark)).count() == 0


def test_validated_and_contextual_spans(spark):
    rows = [("iban DE89 3704 0044 0532 0130 00 now", "iban:5:32"), ("iban DE88 3704 0044 0532 0130 00 now", ""), ("ssn 123-45-6789", "ssn:4:15"), ("part 123-45-6789", ""), ("ssn 000-45-6789", ""), ("call (602) 555-5136", "tel:5:19"), ("serial 602.555.5136", "")]
    got = pii.digest(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in got} == {i: s for i, (_, s) in enumerate(rows)}


def test_redaction_leaves_no_base_span(spark):
    df = pii.redact_pii(spark.createDataFrame([(0, "a@b.c, call +49 30 1234567."), (1, None), (2, "clean")] + [(5 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    got = {r.doc_id: r.text for r in df.collect()}
    assert got[0] == "<EMAIL>, call <PHONE>." and got[1] is None and got[2] == "clean"
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 40, "query_rows": 7}])
@pytest.mark.parametrize("k", [20, 1000])
def test_top_k(spark, sizes, k):
    df = spark.read.parquet(f"{cases.SF}/embeddings.parquet").select("vec_id", "embedding")
    one = df.first().embedding
    odd = [(1000, None), (1001, [None] * 64), (1020, one), (1021, one), (1022, one), (1040, [float("nan")] * 64), (1041, [float("inf")] * 64), (1060, [1.0, 2.0]), (1061, [3.0, 1.0]), (1080, []), (None, one), (1020, one)]
    df = df.unionByName(spark.createDataFrame(odd, df.schema))
    vectors = topk.quantised(df)
    got = [tuple(r)[:4] for r in topk.top_k(vectors, vectors.filter("id % 20 = 0"), k, **sizes).collect()]
    held = [(r.vec_id, np.floor(np.array(r.embedding, float) * 64).astype(int)) for r in df.collect() if r.vec_id is not None and r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    want = []
    for own, (q, v) in enumerate(held):
        if q % 20 == 0:
            scores = sorted((-int(v @ x), i) for row, (i, x) in enumerate(held) if row != own and len(x) == len(v))[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(want)
    none = vectors.filter("false")
    assert topk.top_k(none, none, k).count() == 0


@pytest.mark.parametrize("spread", [3, 400, 2**26])
def test_blocks_find_the_best_by_their_cells(spread):
    """Coarse cells, fine ones, and components whose products doubles would round."""
    rng = np.random.default_rng(5)
    x, q = rng.integers(-spread, spread, (700, 12)), rng.integers(-spread, spread, (9, 12))
    uid, ids = np.arange(700), np.sort(rng.integers(0, 500, 700))
    asked, found, score, _ = topk.block_top_k(uid, ids, x, np.arange(5, 14), q, 20)
    for n in range(9):
        want = sorted((-int(q[n] @ x[i]), ids[i]) for i in range(700) if i != n + 5)[:20]
        assert [(-s, i) for s, i in zip(score[asked == n + 5].tolist(), found[asked == n + 5].tolist())] == want


def test_few_exact_vectors_are_read():
    """Cells are wider than one value here as in the query, and still most vectors are left unread."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8000, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None]).astype(int)
    assert (topk.cells(x)[2] > 1).all()
    asked, found, score, read = topk.block_top_k(np.arange(8000), np.arange(8000), x, np.arange(0, 8000, 400), x[::400], 20)
    assert read.mean() < 250
    for n in range(20):
        want = sorted((-int(x[400 * n] @ x[i]), i) for i in range(8000) if i != 400 * n)[:20]
        assert [(-s, i) for s, i in zip(score[asked == 400 * n].tolist(), found[asked == 400 * n].tolist())] == want


def test_cells_bound_every_score():
    rng = np.random.default_rng(0)
    x, q = rng.integers(-5000, 5000, (300, 5)), rng.integers(-50, 50, (40, 5))
    code, low, width = topk.cells(x, 16)
    upper, slack = topk.bounds(code.astype(float), low, width, q)
    exact = q @ x.T
    assert (exact <= upper).all() and (upper - slack[:, None] <= exact).all()


def test_packing(spark):
    from tokenizers import Tokenizer

    more = [(9000, "a  b \n c   d \x1c x <|endoftext|> \n\n  z "), (9001, "don't! l'été, naïve... 123abc 中文字  x ́y"), (9002, " lead"), (9003, "tail \n"), (9004, "<|endoftext|>"), (9005, "hello <|endoftext|> world<|endoftext|><|endoftext|>\n<|endoftext"), (9006, "a " * 700 + "<|endoftext|>" * 600)]
    docs = cases.documents(spark, 1).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or min(1024, len(ids))
        cut = [0, *range(head, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    key = lambda t: tuple(-(1 << 62) if x is None else x for x in t)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    # one group, at most a sequence above its bound
    assert len(placed) <= 1 + sum(r.length == 1024 for r in got) + packing.lower_bound(np.array([r.length for r in got if r.length < 1024]), 1024)
    assert packing.pack_documents(cases.empty(spark), tokenizer_path()).count() == 0


@pytest.mark.parametrize("pool", [1, 2, 8])
def test_groups_exchange_documents(spark, pool):
    rng = np.random.default_rng(2)
    # pieces of which two just fill a sequence: a group that holds an odd one out has a gap
    sizes = np.r_[rng.integers(1, 1025, 1500), rng.choice([341, 342, 511, 513], 1500)]
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, length long")
    got = packing.pack(df, group_pieces=150, pool_groups=pool).collect()
    assert sorted(r.uid for r in got) == list(range(len(sizes)))
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, int(sizes[r.uid])))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    groups = defaultdict(list)
    for r in df.selectExpr("uid", "pmod(xxhash64(uid), 20) AS g").collect():
        groups[r.g].append(int(sizes[r.uid]))
    apart = sum(len(packing.best_fit_decreasing(np.array(g), 1024)[2]) for g in groups.values())
    assert packing.lower_bound(sizes, 1024) <= len(held) < apart


def test_bounds_never_exceed_a_packing():
    random = np.random.default_rng(3)
    for _ in range(200):
        sizes = random.integers(1, 65, random.integers(1, 40))
        assert -(-sizes.sum() // 64) <= packing.lower_bound(sizes, 64) <= len(packing.best_fit_decreasing(sizes, 64)[2])


def test_pipeline(spark):
    import corpus_pipeline as pipeline
    from tracelight.llm import decontam, jaccard, langid

    docs = cases.documents(spark, 1)
    columns, kept, ids = docs.columns, docs, None
    for name, stage in pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, cases.SF).cache()
        assert kept.columns == columns, name
        ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
        if name == "language":
            und = {r.doc_id for r in langid.language_of(before).filter("lang_pred = 'und'").collect()}
            assert 8003 in und and -2 not in ids and 8003 not in ids and kept.filter("lang IS NULL").count() == 0
        if name == "near_copies":
            found = jaccard.near_duplicates(before).filter("doc_id IS NOT NULL").collect()
            # an id of two unrelated texts keeps both
            assert sorted(set(ids)) == sorted({r.class_id for r in found}) and kept.filter("doc_id IS NULL").count() == before.filter("doc_id IS NULL").count()
        if name == "decontaminate":
            gone = {r.doc_id for r in decontam.contaminated(before, spark.read.parquet(f"{cases.SF}/benchmark.parquet")).collect()}
            assert ids == sorted(r.doc_id for r in before.collect() if r.doc_id is not None and r.doc_id not in gone)
        if name == "personal_data":
            assert all(brute(r.text)[0] == [0, 0, 0, 0] for r in kept.collect()) and kept.count() == before.count()
            assert kept.filter("n_chars <> length(text)").count() == 0
    packed = pipeline.STAGES[-1][1](spark, kept, cases.SF)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    out = pipeline.run(spark, cases.SF)
    assert out.count() > 0 and "sequence_id" in out.columns
