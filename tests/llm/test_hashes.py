"""Words that linear hashes confuse, and counts beyond 32 bits."""

import numpy as np
import pyarrow as pa
import pytest

from tracelight.llm import common, ctw, jaccard, substring


def twins(n=1024):
    """Two words of n bytes that every polynomial modulo 2**64 with an odd base takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def hashes(words, salt=0):
    data, offsets = common.flat_text(pa.array(words))
    return common.word_hashes(data, *common.word_spans(data, offsets)[:2], salt)


@pytest.mark.parametrize("n", [2, 16, 1024, 4096])
def test_twins_differ(n):
    one, two = hashes(list(twins(n)))
    assert one != two and len({one, two, *hashes(list(twins(n)), 1)}) == 4


def test_hash_depends_on_the_word_alone():
    words = ["a", "b", "ab", "ba", "é", "x" * 100, "x" * 101, "a" * 3_000_000]
    alone = [hashes([w])[0] for w in words]
    assert len(set(alone)) == len(words)
    assert hashes([" ".join(words)]).tolist() == alone == hashes(words).tolist()


def test_twins_are_no_repeats_and_no_copies(spark):
    one, two = twins()
    rest = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([*rest[:6], one, *rest[6:]])), (2, " ".join([*rest[:6], two, *rest[6:]]))], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeats(docs).collect()] == [0, 0]
    assert [r.n_links for r in jaccard.near_duplicates(docs).collect()] == [0, 0]


def test_counts_beyond_32_bits():
    body, counts = np.array([5, 9], "<u8").tobytes(), np.array([3_000_000_000, 1], "<u8").tobytes()
    key = lambda shard: (pa.scalar(shard), pa.scalar(7))
    table = lambda body, counts: pa.table({"chunk": [0, 1], "shard": [0, 0], "body": [body] * 2, "counts": [counts] * 2})
    grams = ctw._combine(key(0), table(body, counts))
    assert np.frombuffer(grams["counts"][0].as_py(), "<u8").tolist() == [6_000_000_000, 2]
    words = ctw._combine(key(-1), table(b"a b", counts))
    assert np.frombuffer(words["counts"][0].as_py(), "<u8").tolist() == [6_000_000_000, 2]
    assert ctw._word_total(pa.concat_tables([words, words])) == {b"a": 12_000_000_000, b"b": 4}


def test_a_line_in_every_document_is_sent_once_for_each_chunk(spark):
    line = "licensed to all under the terms of this common licence as is and without warranty of any kind"
    docs = spark.createDataFrame([(i, i % 5, f"{line} a{i} b{i} {line}") for i in range(500)], "doc_id long, chunk int, text string")
    sent = [np.frombuffer(r.probes, "<u4").tolist() for r in substring.fingerprints(docs, 0).collect()]
    most = max(sum(x.count(k) for x in sent) for k in set(sent[0]))
    assert most == 5
    got = substring.remove_repeats(docs.drop("chunk"), chunk_bytes=10_000).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0] + [36] * 499
