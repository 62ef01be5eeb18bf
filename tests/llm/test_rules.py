"""Quality rules: counts against brute force, the classifier on held-out rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tracelight.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["a b c a b c", "a b c d a b c a", "x\n\nx\n \nx \ny\nx", "# * $ % & | < >", " é b c", "a\rb\rc\na\rb\rc", " ".join(["p q r"] * 30), " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "1 2 3 " * 13 + " ".join(f"w{i}" for i in range(38)), "ab " * 400_000, "x" * 2_000_000]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    counts = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)]
    return (*counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, text string")


def test_counts_of_every_row(spark):
    docs = cases.documents(spark, 1).select("doc_id", "text", "score").unionByName(spark.createDataFrame([(5000 + i, t, None) for i, t in enumerate(ODD)], "doc_id long, text string, score string"))
    want = sorted(map(str, [(r.doc_id, *brute(r.text)) for r in docs.collect()]))
    got = Q.apply_rules(docs, spark.read.parquet(f"{cases.SF}/labels.parquet")).collect()
    assert sorted(map(str, [(r.doc_id, *(r[c] for c in Q.COUNTS), r.base_failed) for r in got])) == want
    assert all(0 <= r.probability <= 1 and r.kept == (not r.base_failed and r.probability >= 0.5) for r in got)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, known = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.apply_rules(docs, known).join(known, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert len(got) > 300
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.98 and np.mean([r.kept for r in bad]) < 0.05
    # a probability of p is right p of the time: squared error far below that of the labels' share
    assert np.mean([(r.probability - r.quality) ** 2 for r in got]) < 0.02


@pytest.mark.parametrize("rows", [[], [(1, None, "t")], [(1, 0, "t"), (1, 1, "t")], [(None, 1, "t")], [(0, 1, "t")]])
def test_labels_that_teach_nothing(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["good " * 5, None, " ".join(map(str, range(60)))])], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.apply_rules(docs, labels(spark, [r for r in rows if r[0] != 0 or zlib.crc32(b"0") % 5 == 0])).collect()}
    assert [got[i].probability for i in range(3)] == [0.5] * 3 and [got[i].kept for i in range(3)] == [False, False, True]


def test_empty_tables_and_order(spark):
    none = labels(spark, [])
    assert Q.apply_rules(cases.empty(spark), none).count() == 0
    model = Q.fit(*_flat(["a b " * 40, "c d " * 40, "a c " * 30]), np.array([1, 0, 1]), np.zeros(3, bool))
    texts = ["a b " * 40, None, "c d x " * 60, "a b " * 40]
    one = Q.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    two = Q.judge(spark.createDataFrame([(i, t) for i, t in reversed(list(enumerate(texts)))], "doc_id long, text string").coalesce(1), model).collect()
    assert sorted(one) == sorted(two) and one[0].probability == one[3].probability


def _flat(texts):
    import pyarrow as pa

    from tracelight.llm.common import flat_text

    return flat_text(pa.array(texts))
