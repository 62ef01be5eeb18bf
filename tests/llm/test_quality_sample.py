"""Labelled texts that are longer than all that the quality model may learn from."""

import zlib

from tracelight.llm import quality


def test_quality_sample_stands_giants(spark):
    """One giant text, wherever its hash puts it, leaves the other labelled rows in the sample."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    label = lambda i: i % 2
    text = lambda i: ("clear useful prose about rivers" if label(i) else "junk junk buy buy click") + f" {i}"
    labels = spark.createDataFrame([(i, label(i)) for i in ids], "doc_id long, quality int")
    first = spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").first()[0]
    for giant in (first, ids[len(ids) // 2]):
        docs = spark.createDataFrame([(i, "z" * 50_000 if i == giant else text(i)) for i in ids], "doc_id long, text string")
        model = quality.learn(docs, labels, sample_bytes=40_000)
        got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
        right = [i for i in ids if i != giant and (got[i] > 0.5) == bool(label(i))]
        assert len(right) >= 0.95 * (len(ids) - 1)
