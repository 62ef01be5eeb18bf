"""The stage near_copies where ids repeat with different texts."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string"
prose = lambda k: " ".join(f"w{i}" for i in range(k, k + 30))


def test_shared_ids_lose_only_copies(spark):
    x, y, z, near = prose(0), prose(100), prose(200), prose(200) + " more"
    rows = [(1, y), (5, x), (5, y), (6, x), (6, z), (6, z), (7, near), (8, "a"), (8, "b"), (None, x)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), "n") for d, t in rows], SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id or 0, r.text) for r in got.collect()))
    assert kept == sorted([(1, y), (5, x), (6, z), (8, "a"), (8, "b"), (0, x)])
